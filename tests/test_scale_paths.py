"""The forms of searches that large inputs take: the same rows as the plain ones, in bounded memory."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from grounded.config import SearchConfig
from grounded.functions.vectors import TopK, reaching, same_ids, single_margin, unit_rows
from grounded.operators import lexical, product
from grounded.operators import search as srch
from grounded.session import scratch_dir

VC = srch.VecCol("v")


def key(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(spark, n=130, seed=8):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(n)] + [(900, None), (901, [0.0] * 8), (None, [1.0] * 8)]
    rows += [rows[3], (3, rows[5][1])]                                        # repeated ids
    return spark.createDataFrame(rows, "id long, v array<float>")


def test_single_precision_loses_no_hit():
    r = np.random.default_rng(1)
    V = unit_rows(np.repeat(r.normal(size=(60, 64)), 5, axis=0) + r.normal(scale=1e-7, size=(300, 64)))     # near ties
    S, ids = np.floor(V @ V.T * 1e6 + 0.5) / 1e6, np.arange(300)
    np.fill_diagonal(S, -np.inf)
    for chunk in (7, 64, 1000):
        top = TopK(300, 6)
        for r_, c, _ in reaching(V.astype(np.float32), V.astype(np.float32), 2 * single_margin(64) + 2e-6, chunk, top, ids, own=same_ids(ids, ids, ids)):
            top.push(r_, ids[c], S[r_, c])
        qi, found, _ = top.items()
        assert all(list(found[qi == q]) == sorted(ids, key=lambda i: (-S[q, i], i))[:6] for q in ids)


@pytest.mark.parametrize("nprobe", [2, 5, 12])
def test_many_probes_make_no_lists_on_the_driver(spark, monkeypatch, nprobe):
    df = vectors(spark)
    piv = srch.pivot_matrix(srch.hash_pivots(df.where("id < 900"), "id", "v", 12), VC)
    args = dict(q_id="id", q_vec=VC, c_id="id", c_vec=VC, pivots=piv, dim_hint=8,
                cfg=SearchConfig(k=4, threshold=0.1, nprobe=nprobe, exclude_self=True))
    want = key(srch.ivf_search(spark, df, df, **args))
    monkeypatch.setattr(srch, "_MAX_PROBES", 100)
    monkeypatch.setattr(srch, "_WIDE_PROBE", 1)
    monkeypatch.setattr(srch, "_broadcast_scan", lambda *a, **k: pytest.fail("too many probes for the driver"))
    assert want and key(srch.ivf_search(spark, df, df, **args)) == want
    indexed = srch.assign_cells(df, VC, piv)
    assert key(srch.ivf_search(spark, df, indexed, cell_col="cell", **args)) == want


@pytest.mark.parametrize("k", [3, None])
def test_many_questions_are_dealt_out(spark, monkeypatch, k):
    df = vectors(spark)
    args = dict(q_id="id", q_vec=VC, c_id="id", c_vec=VC, dim_hint=8, cfg=SearchConfig(k=k, threshold=0.2, exclude_self=True))
    want = key(srch.nn_search(spark, df, df, **args))
    monkeypatch.setattr(srch, "_SCAN_QUESTIONS", 50)
    monkeypatch.setattr(srch, "_BLOCK_QUESTIONS", 20)
    monkeypatch.setattr(srch, "_broadcast_scan", lambda *a, **k: pytest.fail("a scan has as many tasks as the file has splits"))
    assert want and key(srch.nn_search(spark, df, df, **args)) == want


def test_rescoring_sends_no_vector_per_pair(spark, monkeypatch):
    df = vectors(spark)
    args = dict(q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=SearchConfig(k=5, threshold=None, exclude_self=True))
    pairs = df.selectExpr("id AS qid").crossJoin(df.selectExpr("id")).where("qid <> id")
    want = key(srch.rescored(df, df, pairs, n_candidates=130, **args))
    monkeypatch.setattr(srch, "_BLOCK_BYTES", 30 * 8 * 8)
    got = srch.rescored(df, df, pairs, n_candidates=130, **args)
    assert want and key(got) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "Join" not in plan


def test_fixed_point_sums_the_norm_once(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(20)] + [(50, None), (51, [0.0] * 8), (52, [1.0, None] + [0.0] * 6)]
    out = {i.id: i.x for i in spark.createDataFrame(rows, "id long, v array<float>").select("id", product.fixed_point("v", 8).alias("x")).collect()}
    for i, v in rows[:20]:
        v = np.array(v, np.float32).astype(float)
        assert out[i] == [int(np.floor(x / np.sqrt(v @ v) * product.SCALE + 0.5)) for x in v]
    assert out[50] is out[51] is None and (out[52] is None)
    text = product.fixed_point("v", 8)._jc.toString()
    assert text.count("aggregate(") <= 3                                       # two comparisons and one binding


def test_index_scores_shuffle_no_pairs(spark):
    words = [f"w{i}" for i in range(40)]
    r = np.random.default_rng(6)
    docs = [(i, " ".join(r.choice(words, 12))) for i in range(300)] + [(700, None), (None, "w1 w2"), (7, "w3 w4"), (7, "w3 w4")]
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    qs = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w4 zzz"), (3, "none"), (4, ""), (1, "w1 w9"), (None, "w5 w6")], "item_id long, text string")
    path = lexical.build_bm25_index(docs, scratch_dir(spark, "t-index"))
    got = lexical.bm25_from_index(qs, path, k=6)
    st = spark.read.parquet(f"{path}/stats").first()
    joined = lexical._join_postings(spark.read.parquet(f"{path}/postings"), lexical.query_terms(qs, "item_id", "text"), "item_id", "doc_id",
                                    float(st["n"]), float(st["avgdl"]), 1.2, 0.75)
    best = {}
    for x in joined.collect():
        best.setdefault(x.item_id, []).append((-x.score, (x.doc_id is not None, x.doc_id or 0), x.doc_id))
    want = [(q, d, -s, n) for q, hits in best.items() for n, (s, _, d) in enumerate(sorted(hits)[:6], 1)]
    assert key(got) == sorted(want, key=str) and len(want) == 18
    assert "item_id" not in "".join(line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate" in line)


def test_weeks_are_dealt_out_in_one_pass(spark, tmp_path, monkeypatch):
    from grounded.plans import catalog
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=9 * i), "abc"[i % 3], float(3000 * (i % 7))) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double")
    frame.write.parquet(f"{tmp_path}/events.parquet")
    read = spark.read.parquet(f"{tmp_path}/events.parquet")
    scans = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        scans.add(1)
        return x

    monkeypatch.setattr(catalog, "T", lambda *a: read.withColumn("value", counted.asNondeterministic()("value")))
    late, final = catalog.q_request_rate_late(spark, str(tmp_path)), catalog._weekly(spark, str(tmp_path))[0]
    assert scans.value == 2 * len(rows)                                        # every event is read once a run
    assert late.count() and final.count()


def test_python_batches_are_small(spark):
    """Texts and wide vectors go to Python a few hundred rows at a time, whatever the session allows."""
    from grounded.operators import embed
    from grounded.operators import text as txt
    from grounded.session import ROWS_A_BATCH
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "b")], "item_id long, text string")
    buckets = docs.selectExpr("doc_id", "array(1, 2) AS cb")
    vc = srch.VecCol("cb", "buckets", 768)
    made = (lambda: embed.dense_embed(docs, "text"), lambda: txt.recursive_windows(docs), lambda: lexical.bm25(qs, docs),
            lambda: srch.nn_search(spark, buckets, buckets, q_id="doc_id", q_vec=vc, c_id="doc_id", c_vec=vc, cfg=SearchConfig(k=1)))
    try:
        for make in made:
            spark.conf.set(name, "10000")
            assert make().count() >= 1 and int(spark.conf.get(name)) == ROWS_A_BATCH
    finally:
        spark.conf.set(name, was)


def test_pairs_that_cannot_be_among_the_best_are_not_rescored():
    """Of each question about k pairs are left, and all of its k best."""
    r = np.random.default_rng(12)
    Q, V = unit_rows(r.normal(size=(40, 16))), unit_rows(np.repeat(r.normal(size=(4000, 16)), [2] * 50 + [1] * 3950, axis=0))
    S, k = np.floor(Q @ V.T * 1e6 + 0.5) / 1e6, 5
    for dtype, margin in ((np.float32, 2 * single_margin(16) + 2e-6), (np.float64, 2e-6)):
        top, left = TopK(40, k), 0
        for q, c, _ in reaching(Q.astype(dtype), V.astype(dtype), margin, 100, top, np.arange(40), least=0.1):
            top.push(q, c, S[q, c])
            left += len(q)
        qi, found, _ = top.items()
        assert all(list(found[qi == q]) == sorted(range(len(V)), key=lambda i: (-S[q, i], i))[:k] for q in range(40))
        assert left <= 40 * 2 * k


def test_cells_that_all_questions_probe_are_one_product(monkeypatch):
    r = np.random.default_rng(14)
    V, P = unit_rows(np.vstack([r.normal(size=(400, 8)), np.zeros((1, 8))])), unit_rows(np.vstack([r.normal(size=(30, 8)), np.zeros((1, 8))]))
    ids, cells, calls = np.arange(len(V)), srch.nearest_cells(V, P, 1, 6)[:, 0], []
    plain = srch.reaching
    monkeypatch.setattr(srch, "reaching", lambda *a: calls.append(a) or plain(*a))
    cfg = SearchConfig(k=4, threshold=0.1, exclude_self=True)

    def found(probes):
        calls.clear()
        scorer = srch._Scorer(V, ids, cfg, 1 << 20, probes)
        return sorted(zip(*(np.concatenate(x).tolist() for x in zip(*[*scorer.add(V, ids, cells), *scorer.rest()]))))

    want = found(None)
    for probes in (srch.Probes(srch.nearest_cells(V, P, 31, 6)), srch.WideProbes(V, P, 31, 6)):
        assert found(probes) == want and len(calls) == 1                  # not one for each of 30 cells
    few = found(srch.Probes(srch.nearest_cells(V, P, 9, 6)))
    assert few == found(srch.WideProbes(V, P, 9, 6)) and few != want and len(calls) > 1


def test_wide_probes_hold_bits_and_no_lists(monkeypatch):
    r = np.random.default_rng(15)
    V, P = unit_rows(np.vstack([r.normal(size=(203, 8)), np.zeros((1, 8))])), unit_rows(np.vstack([r.normal(size=(19, 8)), np.zeros((1, 8))]))
    monkeypatch.setattr(srch, "_MAX_CELLS", 200)                          # slices of a few questions
    tree = srch.pivot_tree(P[:19], beam=2)
    for pivots, n in ((P, 6), (P, 19), (P, 20), (tree, 6), (tree, 40)):
        lists, wide = srch.Probes(srch.nearest_cells(V, pivots, n, 6)), srch.WideProbes(V, pivots, n, 6)
        assert all(list(wide.questions(c)) == list(lists.questions(c)) for c in range(len(pivots)))
        assert wide.bits.nbytes == len(pivots) * 26
    monkeypatch.setattr(srch, "nearest_cells", lambda *a: pytest.fail("all cells are probed, whatever their order"))
    assert len(srch.WideProbes(V, P, 20, 6).questions(3)) == 203


def test_trained_recall_of_all_cells_in_blocks(spark, monkeypatch, tmp_path):
    """The last row probes every cell; with no probe list on the driver it finds all exact hits."""
    from grounded.plans import catalog
    r = np.random.default_rng(16)
    rows = [(i, [float(x) for x in r.normal(size=64)], 0) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(srch, "_MAX_PROBES", 1)
    monkeypatch.setattr(srch, "_WIDE_PROBE", 4)
    monkeypatch.setattr(srch, "_SCAN_QUESTIONS", 50)
    monkeypatch.setattr(srch, "_broadcast_scan", lambda *a, **k: pytest.fail("in blocks"))
    got = catalog.q_ann_recall_trained(spark, str(tmp_path))
    assert "CoGroups" not in got._jdf.queryExecution().executedPlan().toString()      # questions are held, vectors stream by
    few, more, every = sorted(got.collect(), key=lambda x: x.nprobe)
    assert (few.nprobe, more.nprobe) == (4, 8) and every.nprobe == 18                # cells: the root of 300, rounded up
    assert few.n_found <= more.n_found <= every.n_found == every.n_exact and every.recall == 1.0


@pytest.mark.parametrize("ids", ["long", "string"])
def test_hits_without_k_leave_a_task_as_they_are_found(spark, monkeypatch, ids):
    """No task holds all hits of a block: vectors stream by in small pieces, and hits go out a few at a time."""
    r = np.random.default_rng(18)
    rows = [(i, [float(x) for x in r.normal(size=4)]) for i in range(220)] + [(900, None), (901, [0.0] * 4), (902, [1.0] * 3), (None, [1.0] * 4)]
    rows += [rows[3], (4, rows[5][1])]                                        # repeated ids
    df = spark.createDataFrame(rows, "id long, v array<float>").withColumn("id", F.col("id").cast(ids))
    args = dict(q_id="id", q_vec=srch.VecCol("v", dim=4), c_id="id", c_vec=srch.VecCol("v", dim=4), cfg=SearchConfig(k=None, threshold=0.2, exclude_self=True))
    want = key(srch.nn_search(spark, df, df, dim_hint=4, **args))
    monkeypatch.setattr(srch, "_BLOCK_BYTES", 8 * 4 * 30)
    monkeypatch.setattr(srch, "_OUT_ROWS", 7)
    found = srch.block_search(spark, df, df, **args)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroups" not in plan
    assert len(want) > 5000 and key(found) == want
    indexed = srch.assign_cells(df, srch.VecCol("v", dim=4), np.eye(4))
    for nprobe in (4, 2):
        probed = dict(args, cfg=SearchConfig(k=None, threshold=0.2, nprobe=nprobe, exclude_self=True), pivots=np.eye(4))
        for wide in (1, 16):
            monkeypatch.setattr(srch, "_WIDE_PROBE", wide)
            a, b = key(srch.block_search(spark, df, df, **probed)), key(srch.block_search(spark, df, indexed, cell_col="cell", **probed))
            assert a == b and a == key(srch.nn_search(spark, df, df, dim_hint=4, **probed))
