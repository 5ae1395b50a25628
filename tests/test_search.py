"""Nearest-neighbour search: edge vectors, ties, IVF with every cell probed, quantised pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from grounded.config import SearchConfig
from grounded.functions.vectors import TopK, densify_buckets
from grounded.operators import search as srch

VC = srch.VecCol("v")


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


def brute(qs, cs, k, thr, excl=False):
    out = []
    for qi, q in qs:
        q = np.asarray(q, float)
        sc = []
        for ci, c in cs:
            c = np.asarray(c, float)
            if len(c) != len(q) or excl and qi == ci:
                continue
            n = np.linalg.norm(q) * np.linalg.norm(c)
            if n == 0:
                continue
            s = float(np.floor(q @ c / n * 1e6 + 0.5) / 1e6)
            if thr is None or s >= thr:
                sc.append((-s, ci))
        sc.sort()
        out += [(qi, ci, -s, r + 1) for r, (s, ci) in enumerate(sc[:k] if k else sc)]
    return sorted(out)


def run(spark, qs, cs, cfg):
    res = srch.nn_search(spark, frame(spark, qs), frame(spark, cs), q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                         cfg=cfg, dim_hint=3)
    return sorted((r.qid, r.id, r.score, r.rk) for r in res.collect())


def test_edge_vectors(spark):
    qs = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 0.0])]
    cs = [(10, [1.0, 0.1, 0.0]), (11, [1.0, 0.1, 0.0]), (12, [0.0, 0.0, 0.0]), (13, [1.0, 1.0]),
          (14, [0.5, 0.5, 0.0]), (15, [-1.0, 0.0, 0.0])]
    cfg = SearchConfig(k=2, threshold=0.3)
    assert run(spark, qs, cs, cfg) == brute(qs, cs, 2, 0.3)
    # duplicate vectors tie: lower id first
    got = run(spark, qs, cs, cfg)
    assert [r[1] for r in got if r[0] == 1] == [10, 11]


def test_empty_collection(spark):
    qs = [(1, [1.0, 0.0, 0.0])]
    res = srch.nn_search(spark, frame(spark, qs), frame(spark, []), q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                         cfg=SearchConfig())
    assert res.count() == 0


@pytest.mark.parametrize("k,thr", [(1, 0.3), (5, None), (None, 0.0)])
def test_random_against_brute(spark, k, thr):
    rng = np.random.default_rng(5)
    qs = [(i, rng.normal(size=3).tolist()) for i in range(7)]
    cs = [(100 + i, rng.normal(size=3).tolist()) for i in range(60)]
    assert run(spark, qs, cs, SearchConfig(k=k, threshold=thr)) == brute(qs, cs, k, thr)


def test_question_batches_union(spark):
    rng = np.random.default_rng(9)
    qs = [(i, rng.normal(size=3).tolist()) for i in range(40)]
    cs = [(100 + i, rng.normal(size=3).tolist()) for i in range(50)]
    cfg = SearchConfig(k=3, threshold=None, max_broadcast_bytes=8 * 3 * 10)   # forces several batches
    assert run(spark, qs, cs, cfg) == brute(qs, cs, 3, None)


def test_ivf_all_cells_equals_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(80)]
    df = frame(spark, rows)
    piv = srch.pivot_matrix(srch.hash_pivots(df, "id", "v", 6), VC)
    cfg = SearchConfig(k=5, threshold=0.3, nprobe=6, exclude_self=True)
    ivf = srch.ivf_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, pivots=piv, dim_hint=3)
    exact = srch.nn_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, dim_hint=3)
    key = lambda d: sorted((r.qid, r.id, r.score) for r in d.collect())
    assert key(ivf) == key(exact)
    # fewer probes: a subset of the exact candidates per question
    few = srch.ivf_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                          cfg=SearchConfig(k=None, threshold=0.3, nprobe=2, exclude_self=True), pivots=piv,
                          dim_hint=3)
    full = srch.nn_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                          cfg=SearchConfig(k=None, threshold=0.3, exclude_self=True), dim_hint=3)
    assert {(r.qid, r.id) for r in few.collect()} <= {(r.qid, r.id) for r in full.collect()}


def test_assign_cells_indexed_only(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [0.0, 1.0])]
    df = frame(spark, rows)
    piv = np.array([[1.0, 0, 0], [0, 1.0, 0]])
    got = {r.id: r.cell for r in srch.assign_cells(df, VC, piv).collect()}
    assert got == {1: 0, 2: None, 3: None}


def test_topk_ties_and_threshold():
    t = TopK(1, 2)
    t.add(np.array([[0.5, 0.5, 0.5]]), np.array([7, 3, 5]))
    qi, ids, sc = t.items()
    assert list(ids) == [3, 5]


def test_densify_hashed():
    m = densify_buckets([[1, 1, 2], [], None], 4)
    assert np.allclose(np.linalg.norm(m[0]), 1.0) and not m[1].any() and not m[2].any()
    assert m[0][1] > m[0][2] > 0


def test_quantized_matches_bruteforce_rescore(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(50)]
    df = frame(spark, rows)
    res = srch.quantized_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                                cfg=SearchConfig(k=3, threshold=None, exclude_self=True), candidates=50, dim_hint=8)
    # with every vector a candidate the rescored top-k is the exact top-k
    assert sorted((r.qid, r.id, r.score) for r in res.collect()) == \
        sorted((a, b, c) for a, b, c, _ in brute(rows, rows, 3, None, excl=True))


def test_ivf_cogroup_salted_equals_broadcast(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    # a hot cell: a third of the vectors sit next to pivot 0
    rows += [(1000 + i, (np.array([5.0, 0, 0, 0]) + rng.normal(scale=0.3, size=4)).tolist()) for i in range(60)]
    df = frame(spark, rows)
    piv = srch.pivot_matrix(srch.hash_pivots(df, "id", "v", 5), VC)
    cfg = SearchConfig(k=4, threshold=0.2, nprobe=2, exclude_self=True)
    a = srch.ivf_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, pivots=piv, dim_hint=4)
    b = srch.block_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, pivots=piv,
                          block_bytes=7 * 4 * 8)
    key = lambda d: sorted((r.qid, r.id, r.score, r.rk) for r in d.collect())
    assert key(a) == key(b) and len(key(a)) > 0


def test_project_hits_with_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0])]
    df = frame(spark, rows).withColumn("label", F.col("id") * 10)
    hits = srch.nn_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                          cfg=SearchConfig(k=1, threshold=0.3, exclude_self=True), dim_hint=3)
    out = srch.project_hits(hits, df, "id", ["label"], "v", with_vectors=True).collect()
    assert {(r.qid, r.id, r.label) for r in out} == {(1, 2, 20), (2, 1, 10)}
    assert all(r.v is not None for r in out)
    assert "v" not in srch.project_hits(hits, df, "id", ["label"]).columns


def test_search_dispatch_modes(spark):
    from dataclasses import replace
    rng = np.random.default_rng(21)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(60)] + [(999, [0.0, 0.0, 0.0])]
    df = frame(spark, rows)
    piv = srch.pivot_matrix(srch.hash_pivots(df, "id", "v", 4), VC)
    base = SearchConfig(k=3, threshold=0.2, nprobe=4, exclude_self=True)
    run_ = lambda cfg, p=piv: sorted((r.qid, r.id, r.score) for r in srch.search(
        spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, pivots=p, dim_hint=3).collect())
    exact = run_(replace(base, exact=True))
    assert run_(base) == exact                                   # all cells probed
    assert run_(replace(base, indexed_only=True)) == exact       # zero vector has no cell and never scores
    assert run_(replace(base, max_broadcast_bytes=16)) == exact  # cogroup form
    assert run_(replace(base, exact=False), None) == exact       # no index: exact fallback


def test_kmeans_pivots_all_cells_equals_exact(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(4, 5))
    rows = [(i, (centers[i % 4] + rng.normal(scale=0.2, size=5)).tolist()) for i in range(80)]
    df = frame(spark, rows)
    piv = srch.kmeans_pivots(df, "v", 4)
    assert piv.shape == (4, 5) and np.allclose(np.linalg.norm(piv, axis=1), 1.0)
    cfg = SearchConfig(k=3, threshold=0.5, nprobe=4, exclude_self=True)
    key = lambda d: sorted((r.qid, r.id, r.score) for r in d.collect())
    ivf = srch.ivf_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, pivots=piv, dim_hint=5)
    exact = srch.nn_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, dim_hint=5)
    assert key(ivf) == key(exact)
    # clustered data: one probe already finds nearly every true neighbour
    one = srch.ivf_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                          cfg=SearchConfig(k=3, threshold=0.5, nprobe=1, exclude_self=True), pivots=piv, dim_hint=5)
    found = {(a, b) for a, b, _ in key(one)}
    truth = {(a, b) for a, b, _ in key(exact)}
    assert len(found & truth) >= 0.9 * len(truth)


def test_chunk_ids_exact_for_large_doc_ids(spark):
    from grounded.operators import answer as ans
    big = (1 << 39) - 1
    df = spark.createDataFrame([(big, 5), (123456789012, 0)], "doc_id long, i long")
    rows = ans.chunk_ids(df).select("doc_id", "i", F.shiftright("chunk_id", ans.CHUNK_ID_BITS).alias("d"),
                                    F.col("chunk_id").bitwiseAND(F.lit(ans.CHUNK_ID_SHIFT - 1)).alias("j")).collect()
    assert all(r.doc_id == r.d and r.i == r.j for r in rows)
    with pytest.raises(Exception):
        ans.chunk_ids(spark.createDataFrame([(1 << 40, 0)], "doc_id long, i long")).collect()


def test_quantized_batches_equal_single(spark):
    from dataclasses import replace
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)]
    df = frame(spark, rows)
    cfg = SearchConfig(k=3, threshold=None, exclude_self=True)
    run_ = lambda c: sorted((r.qid, r.id, r.score, r.rk) for r in srch.quantized_search(
        spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=c, candidates=8, dim_hint=6).collect())
    assert run_(cfg) == run_(replace(cfg, max_broadcast_bytes=6 * 8 * 7))


def test_broadcast_only_within_counted_bound(spark):
    from grounded import session
    df = spark.range(10)
    small = session.broadcast_if_bounded(df, 10, max_rows=10)
    big = session.broadcast_if_bounded(df, 11, max_rows=10)
    assert "broadcast" in small.join(spark.range(3), "id")._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in big.join(spark.range(3), "id")._jdf.queryExecution().analyzed().toString().lower()


MIXED = [(10, [1.0, 0.1, 0.0]), (11, [1.0, 0.1, 0.0]), (12, [0.5, 0.5, 0.0]), (13, [9.0] * 7), (14, [1.0, 1.0]), (15, None),
         (16, [0.0, 0.0, 0.0]), (17, []), (None, [1.0, 0.0, 0.0])]


@pytest.mark.parametrize("order", [1, -1])
def test_a_row_of_another_width_is_the_only_one_left_out(spark, order):
    qs = [(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.2]), (3, [1.0] * 9), (4, None)]
    cfg = SearchConfig(k=5, threshold=0.1)
    good = [(i, v) for i, v in MIXED if i is not None and v is not None and len(v) == 3]
    want = brute([q for q in qs if q[1] is not None and len(q[1]) == 3], good, 5, 0.1)
    cs, qs = MIXED[::order], qs[::order]
    vc = srch.VecCol("v", dim=3)
    q, c = frame(spark, qs).coalesce(1), frame(spark, cs).coalesce(1)
    for small in (1 << 20, 1):                                # broadcast and block form
        got = srch.nn_search(spark, q, c, q_id="id", q_vec=vc, c_id="id", c_vec=vc, dim_hint=3,
                             cfg=SearchConfig(k=5, threshold=0.1, max_broadcast_bytes=small))
        assert sorted((r.qid, r.id, r.score, r.rk) for r in got.collect()) == want
    assert run(spark, qs[:2] if order == 1 else qs[2:], cs, cfg) == want     # width from the questions
    cells = {r.id: r.cell for r in srch.assign_cells(c, vc, np.eye(3)).collect()}
    assert {i for i, cell in cells.items() if cell is None} == {13, 14, 15, 16, 17}
    rejects = {(r.id, r.reason) for r in srch.unscorable(c, "id", vc, 3).collect()}
    assert rejects == {("13", "vector size is not 3"), ("14", "vector size is not 3"), ("15", "no vector"), ("16", "zero vector"),
                       ("17", "vector size is not 3"), (None, "no id")}


def test_string_ids(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.9, 0.1]), ("long-name", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    vc = srch.VecCol("v", dim=2)
    piv = np.eye(2)
    for bound in (1 << 20, 1):
        for pivots in (None, piv):
            got = srch.search(spark, df, df, q_id="id", q_vec=vc, c_id="id", c_vec=vc, pivots=pivots, dim_hint=2,
                              cfg=SearchConfig(k=2, threshold=0.5, nprobe=2, exclude_self=True, max_broadcast_bytes=bound))
            assert sorted((r.qid, r.id, r.rk) for r in got.collect()) == [("a", "b", 1), ("a", "c", 2), ("b", "a", 1), ("b", "c", 2),
                                                                          ("c", "a", 1), ("c", "b", 2)]


@pytest.mark.parametrize("name", ["search_knn_exact", "search_filtered", "search_project", "search_best_hit", "search_threshold",
                                  "search_indexed_only", "search_ann_ivf", "search_ivf_index", "search_quantized"])
def test_queries_without_any_broadcast(spark, monkeypatch, name):
    """The same rows when no question fits the broadcast bound."""
    from dataclasses import replace

    from grounded.plans import catalog
    sf = "/root/testdata/sf0.001"
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    want = key(catalog.QUERIES[name](spark, sf))
    tiny = lambda *a, **k: replace(SearchConfig(*a, **k), max_broadcast_bytes=1)
    monkeypatch.setattr(catalog, "SearchConfig", tiny)
    monkeypatch.setattr(catalog, "KNN", replace(catalog.KNN, max_broadcast_bytes=1))
    monkeypatch.setattr(srch, "_BLOCK_BYTES", 100 * 64 * 8)
    assert key(catalog.QUERIES[name](spark, sf)) == want and want


def test_int8_column_is_the_coarse_pass(spark):
    df = frame(spark, [(1, [3.0, 4.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0]), (4, None)])
    assert {r.id: r.v8 for r in srch.with_int8(df, "v").collect()} == {1: [76, 102], 2: [-127, 0], 3: None, 4: None}


def test_score_matrix_slicing_does_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(23)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(70)]
    df = frame(spark, rows)
    piv = srch.pivot_matrix(srch.hash_pivots(df, "id", "v", 3), VC)
    cfg = SearchConfig(k=3, threshold=0.1, nprobe=2, exclude_self=True)
    key = lambda d: sorted((r.qid, r.id, r.score, r.rk) for r in d.collect())

    def all_three():
        return (key(srch.nn_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, dim_hint=4)),
                key(srch.quantized_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC,
                                          cfg=SearchConfig(k=3, threshold=None, exclude_self=True), candidates=9,
                                          dim_hint=4)),
                key(srch.block_search(spark, df, df, q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=cfg, pivots=piv)))

    whole = all_three()
    monkeypatch.setattr(srch, "_MAX_CELLS", 50)        # a few rows per score matrix
    assert all_three() == whole
