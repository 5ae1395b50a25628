"""Changed, shortened and removed documents leave no old chunks behind."""

import pytest
from pyspark.sql import functions as F

from grounded.operators import documents, store
from grounded.operators import text as txt
from grounded.session import scratch_dir
from grounded.streaming import streams

DOCS = "path string, text string"


def points(rows):
    wins = txt.token_windows(rows, keys=["path"])
    return store.point_ids(wins, "path", None, "i", "chunk").select("point_id", "path", F.col("i").alias("chunk_no"), "chunk")


def stores(spark):
    root = scratch_dir(spark, "t-docs")
    pair = store.Collection(spark, root, "c"), store.Collection(spark, root, "m")
    for c in pair:
        c.ensure(truncate=True, dim=0)
    return pair


def seen(df):
    return sorted((r.path, r.chunk_no, r.chunk) for r in df.collect())


def fresh(spark, docs):
    return seen(points(spark.createDataFrame(docs, DOCS)))


LONG = " ".join(f"w{i}" for i in range(1000))


def test_snapshots_replace_each_other(spark):
    col, man = stores(spark)
    states = [
        [("a", "one"), ("b", LONG), ("c", "three"), ("d", "four")],
        [("a", "one, edited"), ("b", "w0 w1"), ("c", "three"), ("e", "five")],          # edited, shortened, same, removed, new
        [("a", "one"), ("b", LONG), ("c", ""), ("d", "four"), ("e", None)],             # back again; emptied
        [],
        [("d", "four")],
    ]
    told = [{"a": "new", "b": "new", "c": "new", "d": "new"}, {"a": "changed", "b": "changed", "d": "removed", "e": "new"},
            {"a": "changed", "b": "changed", "c": "changed", "d": "new", "e": "changed"}, dict.fromkeys("abcde", "removed"), {"d": "new"}]
    for docs, want in zip(states, told):
        df = spark.createDataFrame(docs, DOCS)
        assert {r.path: r.state for r in documents.sync(df, points, col, man).collect()} == want
        assert seen(documents.live(col, man)) == fresh(spark, docs)
        assert documents.sync(df, points, col, man).count() == 0                        # nothing left to do


def test_unchanged_documents_are_not_stored_again(spark):
    col, man = stores(spark)
    asked = []

    def counted(rows):
        asked.append(sorted(r.path for r in rows.collect()))
        return points(rows)

    documents.sync(spark.createDataFrame([("a", "x"), ("b", "y")], DOCS), counted, col, man)
    documents.sync(spark.createDataFrame([("a", "x"), ("b", "z")], DOCS), counted, col, man)
    assert asked == [["a", "b"], ["b"]]
    assert {r.path: r.v for r in documents.live(col, man).collect()} == {"a": 1, "b": 2}


def test_repeated_paths_null_paths_and_odd_columns(spark):
    col, man = stores(spark)
    rows = [("a", "x", 1), ("a", "y", 2), ("a", "y", 3), (None, "z", 4), ("b", None, 5)]
    df = spark.createDataFrame(rows, "path string, text string, digest int")
    documents.sync(df, points, col, man)
    got = seen(documents.live(col, man))
    assert len(got) == 1 and got[0][0] == "a" and got[0][2] in ("x", "y")
    documents.sync(df.orderBy(F.desc("digest")), points, col, man)
    assert seen(documents.live(col, man)) == got


def test_partial_batches_and_a_crash_between_both_commits(spark, monkeypatch):
    col, man = stores(spark)
    documents.sync(spark.createDataFrame([("a", "one"), ("b", "two")], DOCS), points, col, man)
    documents.sync(spark.createDataFrame([("a", None), ("c", "three"), ("z", None)], DOCS), points, col, man, whole=False)
    assert [x[0] for x in seen(documents.live(col, man))] == ["b", "c"]
    with monkeypatch.context() as m:
        m.setattr(man, "upsert", lambda *a, **k: (_ for _ in ()).throw(IOError("lost")))
        with pytest.raises(IOError):
            documents.sync(spark.createDataFrame([("b", "two, edited")], DOCS), points, col, man, whole=False)
    documents.sync(spark.createDataFrame([("b", "two, edited")], DOCS), points, col, man, whole=False)
    assert [x[2] for x in seen(documents.live(col, man))] == ["two, edited", "three"]


def test_compaction_keeps_what_is_live(spark, monkeypatch):
    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    col, man = stores(spark)
    for i in range(8):
        docs = [(f"p{j}", f"text {j} of round {i if j % 2 else 0}") for j in range(i % 3, 6)]
        documents.sync(spark.createDataFrame(docs, DOCS), points, col, man)
        assert seen(documents.live(col, man)) == fresh(spark, docs)


def test_stream_of_versions(spark, tmp_path):
    root = scratch_dir(spark, "t-root")
    schema = "doc_id long, source string, text string"
    src = str(tmp_path / "documents.parquet")
    col, man = stores(spark)
    made = []
    for k, rows in enumerate([[(1, "s", "old text"), (2, "s", "stays")], [(1, "s", "new text"), (3, "s", "more")], [(2, "s", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        out = streams.stream_ingest(spark, streams.table_stream(spark, str(tmp_path), "documents"), col, root=root, manifest=man)
        made.append(sorted(r.chunk for r in out.collect()))
    assert made == [["old text", "stays"], ["more", "new text", "stays"], ["more", "new text"]]


def test_two_writers_never_share_a_version(spark):
    col, _ = stores(spark)
    other = store.Collection(spark, col.path.rsplit("/", 1)[0], "c")
    rows = lambda k: spark.createDataFrame([(k, k)], "point_id string, label string")
    col.upsert(rows("a"))
    held = other._claim()                                   # a writer that has not committed yet
    assert col.upsert(rows("b")) == held + 1
    assert col.compact() == 1                               # nothing behind the open claim is merged
    assert sorted(r.label for r in col.current().collect()) == ["a", "b"]
    rows("c").selectExpr("point_id AS _key", "point_id", "label", f"{held} AS v").write.parquet(col._folder("delta", held))
    col._fs.delete(col._Path(col._claimed(held)), False)
    assert sorted(r.label for r in col.current().collect()) == ["a", "b", "c"]
    assert col.compact() == held + 1 and sorted(r.label for r in col.current().collect()) == ["a", "b", "c"]


def test_keys_decide_what_is_shuffled(spark, monkeypatch):
    """Stored points: repeated and null keys leave one row each, as without ``stored``; later rows win in both ways of merging."""
    rows = [("a", 1), ("a", 2), (None, 3), (None, 4), ("b", 5), ("c", 6), ("c", 6)]
    later = [("b", 7), (None, 8), ("d", 9)]
    got = []
    for stored, most in ((False, 0), (True, store.MAX_BROADCAST_ROWS), (True, 0)):
        monkeypatch.setattr(store, "MAX_BROADCAST_ROWS", most)
        col = store.Collection(spark, scratch_dir(spark, "t-keys"), "c")
        col.ensure(truncate=True, dim=0)
        for part in (rows, later):
            col.upsert(spark.createDataFrame(part, "point_id string, label int"), stored=stored)
        got.append(sorted(((r.point_id, r.label, r.v) for r in col.current().collect()), key=str))
    assert got[0] == got[1] == got[2] and len(got[0]) == 5
    assert {(None, 8, 2), ("b", 7, 2), ("d", 9, 2), ("c", 6, 1)} < set(got[0])


def test_a_plain_snapshot_moves_no_text(spark):
    """Without repeated paths and unchanged documents the texts are not joined, and stored points are not grouped."""
    plans, root = [], scratch_dir(spark, "t-plain")
    col, man = store.Collection(spark, root, "points"), store.Collection(spark, root, "manifest")
    col.ensure(truncate=True, dim=0)
    man.ensure(truncate=True, dim=0)

    def points(rows):
        plans.append(rows._jdf.queryExecution().toString())
        return rows.selectExpr("path AS point_id", "path", "text")

    docs = spark.createDataFrame([("a", "one"), ("b", "two")], "path string, text string")
    documents.sync(docs, points, col, man, stored=True)
    documents.sync(docs.selectExpr("path", "if(path = 'a', 'new', text) AS text"), points, col, man, stored=True)
    assert "Join" not in plans[0] and "Join" in plans[1]
    assert sorted((r.path, r.text, r.v) for r in documents.live(col, man).collect()) == [("a", "new", 2), ("b", "two", 1)]
