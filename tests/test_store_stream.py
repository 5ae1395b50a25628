"""Collections (lifecycle, idempotent upsert), streams equal batch."""

import os

from pyspark.sql import functions as F

from grounded.operators import store
from grounded.session import scratch_dir
from grounded.streaming import streams

from conftest import SF_SMALL


def test_collection_lifecycle_and_upsert(spark):
    col = store.Collection(spark, scratch_dir(spark, "t-col"), "c")
    assert col.ensure(truncate=False, dim=2) == "created"
    assert col.ensure(truncate=False, dim=2) == "kept"
    pts = spark.createDataFrame([("a", 1), ("b", 1)], "point_id string, label int")
    assert col.upsert(pts) == 1
    upd = spark.createDataFrame([("b", 2), ("c", 2)], "point_id string, label int")
    assert col.upsert(upd, batch=("s", 0)) == 2
    assert col.upsert(upd.withColumn("label", F.lit(99)), batch=("s", 0)) == 2     # replayed batch: no-op
    got = {(r.point_id, r.label, r.v) for r in col.current().collect()}
    assert got == {("a", 1, 1), ("b", 2, 2), ("c", 2, 2)}
    assert col.ensure(truncate=True, dim=2) == "recreated" and col.current() is None


def test_batches_of_two_streams_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(store, "COMPACT_AFTER", 3)
    col = store.Collection(spark, scratch_dir(spark, "t-col"), "c")
    col.ensure(truncate=True, dim=2)
    want = {}
    for i in range(10):
        rows = [(f"k{i % 4}", i), (f"own{i}", i)]
        want.update(dict(rows))
        assert col.upsert(spark.createDataFrame(rows, "point_id string, label int"), batch=(f"stream{i % 2}", i // 2)) == i + 1
    assert {r.point_id: r.label for r in col.current().collect()} == want
    # the same batch number of another stream is not the same batch
    col.upsert(spark.createDataFrame([("z", 1), ("z", 2)], "point_id string, label int"), batch=("stream2", 0))
    assert col.current().where("point_id = 'z'").count() == 1 and col.current().count() == len(want) + 1
    assert len(col._folders("base")) <= 2
    col.reject(spark.createDataFrame([("bad", "why")], "point_id string, reason string"))
    assert spark.read.parquet(col.path + "/_rejects").count() == 1


def _split_table(spark, name, root, parts, order=None):
    """A driver table as a folder of part files in the given order."""
    import shutil
    df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
    df = df.orderBy(order) if order is not None else df
    rows = df.collect()
    path = f"{root}/{name}.parquet"
    os.makedirs(path)
    cuts = [len(rows) * i // parts for i in range(parts + 1)]
    for i in reversed(range(parts)):
        tmp = f"{root}/tmp{i}"
        spark.createDataFrame(rows[cuts[i]:cuts[i + 1]], df.schema).coalesce(1).write.parquet(tmp)
        part = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        shutil.copy(f"{tmp}/{part}", f"{path}/part-{i}.parquet")
        os.utime(f"{path}/part-{i}.parquet", (1000 + (parts - i) * 10,) * 2)        # the last rows arrive first
    return path


def test_request_rate_on_files_out_of_time_order(spark, tmp_path):
    root = str(tmp_path)
    _split_table(spark, "events", root, 3, "ts")
    got = streams.request_rate(spark, streams.table_stream(spark, root, "events"))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    exp = ev.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert sorted((r.w, r.event_type, r.n) for r in exp.collect()) == sorted((r.window_start, r.event_type, r.n) for r in got.collect())


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    """A second run with the same root takes new files only; a second stream adds to the collection."""
    root, src = scratch_dir(spark, "t-root"), str(tmp_path)
    path = _split_table(spark, "documents", src, 3, "doc_id")
    late = f"{src}/late.parquet"
    os.rename(f"{path}/part-0.parquet", late)
    col = store.Collection(spark, scratch_dir(spark, "t-col"), "c")
    col.ensure(truncate=True, dim=768)
    first = streams.stream_ingest(spark, streams.table_stream(spark, src, "documents"), col, root=root).count()
    versions = col.versions()
    os.rename(late, f"{path}/part-9.parquet")
    both = streams.stream_ingest(spark, streams.table_stream(spark, src, "documents"), col, root=root)
    assert len(col.versions()) == len(versions) + 1 and both.count() > first
    whole = store.Collection(spark, scratch_dir(spark, "t-col"), "w")
    whole.ensure(truncate=True, dim=768)
    want = streams.stream_ingest(spark, streams.table_stream(spark, SF_SMALL, "documents"), whole)
    ids = lambda df: sorted(r.point_id for r in df.select("point_id").collect())
    assert ids(both) == ids(want)
    # another stream, other documents, the same collection: nothing is skipped
    more = spark.createDataFrame([(10 ** 6 + i, f"quite new words {i}", "en", "s", 10) for i in range(5)],
                                 spark.read.parquet(f"{SF_SMALL}/documents.parquet").schema)
    more.coalesce(1).write.parquet(f"{src}/more/documents.parquet")
    again = streams.stream_ingest(spark, streams.table_stream(spark, f"{src}/more", "documents"), col)
    assert again.count() == len(ids(want)) + 5


def test_latest_wins_many_versions(spark):
    rows = [(1, v, f"x{v}") for v in range(50)] + [(2, 3, "y")]
    df = spark.createDataFrame(rows, "id long, v int, payload string")
    assert sorted(tuple(r) for r in store.latest_wins(df, "id", "v").collect()) == [(1, 49, "x49"), (2, 3, "y")]


def test_dim_split(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id long, e array<double>")
    ok, bad = store.split_by_dim(df, "e", 2)
    assert [r.id for r in ok.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3]


def test_stream_answers_equal_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    cols = ["item_id", "doc_id", "i", "score", "has_context", "verdict", "status", "body"]
    batch = sorted(tuple(r) for r in qs["grounded_answer"](spark, SF_SMALL).select(*cols).collect())
    stream = sorted(tuple(r) for r in qs["stream_answers"](spark, SF_SMALL).select(*cols).collect())
    assert batch == stream and len(batch) > 0


def test_request_rate_matches_batch(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    exp = (ev.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n")))
    got = streams.request_rate(spark, streams.table_stream(spark, SF_SMALL, "events"))
    assert sorted((r.w, r.event_type, r.n) for r in exp.collect()) == \
        sorted((r.window_start, r.event_type, r.n) for r in got.collect())


def test_stream_ingest_equals_batch(spark):
    import __spark_entry__ as E
    qs = E.queries()
    cols = ["point_id", "path", "chunk_no", "chunk_md5", "dim", "vec_sum"]
    batch = sorted(tuple(r) for r in qs["ingest_corpus"](spark, SF_SMALL).select(*cols).collect())
    stream = sorted(tuple(r) for r in qs["stream_ingest"](spark, SF_SMALL).select(*cols).collect())
    assert batch == stream and len(batch) > 0


def test_request_rate_independent_of_session_time_zone(spark):
    from grounded.functions.time import instant_as_utc_ntz, ntz_as_utc_instant
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")     # +05:30
        got = streams.request_rate(spark, streams.table_stream(spark, SF_SMALL, "events"))
        rows = sorted((r.window_start, r.event_type, r.n) for r in got.collect())
        rt = spark.createDataFrame([("2024-03-10 23:59:59.123456",)], "s string").select(
            F.col("s").cast("timestamp_ntz").alias("w"))
        back = rt.select(instant_as_utc_ntz(ntz_as_utc_instant(F.col("w"))).alias("b"), "w").first()
        assert back.b == back.w
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    exp = (ev.groupBy(F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz").alias("w"), "event_type")
           .agg(F.count(F.lit(1)).alias("n")))
    assert rows == sorted((r.w, r.event_type, r.n) for r in exp.collect())


def test_stream_pack_blocks_across_micro_batches(spark):
    import random
    rng = random.Random(17)
    docs = {d: ["p" * rng.choice([0, 5, 700, 1500, 2999, 3000, 4000]) for _ in range(rng.randint(1, 9))]
            for d in range(12)}
    root = scratch_dir(spark, "t-pages")
    for lo in range(0, 9, 3):                      # pages arrive in order, three turns per file
        rows = [(d, t, p) for d, ps in docs.items() for t, p in enumerate(ps) if lo <= t < lo + 3]
        if rows:
            (spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(1)
             .write.mode("overwrite").parquet(f"{root}/f{lo:02d}"))
    # the file source picks files by modification time: make the arrival order explicit
    import glob
    import os
    import time as _time
    base = _time.time() - 100
    for lo in range(0, 9, 3):
        for f in glob.glob(f"{root.replace('file:', '')}/f{lo:02d}/*.parquet"):
            os.utime(f, (base + lo, base + lo))
    schema = "conv_id long, turn long, text string"
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(root))
    got = streams.stream_pack_blocks(spark, stream, block_bytes=3000)

    def fold(pages, T=3000):
        out, buf = [], ""
        for p in pages:
            buf += p
            if len(buf.encode()) >= T:
                out.append(buf)
                buf = ""
        return out + ([buf] if buf else [])

    exp = sorted((d, i, b) for d, ps in docs.items() for i, b in enumerate(fold(ps)))
    assert sorted((r.conv_id, r.block_no, r.blk) for r in got.collect()) == exp
