"""Structured Streaming jobs.

Every sink is idempotent: ``foreachBatch`` writes batch ``b`` to its own directory,
or upserts it under the name (stream, ``b``), so a micro-batch replayed after a
failure changes nothing.  ``root`` is the folder of a stream's checkpoint and output:
with the same ``root`` a restarted stream goes on where it stopped; without one it
gets a new folder under the shared checkpoint folder."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grounded.config import EmbedConfig
from grounded.functions.time import instant_as_utc_ntz, ntz_as_utc_instant
from grounded.operators import answer as ans
from grounded.operators import documents
from grounded.operators import embed as emb
from grounded.operators import store
from grounded.operators import text as txt
from grounded.session import materialize, remove_path, scratch_dir


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int = 1) -> DataFrame:
    """Stream the files of one driver table, a single file or a folder of part files (new files are
    picked up as they land)."""
    from grounded.session import ship_package
    ship_package(spark)
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return reader.option("recursiveFileLookup", "true").parquet(path)


def _run(writer, ckpt: str):
    q = writer.option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def stream_answers(spark: SparkSession, questions: DataFrame, docs: DataFrame, q_key: str = "item_id",
                   q_text: str = "text", root: str | None = None) -> DataFrame:
    """Questions arrive as a stream; each micro-batch runs the grounded
    pipeline against a static index and lands in ``batch=<id>``.

    The chunk index (window ids + hashed tokens) is written once before the
    stream starts, so a micro-batch only scans it instead of re-tokenising the
    corpus."""
    root = root or scratch_dir(spark, "stream-answers")
    out = f"{root}/out"
    index = ans.build_chunk_index(spark, docs, scratch_dir(spark, "stream-index"))

    def handle(batch: DataFrame, batch_id: int):
        res = ans.grounded_answer(batch.sparkSession, batch.select(q_key, q_text), docs, q_key=q_key, q_text=q_text,
                                  index=index)
        res.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(questions.writeStream.foreachBatch(handle), f"{root}/checkpoint")
    return spark.read.parquet(out).drop("batch")


def stream_ingest(spark: SparkSession, docs: DataFrame, collection: store.Collection,
                  cfg: EmbedConfig = EmbedConfig(), root: str | None = None, name: str = "",
                  manifest: store.Collection | None = None) -> DataFrame:
    """New documents -> windows -> points -> embed -> upsert, one version per micro-batch.

    With a ``manifest`` (``operators.documents``) a document that arrives again replaces its earlier version, one with a null
    text is removed, and one that has not changed is skipped; the result is then what is live.  Rejected vectors go to ``<root>/rejects/batch=<id>``.  ``name`` (``root`` unless given) tells the batches
    of this stream from those of others into the same collection."""
    root = root or scratch_dir(spark, "stream-ingest")

    def handle(batch: DataFrame, batch_id: int):
        d = batch.withColumn("path", F.concat_ws("/", "source", F.col("doc_id").cast("string")))
        batch_name = (name or root, batch_id)

        def points(rows: DataFrame) -> DataFrame:
            good, rejected = ingest_points(store.chunk_points(txt.token_windows(rows, keys=["doc_id", "path"])), cfg)
            rejected.write.mode("overwrite").parquet(f"{root}/rejects/batch={batch_id}")
            return good

        if manifest is None:
            collection.upsert(points(d), batch=batch_name, stored=True)
        else:
            documents.sync(d, points, collection, manifest, batch=batch_name, whole=False, stored=True)

    _run(docs.writeStream.foreachBatch(handle), f"{root}/checkpoint")
    return collection.current() if manifest is None else documents.live(collection, manifest)


def ingest_points(points: DataFrame, cfg: EmbedConfig = EmbedConfig(), float32: bool = True) -> tuple[DataFrame, DataFrame]:
    """O06 + O12: points with their text and vector, and the reject frame (point, path, reason).

    Vectors are computed once and written to the shared folder; both frames read them there."""
    vecs = emb.dense_embed(points, "embed_text", cfg=EmbedConfig(dim=cfg.dim, strip_newlines=False), float32=float32)
    vecs = materialize(vecs.drop("embed_text"), "ingest-vectors")
    good, bad = store.split_by_dim(vecs, "embedding", cfg.dim)
    return good, bad.select("point_id", "path", "reason")


def request_rate(spark: SparkSession, events: DataFrame, window: str = "1 hour", root: str | None = None) -> DataFrame:
    """Requests per window and type, whatever order the events arrive in.

    Every micro-batch is counted by itself into ``batch=<id>``, and the read side adds the counts of a
    window up.  No state is kept between batches, so none has to expire and no late event is lost."""
    root = root or scratch_dir(spark, "request-rate")
    out = f"{root}/out"

    def handle(batch: DataFrame, batch_id: int):
        (batch.groupBy(F.window(ntz_as_utc_instant(F.col("ts")), window).alias("w"), "event_type")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"))
         .select(instant_as_utc_ntz(F.col("w.start")).alias("window_start"), "event_type", "n", "total_value")
         .write.mode("overwrite").parquet(f"{out}/batch={batch_id}"))

    _run(events.writeStream.foreachBatch(handle), f"{root}/checkpoint")
    secs = F.lit(float(_window_seconds(window)))
    return (spark.read.parquet(out).groupBy("window_start", "event_type")
            .agg(F.sum("n").alias("n"), F.round(F.sum("total_value"), 6).alias("total_value"))
            .select("window_start", "event_type", "n", F.round(F.col("n") / secs, 6).alias("qps"), "total_value"))


def request_rate_final(spark: SparkSession, events: DataFrame, window: str = "1 hour", delay: str = "2 hours",
                       root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S03 in event time: every window is reported once, when it is over, and events that come after that are listed.

    The watermark is the latest event time of the micro-batches before, less ``delay``.  A window closes when the watermark
    reaches its end: its counts go to the final windows, and an event of it that arrives later goes to the late events with the
    watermark that it missed.  Events without a time are late events without a window.

    What has to be remembered between micro-batches is written with each of them: the counts of the windows that are
    still open (windows within ``delay`` of the latest event, however many events they hold) and the watermark.  A replayed batch
    reads what its predecessor left and overwrites its own output, so nothing is counted twice; older state is deleted.
    Spark's own windowed aggregation expires its state the same way but drops late rows, and a list of them is asked for here.

    Returns ``(final, late)``: ``(window_start, event_type, n, qps, total_value)`` and the events' columns with
    ``window_start`` and ``watermark``.  The windows that are still open when the stream ends are in neither."""
    root = root or scratch_dir(spark, "request-rate-final")
    length, wait = F.expr(f"INTERVAL {window}"), F.expr(f"INTERVAL {delay}")
    counted = ["window_start", "event_type", "n", "total_value"]

    def handle(batch: DataFrame, batch_id: int):
        session = batch.sparkSession

        def put(df: DataFrame, name: str):
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

        before = session.read.parquet(f"{root}/mark/batch={batch_id - 1}").first()["watermark"] if batch_id else None
        mark = _wall_clock(before)
        timed = batch.where(F.col("ts").isNotNull()).withColumn(
            "window_start", instant_as_utc_ntz(F.window(ntz_as_utc_instant(F.col("ts")), window)["start"]))
        untimed = batch.where(F.col("ts").isNull()).withColumn("window_start", F.lit(None).cast("timestamp_ntz"))
        over = F.coalesce(F.col("window_start") + length <= mark, F.lit(False))
        put(timed.where(over).unionByName(untimed).withColumn("watermark", mark), "late")
        rows = (timed.where(~over).groupBy("window_start", "event_type")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total_value"), F.max("ts").alias("last")))
        if batch_id:
            rows = rows.unionByName(session.read.parquet(f"{root}/open/batch={batch_id - 1}"))
        put(rows.groupBy("window_start", "event_type").agg(F.sum("n").alias("n"), F.sum("total_value").alias("total_value"), F.max("last").alias("last")), "counts")
        rows = session.read.parquet(f"{root}/counts/batch={batch_id}")
        # Late events are older than the watermark, so the latest event is among the counted ones.
        now = rows.agg(F.greatest(mark, F.max("last") - wait).alias("watermark")).select(F.coalesce("watermark", mark).alias("watermark"))
        put(now, "mark")
        now = session.read.parquet(f"{root}/mark/batch={batch_id}").first()["watermark"]
        closed = F.coalesce(F.col("window_start") + length <= _wall_clock(now), F.lit(False))
        put(rows.where(closed).select(*counted), "final")
        put(rows.where(~closed), "open")
        for name, last in (("counts", batch_id), ("open", batch_id - 2), ("mark", batch_id - 2)):
            remove_path(session, f"{root}/{name}/batch={last}")

    _run(events.writeStream.foreachBatch(handle), f"{root}/checkpoint")
    secs = F.lit(float(_window_seconds(window)))
    final = spark.read.parquet(f"{root}/final").select(
        "window_start", "event_type", "n", F.round(F.col("n") / secs, 6).alias("qps"), F.round("total_value", 6).alias("total_value"))
    return final, spark.read.parquet(f"{root}/late").drop("batch")


def _wall_clock(value: datetime | None) -> Column:
    """A wall clock as a column, through its text: a datetime literal would be read in the driver's time zone."""
    return F.lit(None if value is None else value.isoformat(sep=" ")).cast("timestamp_ntz")


def _window_seconds(window: str) -> float:
    n, unit = window.split()
    return float(n) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
                       "day": 86400, "days": 86400}[unit]


def stream_pack_blocks(spark: SparkSession, pages: DataFrame, key: str = "conv_id", order: str = "turn",
                       text_col: str = "text", block_bytes: int = 3000, root: str | None = None) -> DataFrame:
    """O03 on a page stream: per-document state carries the open block across micro-batches.

    ``applyInPandasWithState`` keeps, per document, the next block number and the
    open block's text (at most ``block_bytes`` plus one page).  Completed blocks are
    emitted as soon as their closing page arrives; the open remainder is emitted
    as a provisional row that a later version of the same block replaces (the
    sink keeps the latest row per (document, block)).  Pages of a document must
    arrive in order, as a folder walk reads them; a page that arrives late is appended
    where it arrives.  Within a micro-batch pages are sorted by (order, text), and pages
    without an order value are left out, as in ``packing.pack_blocks``.  State per document is bounded
    (one open block); the pages one document contributes to a micro-batch are
    handled by one task, so the trigger size (``maxFilesPerTrigger``) bounds that
    work even for a document holding a large share of all pages."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    T_ = int(block_bytes)
    root = root or scratch_dir(spark, "stream-pack")
    out = f"{root}/out"
    out_schema = f"{key} {pages.schema[key].dataType.simpleString()}, block_no int, blk string, n_bytes long, final boolean"
    state_schema = "block_no int, buf string, buf_bytes long"

    def fold(k, batches, state):
        block_no, buf, nbytes = state.get if state.exists else (0, "", 0)
        rows = []
        frames = [b for b in batches if len(b)]
        if frames:
            pdf = pd.concat(frames)
            pdf = pdf[pdf[order].notna()].sort_values([order, text_col])
            for t in pdf[text_col]:
                if t is None or not isinstance(t, str):
                    continue                      # failed page: skipped, the document continues
                b = len(t.encode("utf-8"))
                if b == 0:
                    continue
                buf, nbytes = buf + t, nbytes + b
                if nbytes >= T_:
                    rows.append((k[0], block_no, buf, nbytes, True))
                    block_no, buf, nbytes = block_no + 1, "", 0
        if nbytes > 0:
            rows.append((k[0], block_no, buf, nbytes, False))   # provisional remainder
        state.update((block_no, buf, nbytes))
        if rows:
            yield pd.DataFrame(rows, columns=[key, "block_no", "blk", "n_bytes", "final"])

    blocks = (pages.select(key, order, text_col).groupBy(key)
              .applyInPandasWithState(fold, out_schema, state_schema, "append", GroupStateTimeout.NoTimeout))

    def handle(batch: DataFrame, batch_id: int):
        batch.withColumn("b", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(blocks.writeStream.outputMode("append").foreachBatch(handle), f"{root}/checkpoint")
    rows = spark.read.parquet(out).drop("batch")
    rows = rows.withColumn("_k", F.concat_ws("|", F.col(key).cast("string"), F.col("block_no").cast("string")))
    latest = store.latest_wins(rows.drop("final"), "_k", "b")
    return latest.select(key, "block_no", "blk", "n_bytes")
