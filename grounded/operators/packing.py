"""Block packing (O03) without gathering a document into one task.

Semantics (fixed by the reference): pages are appended in order with no
separator; right after an append, if the buffer holds >= ``T`` bytes the block is
emitted and the buffer reset; the remainder is emitted at the end; empty blocks
are never emitted; a failed (NULL) page is skipped.

The fold is sequential, so it is re-expressed on byte offsets.  With C_i the
cumulative byte count after page i, a flush at offset c is followed by the next
flush at f(c) = end of the page that covers byte c + T.  Block starts are the
orbit 0, f(0), f(f(0)), ... which we compute by pointer doubling:

1. offsets: two-level prefix sum (window per (doc, segment), then a window over
   per-segment totals), so no window sees a whole long document;
2. f: one sort-based window per (doc, T-byte bucket); a bucket holds at most T
   pages and T probes, whatever the document length;
3. jump tables J_{k+1} = J_k o J_k (equi-joins on (doc, offset)), each
   checkpointed to the shared checkpoint folder to cut lineage;
4. the orbit of 0 is expanded top-down through the levels, carrying depths;
5. every page finds its block start by an as-of lookup inside two adjacent
   buckets (block starts are >= T apart), then each block's pages (bounded by
   T bytes plus one page) are concatenated in order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grounded.functions.positions import with_positions
from grounded.session import scratch_dir

SEGMENT_PAGES = 4096
# Documents with at most this many non-empty pages are folded in one bounded group.
SHORT_PAGES = 1024


def _prefix_sum(df: DataFrame, key: str, order: str, val: str, out: str) -> DataFrame:
    """Inclusive running sum of ``val`` in ``order`` within ``key``; no window ever
    holds more than SEGMENT_PAGES rows.  ``order`` values are unique per key.

    Rows are cut into segments of SEGMENT_PAGES consecutive order values; each
    segment is summed locally, and the exclusive prefix over segment totals is
    the same problem on a table SEGMENT_PAGES times smaller (recursion while any
    key still has more than SEGMENT_PAGES segments)."""
    seg = F.floor(F.col(order) / SEGMENT_PAGES)
    p = df.withColumn("_seg", seg)
    local = p.withColumn("_loc", F.sum(val).over(
        Window.partitionBy(key, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    tot = p.groupBy(key, "_seg").agg(F.sum(val).alias("_tot"))
    widest = tot.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if widest <= SEGMENT_PAGES:
        off = tot.withColumn("_off", F.coalesce(F.sum("_tot").over(
            Window.partitionBy(key).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    else:
        off = (_prefix_sum(tot.withColumnRenamed("_seg", "_s2"), key, "_s2", "_tot", "_inc")
               .select(key, F.col("_s2").alias("_seg"), (F.col("_inc") - F.col("_tot")).alias("_off")))
    return (local.join(off.select(key, "_seg", "_off"), [key, "_seg"])
            .withColumn(out, F.col("_off") + F.col("_loc"))
            .drop("_seg", "_loc", "_off"))


def _offsets(pages: DataFrame, key: str, order: str, n_col: str) -> DataFrame:
    return (_prefix_sum(pages, key, order, n_col, "C")
            .withColumn("s", F.col("C") - F.col(n_col)))


def _next_flush(pg: DataFrame, key: str, T: int) -> DataFrame:
    """(key, x, y): y = end offset of the page covering byte x + T, NULL past the end."""
    nodes = pg.select(key, F.col("C").alias("x")).unionByName(pg.select(key, F.lit(0).cast("long").alias("x")).distinct())
    lo = F.floor((F.col("s") + 1) / T)
    hi = F.floor(F.col("C") / T)
    page_rows = (pg.select(key, "s", "C", F.explode(F.sequence(lo, hi)).alias("bkt"))
                 .select(key, "bkt", F.greatest(F.col("s") + 1, F.col("bkt") * T).alias("pos"),
                         F.lit(0).alias("kind"), F.col("C").alias("end"), F.lit(None).cast("long").alias("x")))
    probes = nodes.select(key, F.floor((F.col("x") + T) / T).alias("bkt"), (F.col("x") + T).alias("pos"),
                          F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end"), "x")
    w = (Window.partitionBy(key, "bkt").orderBy("pos", "kind")
         .rowsBetween(Window.unboundedPreceding, 0))
    u = page_rows.unionByName(probes).withColumn("_cov", F.last("end", ignorenulls=True).over(w))
    return (u.where(F.col("kind") == 1)
            .select(key, "x", F.when(F.col("_cov") >= F.col("pos"), F.col("_cov")).alias("y")))


def _place_short(pg: DataFrame, key: str, order: str, T: int) -> DataFrame:
    """Block number of every page of documents with at most SHORT_PAGES non-empty
    pages: one bounded group per document, the fold runs inside the row."""
    g = pg.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("_n").alias("n"))))
                            .alias("_p"))
    init = F.struct(F.lit(0).cast("long").alias("buf"), F.lit(0).alias("blk"),
                    F.array().cast("array<int>").alias("out"))

    def step(acc, p):
        full = acc["buf"] + p["n"] >= T
        return F.struct(F.when(full, F.lit(0).cast("long")).otherwise(acc["buf"] + p["n"]).alias("buf"),
                        F.when(full, acc["blk"] + 1).otherwise(acc["blk"]).alias("blk"),
                        F.concat(acc["out"], F.array(acc["blk"])).alias("out"))

    folded = g.select(key, "_p", F.aggregate("_p", init, step)["out"].alias("_b"))
    return (folded.select(key, F.explode(F.arrays_zip("_p", "_b")).alias("_z"))
            .select(key, F.col("_z._p.o").alias(order), F.col("_z._b").alias("block_no"),
                    F.col("_z._p.n").alias("_n")))


def _place_long(pg: DataFrame, key: str, order: str, T: int, steps: int, checkpoint_every: int) -> DataFrame:
    """Block number of every page by pointer doubling over flush offsets (any length)."""
    K = math.ceil(math.log2(steps)) if steps > 1 else 0
    levels = [_next_flush(pg, key, T).checkpoint(eager=True)]
    for _ in range(K):
        J = levels[-1]
        hop = J.select(key, F.col("x").alias("y"), F.col("y").alias("y2"))
        nxt = J.join(hop, [key, "y"], "left").select(key, "x", F.col("y2").alias("y"))
        levels.append(nxt.checkpoint(eager=True))
    # orbit of 0, top-down: every member keeps itself and adds its 2^k-th successor
    S = pg.select(key).distinct().select(key, F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("d"))
    for k in range(len(levels) - 1, -1, -1):
        J = levels[k].where(F.col("y").isNotNull())
        both = F.array(F.struct(F.col("x").alias("x"), F.col("d").alias("d")),
                       F.struct(F.col("y").alias("x"), (F.col("d") + (1 << k)).alias("d")))
        S = (S.join(J, [key, "x"], "left")
             .select(key, F.explode(F.when(F.col("y").isNull(), F.array(F.struct("x", "d"))).otherwise(both))
                     .alias("_s"))
             .select(key, "_s.x", "_s.d"))
        if k and k % checkpoint_every == 0:
            S = S.checkpoint(eager=True)   # keep lineage short for very long documents
    starts = S.withColumnRenamed("x", "bs").withColumn("cb", F.floor(F.col("bs") / T))
    starts = starts.select(key, "bs", "d", F.explode(F.array(F.col("cb"), F.col("cb") + 1)).alias("bkt"))
    return (pg.withColumn("bkt", F.floor(F.col("s") / T))
            .join(starts, [key, "bkt"])
            .where((F.col("bs") <= F.col("s")) & (F.col("s") < F.col("bs") + T))
            .select(key, order, F.col("d").cast("int").alias("block_no"), "_n"))


def reject_pages(pages: DataFrame, key: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """Reject frame: pages that cannot be placed, with the reason."""
    reason = (F.when(F.col(key).isNull(), "no document key").when(F.col(order).isNull(), "no order value")
              .when(F.col(text_col).isNull(), "no text"))
    return pages.select(F.col(key).cast("string").alias("key"), F.col(order).cast("string").alias("position"),
                        reason.alias("reason")).where(F.col("reason").isNotNull())


def _distinct_order(pages: DataFrame, key: str, order: str, text_col: str) -> DataFrame:
    """Order values made distinct per document: pages that share one follow each other in the order of their text.

    Only if some do, pages get dense positions, whatever the order values are and however many pages share one."""
    most = pages.groupBy(key, order).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    return pages if most == 1 else with_positions(pages, key, [order, text_col], order)


def pack_blocks(pages: DataFrame, key: str = "conv_id", order: str = "turn", text_col: str = "text",
                block_bytes: int = 3000, checkpoint_every: int = 6) -> DataFrame:
    """-> (key, block_no, blk, n_bytes); block_no counts from 0 per document.

    Documents with at most SHORT_PAGES non-empty pages (the common case) are
    folded inside one bounded group; longer ones go through offsets and pointer
    doubling, whose depth then depends on the long documents only.  Only narrow
    rows (no text) take part in placement; page text is joined back once and
    grouped per block (a block holds at most T bytes plus one page).

    Pages without a document key or order value are not packed (``reject_pages`` lists
    them); pages that share an order value are taken in the order of their text."""
    T = int(block_bytes)
    spark = pages.sparkSession
    scratch_dir(spark, "packing")          # makes sure a checkpoint folder is configured
    pages = _distinct_order(pages.select(key, order, text_col).where(
        F.col(key).isNotNull() & F.col(order).isNotNull() & (F.octet_length(text_col) > 0)), key, order, text_col)
    meta = (pages.select(key, order, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_n"))
            .where(F.col("_n") > 0))
    per_doc = meta.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("_n").alias("b"))
    long_doc = F.col("n") > SHORT_PAGES
    stats = per_doc.agg(F.count(F.lit(1)).alias("docs"),
                        F.max(F.when(long_doc, F.col("n"))).alias("n"),
                        F.max(F.when(long_doc, F.col("b"))).alias("b")).first()
    if not stats["docs"]:
        return spark.createDataFrame([], f"{key} {pages.schema[key].dataType.simpleString()}, block_no int, blk string, n_bytes long")
    if stats["n"] is None:                 # no long document: one bounded fold per document
        placed = _place_short(meta, key, order, T)
    else:
        long_keys = per_doc.where(long_doc).select(key)
        short = _place_short(meta.join(long_keys, key, "left_anti"), key, order, T)
        pg = _offsets(meta.join(long_keys, key, "left_semi"), key, order, "_n").checkpoint(eager=True)
        # chain length is bounded by pages per document and by bytes / T
        steps = int(min(stats["n"], stats["b"] // T)) + 1
        placed = short.unionByName(_place_long(pg, key, order, T, steps, checkpoint_every))
    texts = pages.select(key, order, text_col).where(F.octet_length(text_col) > 0)
    blocks = (placed.join(texts, [key, order])
              .groupBy(key, "block_no")
              .agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text_col)))).alias("_p"),
                   F.sum("_n").alias("n_bytes")))
    return blocks.select(key, "block_no", F.array_join(F.transform("_p", lambda x: x[text_col]), "").alias("blk"),
                         "n_bytes")
