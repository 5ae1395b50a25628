"""Operator 12 [native]: exact duplicates by two passes over a Bloom filter.

Texts are equal when they agree after every run of ASCII white space is
replaced by one space.  The table is read once into narrow rows (id, SHA-256 of
the text).  The first pass sets ``PROBES`` bits per hash; of these bits the
filter keeps the ones that two or more rows set, so every repeated hash finds all
its bits there, and a single one rarely does.  The second pass tests each row against
the filter, which is broadcast: rows that fail go straight to the result, only
rows that may be repeated are grouped by their hash, which settles them exactly.

What the first pass shuffles are bit positions, counted before the shuffle, so
a text that a third of all rows share is one count per task.  The filter is made
of bitmaps of 4 kB, has ``BITS_PER_ROW`` bits a row and at most ``max_filter_bytes``
at a time: larger tables go through several rounds, each over the rows whose
hash falls into its bitmaps.  Groups of ``rows / HOT_GROUPS`` copies or more (there
are no more than ``HOT_GROUPS``) reach their rows by broadcast, the others by a join.

Only DataFrame functions run here.  Results for odd rows: null text counts as empty; a null id comes after all
others; of rows that share id and text one stays; an empty table gives no row.  Columns of the input may have any
names: results are built from the two named ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import checkpointed
from grounded.session import scratch_dir

# Bits of one bitmap of ``bitmap_construct_agg``.
BLOCK_BITS = 32768
# About 5 % of the rows without a copy pass a filter of 8 bits a row with two probes.
BITS_PER_ROW, PROBES = 8, 2
MAX_FILTER_BYTES = 64 << 20
HOT_GROUPS = 10_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _probed(rows: DataFrame, blocks: int) -> DataFrame:
    """Each row's bitmap and its ``PROBES`` different bits there."""
    at, step = F.xxhash64("hash", F.lit(1)), F.xxhash64("hash", F.lit(2))
    bits = [F.pmod(at, F.lit(BLOCK_BITS))]
    for _ in range(PROBES - 1):
        bits.append(F.pmod(bits[-1] + 1 + F.pmod(step, F.lit(BLOCK_BITS // PROBES - 1)), F.lit(BLOCK_BITS)))
    return rows.withColumns({"block": F.pmod(F.xxhash64("hash"), F.lit(blocks)), "bits": F.array(*bits)})


def repeated_filter(rows: DataFrame) -> DataFrame:
    """``(block, bitmap)``: the bits that at least two of the probed rows set."""
    return (rows.select("block", F.explode("bits").alias("bit")).groupBy("block", "bit").agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1").groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")))


def _is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.pow(F.lit(2), F.pmod(bit, F.lit(8))).cast("int")) != 0


def tested(rows: DataFrame, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows ``(id, hash, row_no)`` and whether their hash is ``maybe`` repeated, written apart by that."""
    spark, n = rows.sparkSession, rows.count()
    blocks = max(1, -(-n * BITS_PER_ROW // BLOCK_BITS))
    at_once = max(1, max_filter_bytes * 8 // BLOCK_BITS)
    path, probed = scratch_dir(spark, "dedup-tested"), _probed(rows, blocks)
    for first in range(0, blocks, at_once):
        part = probed.where(F.col("block").between(first, first + at_once - 1)) if blocks > at_once else probed
        # At most ``at_once`` bitmaps of 4 kB: no more than ``max_filter_bytes``.
        found = part.join(F.broadcast(repeated_filter(part)), "block", "left")
        maybe = F.lit(True)
        for i in range(PROBES):
            maybe = maybe & _is_set(F.col("bitmap"), F.col("bits")[i])
        (found.select(*rows.columns, F.coalesce(maybe, F.lit(False)).alias("maybe"))
         .write.mode("append").partitionBy("maybe").parquet(path))
    schema = rows.select("*", F.lit(True).alias("maybe")).schema
    return spark.read.schema(schema).parquet(path)


def decide(docs: DataFrame, key: str, text: str, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per input row: ``key``, ``keep_id`` (the smallest id of equal texts), ``group_size``, ``kept``, ``text_sha256``."""
    rows = checkpointed(docs.select(F.col(key).alias("id"), F.unhex(F.sha2(normalised(F.col(text)).cast("binary"), 256)).alias("hash"),
                                    F.monotonically_increasing_id().alias("row_no")), "dedup-hashes")
    found = tested(rows, max_filter_bytes)
    alone, maybe = found.where(~F.col("maybe")), found.where(F.col("maybe"))
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no"))
    groups = checkpointed(maybe.groupBy("hash").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size"))
                          .where("group_size > 1"), "dedup-groups")
    large = F.col("group_size") >= max(2, -(-rows.count() // HOT_GROUPS))
    dealt = maybe.join(F.broadcast(groups.where(large)), "hash", "left")
    rest = dealt.where(F.col("group_size").isNull()).select(*rows.columns).join(groups.where(~large), "hash", "left")
    out = (F.col("id").alias(key), F.coalesce("first.id", F.when(F.col("first").isNull(), F.col("id"))).alias("keep_id"),
           F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
           (F.col("first").isNull() | (F.col("first.row_no") == F.col("row_no"))).alias("kept"),
           F.lower(F.hex("hash")).alias("text_sha256"))
    done = [x.select(*out) for x in (dealt.where(F.col("group_size").isNotNull()), rest)]
    passed = alone.select(F.col("id").alias(key), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                          F.lit(True).alias("kept"), F.lower(F.hex("hash")).alias("text_sha256"))
    return passed.unionAll(done[0]).unionAll(done[1])


def kept_rows(docs: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs``, all columns, that stay; for ids that are unique in it.  Only ids of dropped rows are joined."""
    gone = decided.where(~F.col("kept")).select(F.col(key).alias("__gone"))
    return docs.join(gone, F.col(key).eqNullSafe(F.col("__gone")), "left_anti")
