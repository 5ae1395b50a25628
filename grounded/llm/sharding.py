"""Operator 10 [native]: size-bounded shards by extendible hashing.

A directory is indexed by the leading bits of a hash.  All rows start in one
bucket; a bucket whose bytes exceed the limit, and only such a bucket, splits
on the next bit, until every bucket fits.  A row's bucket is therefore the
shortest prefix of its hash whose rows fit together.  Splitting goes in rounds
of ``BITS`` bits: one aggregation gives the bytes of every prefix of a round,
and only rows of buckets that are still too large enter the next round.

The hash is the MD5 of the key.  Rows that share a key share all its 128 bits;
should they be too many, the bits of an MD5 of the key and the row's position
in the input follow, so that a key that holds a third of all rows splits like
any other.  A single row above the limit stays alone in its shard and is marked
``oversized``.

Only DataFrame functions run here.  Results for odd rows: a null key hashes as
the empty text; null or empty content has 0 bytes; repeated rows are rows like
any other; an empty table gives no shard.  Columns of the input may have any
names: results are built from the named ones, and one of these that is named
like a result column comes back with ``_in`` behind its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import checkpointed

# Bits that one round looks at: at most 2 ** BITS prefixes per bucket that enters it.
BITS = 12
# Bits of the key's hash; the bits after them come from the row.
KEY_BITS = 128
LIMIT_BYTES = 1 << 20
RESULT = ("n_bytes", "shard", "depth", "shard_bytes", "shard_rows")


def out_name(name: str) -> str:
    """Name under which an input column stands in the result."""
    return f"{name}_in" if name.lower() in RESULT else name


def hash_bits(data: Column) -> Column:
    """The 128 bits of the MD5 as a string of 0 and 1."""
    hexed = F.md5(data.cast("binary"))
    return F.concat(*[F.lpad(F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)])


def _levels(cells: DataFrame, done: int) -> DataFrame:
    """Bytes and rows of every prefix of ``done + 1`` to ``done + BITS`` bits (``done`` itself in the first round)."""
    first = done if done == 0 else done + 1
    levels = F.sequence(F.lit(first), F.lit(done + BITS))
    return (cells.select(F.explode(levels).alias("depth"), "prefix", "n_bytes", "n_rows")
            .groupBy("depth", F.substring("prefix", F.lit(1), F.col("depth")).alias("shard"))
            .agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows")))


def assign(rows: DataFrame, key: str, content: str, limit_bytes: int = LIMIT_BYTES,
           keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Shard of every row, and the directory of shards.

    Rows: ``key``, ``keep`` (both under ``out_name``), ``n_bytes``, ``shard`` (its prefix of bits), ``depth``, ``shard_bytes`` and
    ``shard_rows``.  Directory: ``shard``, ``depth``, ``shard_bytes``, ``shard_rows``, ``oversized``."""
    size = F.coalesce(F.octet_length(F.col(content)), F.lit(0)).cast("long")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    given = {f"__in{i}": c for i, c in enumerate((key, *keep))}
    rest = checkpointed(
        rows.select(*[F.col(c).alias(inner) for inner, c in given.items()], size.alias("n_bytes"), name.alias("__name"),
                    F.monotonically_increasing_id().alias("__row")), "sharding-rows")
    first = F.col("__name")
    second = F.concat(F.col("__name"), F.lit("#"), F.col("__row").cast("string"))
    found, directory, done = [], [], 0
    while True:
        bits = hash_bits(first) if done + BITS <= KEY_BITS else F.concat(hash_bits(first), hash_bits(second))
        keyed = rest.withColumn("__prefix", F.substring(bits, 1, done + BITS))
        cells = checkpointed(keyed.groupBy(F.col("__prefix").alias("prefix"))
                             .agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")),
                             "sharding-cells")
        sums = _levels(cells, done)
        last = done + BITS >= 2 * KEY_BITS
        fits = (F.col("n_bytes") <= limit_bytes) | (F.col("n_rows") == 1) | F.lit(last)
        # The shortest prefix of each cell that fits; cells without one go on to the next round.
        steps = F.sequence(F.lit(done if done == 0 else done + 1), F.lit(done + BITS))
        chosen = (cells.select("prefix", F.explode(steps).alias("depth"))
                  .withColumn("shard", F.substring("prefix", F.lit(1), F.col("depth")))
                  .join(sums.where(fits).select("depth", "shard", "n_bytes", "n_rows"), ["depth", "shard"])
                  .groupBy("prefix").agg(F.min(F.struct("depth", "shard", "n_bytes", "n_rows")).alias("s")))
        chosen = checkpointed(chosen.select("prefix", "s.*"), "sharding-chosen")
        directory.append(chosen.select("shard", "depth", F.col("n_bytes").alias("shard_bytes"),
                                       F.col("n_rows").alias("shard_rows")).distinct())
        place = chosen.select(F.col("prefix").alias("__prefix"), "shard", "depth", F.col("n_bytes").alias("shard_bytes"),
                              F.col("n_rows").alias("shard_rows"))
        placed = keyed.join(place, "__prefix", "left")
        found.append(placed.where(F.col("shard").isNotNull())
                     .select(*[F.col(inner).alias(out_name(c)) for inner, c in given.items()], *RESULT))
        if not cells.join(chosen, "prefix", "left_anti").limit(1).count():
            break
        rest = checkpointed(placed.where(F.col("shard").isNull()).select(*rest.columns), "sharding-rows")
        done += BITS
    for other in found[1:]:
        found[0] = found[0].unionByName(other)
    for other in directory[1:]:
        directory[0] = directory[0].unionByName(other)
    over = F.col("shard_bytes") > limit_bytes
    return found[0], directory[0].withColumn("oversized", over)


def write_shards(rows: DataFrame, assigned: DataFrame, key: str, path: str) -> None:
    """The rows as Parquet, one folder per shard; for keys that are unique in both inputs.

    A column ``shard`` of the rows is written as ``shard_in``."""
    place = assigned.select(F.col(out_name(key)).alias("__key"), F.col("shard").alias("__shard"))
    named = rows.select(*[F.col(f"`{c}`").alias(f"{c}_in" if c.lower() == "shard" else c) for c in rows.columns])
    key = f"{key}_in" if key.lower() == "shard" else key
    (named.join(place, F.col(key).eqNullSafe(F.col("__key"))).drop("__key").withColumnRenamed("__shard", "shard")
     .repartition("shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(path))
