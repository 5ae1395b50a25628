"""In-row array helpers (JVM higher-order functions, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_run_counts(df: DataFrame, keys: list[str], arr: str, value: str = "v", count: str = "n",
                       carry: list[str] | None = None) -> DataFrame:
    """One row per distinct element of array column ``arr`` with its count.

    The array is sorted inside the row and run starts give the counts, so
    counting needs no shuffle however many rows share a key."""
    carry = carry or []
    s = F.col("_s")
    size = F.size(s)
    starts = F.filter(F.sequence(F.lit(1), size),
                      lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
    st = F.col("_st")
    runs = F.transform(F.sequence(F.lit(1), F.size(st)),
                       lambda k: F.struct(F.element_at(s, F.element_at(st, k)).alias(value),
                                          (F.coalesce(F.try_element_at(st, k + 1), size + 1) - F.element_at(st, k))
                                          .cast("long").alias(count)))
    return (df.select(*keys, *carry, F.array_sort(arr).alias("_s"))
            .select(*keys, *carry, "_s", F.when(F.size("_s") > 0, starts).alias("_st"))
            .select(*keys, *carry, F.when(F.col("_st").isNotNull(), runs).alias("_r")))


def runs_norm(runs: str = "_r", count: str = "n"):
    """L2 norm of ln(1 + count) weights over a runs array."""
    return F.sqrt(F.aggregate(runs, F.lit(0.0), lambda acc, r: acc + F.pow(F.log1p(r[count].cast("double")), 2)))
