"""Dense positions of rows within groups, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grounded.session import broadcast_if_bounded, materialize


def with_positions(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """``df`` with ``out``, the 0-based place of a row in its group by ``order``; rows equal in all of these follow each other
    in any order.

    Rows are sorted by ranges of (group, order), so a group, or an order value, that holds a third of all rows is dealt to
    many tasks; a sorted partition's rows count on from what the partitions before it hold of the group."""
    by = [group, *order]
    rows = (df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by, "_tie").sortWithinPartitions(*by, "_tie")
            .withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).drop("_tie"))
    rows = materialize(rows, "positions")
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialize(rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("first"))
                         .select(F.col(group).alias("_group"), F.col("_part").alias("_of"),
                                 (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("_shift")), "position-shifts")
    on = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))
    return (rows.join(broadcast_if_bounded(shifts, shifts.count()), on)
            .withColumn(out, F.col("_at") + F.col("_shift")).select(*[c for c in df.columns if c != out], out))
