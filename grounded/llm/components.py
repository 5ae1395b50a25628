"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import checkpointed


def _least(edges: DataFrame) -> DataFrame:
    """Per node ``u``, its smallest neighbour, added up in every task before the shuffle.

    Written, so that the joins that follow read plain shuffles on both sides: then Spark can split the
    partition of a node that holds a large share of all edges."""
    return checkpointed(edges.groupBy("u").agg(F.min("v").alias("m")), "components-least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (both.join(_least(both).select("u", F.least("m", "u").alias("m")), "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge points from its larger to its smaller end here.
    edges = checkpointed(edges, "components-large")
    least = _least(edges)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (moved.unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) of every node with an edge to another one.

    ``edges`` has columns ``u`` and ``v`` of one comparable type; null ends and loops are left out.  Each round
    is written to the shared folder, and rounds end when the edges stay the same: they are then stars."""
    edges = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                         .distinct(), "components")
    state = _state(edges)
    while True:
        edges = checkpointed(_small_star(_large_star(edges)), "components")
        after = _state(edges)
        if after == state:
            break
        state = after
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
