"""Operator 11: a Merkle manifest of a dataset, with a proof for every row.

The leaf of a row hashes its fields; the leaves of a group ascend by id, eight
neighbours at a time become the hash of their digests until one node, the
group's subroot, is left; the subroots, in the order of their groups, become the
root the same way.

Leaves are narrow rows (id, group, digest).  They are sorted once by ranges of (group, id); offsets of the sorted
partitions give each leaf its position.  Blocks of 4,096 positions are then the partitions of all windows, so a group
that holds a third of all rows is many of them: within a block, each of four levels takes its siblings by lags and
leads of fixed offsets, masked by the node's slot and the length of its run, and the first child's row hashes the parent.
The blocks' own digests, one row in 4,096, go through the same pass until every group is one node.  Digests above a
block reach its rows by a join on the block, by which the windows have already dealt them.

Results for odd rows: a null field hashes as ``-``; null ids come first and are never tampered with; rows of equal
group and id follow each other by their leaves; the null group comes first; an empty table gives no row.
Columns of the input may have any names: results are built from the named ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grounded.llm.common import checkpointed
from grounded.session import broadcast_if_bounded

FAN = 8
# Levels of one pass, and the leaves that it puts into one window partition.
LEVELS = 4
BLOCK = FAN ** LEVELS
# Rows (sorted partition, group) that may be broadcast to number the leaves.
PLACES = 200_000


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def field(column: Column) -> Column:
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``pos``, their position by ``order`` within their ``g``, and ``n``, the rows of it.

    Sorted by ranges of (g, order); a sorted partition's rows count on from what the ones before it hold of the group."""
    spread = ["g", *order]
    rows = checkpointed(rows.repartitionByRange(*spread).sortWithinPartitions(*spread)
                        .withColumn("at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("at", 33)
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = (rows.groupBy(part.alias("part"), "g").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("start"))
              .select("part", "g", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("start")).alias("shift"),
                      F.sum("rows").over(Window.partitionBy("g")).alias("n")))
    places = checkpointed(places, "merkle-places")
    placed = rows.withColumn("part", part).join(broadcast_if_bounded(places, places.count(), PLACES), ["part", "g"])
    return placed.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _levels(nodes: DataFrame) -> DataFrame:
    """One pass: ``path``, the siblings (left, right) of every level that the row's node has in its block, and on the
    block's first row the digest ``top`` of the block; ``tops`` is how many blocks the group has."""
    over = "OVER (PARTITION BY g, block ORDER BY pos"
    out = nodes.withColumns({"block": F.expr(f"pos div {BLOCK}"), "d0": F.col("d"), "c": F.col("n")})
    for level in range(LEVELS):
        step = FAN ** level
        node, d = f"(pos div {step})", f"d{level}"
        left = ", ".join(f"if({node} % {FAN} >= {k}, lag({d}, {k * step}) {over}), NULL)" for k in range(FAN - 1, 0, -1))
        # A run has FAN nodes, the group's last one what is left of its c nodes.
        right = ", ".join(f"if({node} % {FAN} + {k} < least({FAN}, c - {node} + {node} % {FAN}), lead({d}, {k * step}) {over}), NULL)"
                          for k in range(1, FAN))
        out = out.withColumn("s", F.expr(f"if(pos % {step} = 0 AND c > 1, struct(concat_ws('', {left}) AS left, concat_ws('', {right}) AS right), NULL)"))
        parent = F.when(F.col("c") > 1, digest(F.col(d), F.col("s.right"))).otherwise(F.col(d))
        # A row has the siblings of its ancestor, the last node of the level at or before it.
        held = F.expr(f"last(s, true) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)") if level else F.col("s")
        out = out.withColumns({f"d{level + 1}": F.when(F.expr(f"pos % {step * FAN} = 0"), parent), f"s{level}": held,
                               "c": F.expr(f"(c + {FAN - 1}) div {FAN}")})
    path = F.array_compact(F.array(*[f"s{i}" for i in range(LEVELS)]))
    return out.select(*nodes.columns, "block", path.alias("path"), F.col(f"d{LEVELS}").alias("top"), F.col("c").alias("tops"))


def _grown(nodes: DataFrame) -> list[DataFrame]:
    """The nodes (g, pos, n, d) and those of every pass above them, up to one node a group."""
    passes, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1 or len(passes) < 2:
        up = _levels(passes[-1]).where(F.pmod("pos", F.lit(BLOCK)) == 0)
        passes.append(checkpointed(up.select("g", F.col("block").alias("pos"), F.col("tops").alias("n"), F.col("top").alias("d")),
                                   "merkle-nodes"))
        most = -(-most // BLOCK)
    return passes


def _with_paths(passes: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first pass with ``path`` up to the root of ``above`` (g, path, and what else it holds)."""
    rest = above.withColumnRenamed("path", "rest")
    for nodes in reversed(passes[1:]):
        on = ["g"] if "block" not in rest.columns else ["g", "block"]
        rest = (_levels(nodes).drop("top", "tops", "n", "d").join(rest, on)
                .withColumn("rest", F.concat("path", "rest")).drop("path", "block").withColumnRenamed("pos", "block"))
    return _levels(passes[0]).drop("top", "tops").join(rest, ["g", "block"]).withColumn("path", F.concat("path", "rest")).drop("rest")


def fold(path: Column, start: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, start, lambda node, s: digest(s["left"], node, s["right"]))


def manifest(rows: DataFrame, key: str, group: str, fields: list[str], tampered: Column | None = None,
             changed: tuple[str, Column] | None = None) -> DataFrame:
    """``id``, ``leaf``, ``changed_leaf`` (of the row with the column ``changed[0]`` replaced, where ``tampered``, else the leaf), ``subroot``,
    ``root`` and ``path``, an array of (left, right): what stands beside the row's node on each level up to the root."""
    plain = [field(F.col(c)) for c in fields]
    other = [field(changed[1]) if changed and c == changed[0] else x for c, x in zip(fields, plain)]
    text = F.col(group).cast("string")
    leaves = checkpointed(rows.select(
        F.col(key).alias("id"), F.coalesce(F.concat(F.lit("v"), text), F.lit("-")).alias("g"), digest(*plain).alias("d"),
        (F.when(tampered, digest(*other)) if changed else F.lit(None).cast("string")).alias("changed"),
        F.monotonically_increasing_id().alias("row_no")), "merkle-leaves")
    passes = _grown(_numbered(leaves, "id", "d", "row_no").drop("row_no"))
    subroots = passes[-1].select(F.col("g").alias("name"), F.lit("").alias("g"), "d")
    tops = _grown(checkpointed(_numbered(subroots, "name"), "merkle-subroots"))
    root = tops[-1].select("g", F.col("d").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    above = _with_paths(tops, root).select(F.col("name").alias("g"), F.col("d").alias("subroot"), "root", "path")
    return _with_paths(passes, checkpointed(above, "merkle-above")).select(
        "id", F.col("d").alias("leaf"), F.coalesce("changed", "d").alias("changed_leaf"), "subroot", "root", "path")


def proofs(found: DataFrame) -> DataFrame:
    """``manifest``'s rows with the digest of their path, the root folded from ``changed_leaf``, and whether it is the root."""
    path = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.col("path"), F.col("changed_leaf"))
    return (found.withColumns({"proof_sha256": digest(path), "folded_root": folded})
            .withColumn("verified", F.col("folded_root") == F.col("root")).drop("path", "changed_leaf"))
