"""Operator 1: approximate nearest neighbours in a hash-prefix forest.

Every tree gives each vector a hash string of ``BITS`` bits, one sign of a
random projection each, and is the sorted array of these strings.  A query
descends every tree to the longest prefix that it shares and ascends all trees
together, bit by bit, until the vectors under its prefixes number at least
``wanted``; so the prefix length varies with how dense the query's surroundings
are.  Vectors and queries then meet where (tree, length, prefix) are equal and
are scored exactly.

``wanted`` is set before the search from a fixed sample of ``SAMPLE`` queries:
their exact neighbours are found by brute force, and the least number of
candidates is taken at which ``TARGET`` of them lie under the prefixes.

Places with many vectors or queries (one vector may make up a third of a table)
are cut into blocks by hashes of the rows, every block of vectors meets every
block of queries of its place, and each block returns its best ``k`` per query.

Results for odd rows: vectors that are null, zero, or hold null or non-finite
components take no part, neither do vectors of another dimension than the
commonest (the smaller of equally common ones); a row is never its own
neighbour, but rows that repeat its id or vector are; equal scores go to the
smaller id; a query with fewer than ``k`` other rows gets all of them; an empty
table gives an empty result.  Columns are taken by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from grounded.llm.common import batch_of, checkpointed, map_batches, map_partitions, runs

TREES, BITS = 16, 24
# Prefix lengths at which a query may stop, longest first; 0 is the whole table.
LENGTHS = (24, 18, 14, 12, 10, 9, 8, 7, 6, 5, 4, 3, 2)
K, SAMPLE, TARGET = 20, 64, 0.96
# Vectors and queries that meet in one block at most (about).
BLOCK_VECTORS, BLOCK_QUERIES = 4096, 512
# Stands for a null id while rows are sorted: after all others.
_NULL = (1 << 63) - 1


def _ids(column: Iterable[int | None]) -> np.ndarray:
    return np.array([_NULL if v is None else v for v in column], np.int64)


def usable(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``row``, ``vec_id`` and ``vector`` (doubles) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = (rows.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("vec_id"),
                        F.col(vector).cast("array<double>").alias("vector"))
            .where(v.isNotNull()).where(finite & F.exists(v, lambda x: x != 0)))
    sizes = good.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return good.where(F.size("vector") == (sizes["d"] if sizes else 0))


def with_codes(rows: DataFrame, trees: int = TREES, bits: int = BITS, seed: int = 3) -> DataFrame:
    """``row``, ``vec_id``, ``data`` (doubles, or floats where they lose nothing) and ``codes``, a number per tree."""
    def start():
        planes: dict[int, np.ndarray] = {}
        power = (1 << np.arange(bits - 1, -1, -1)).astype(np.int64)

        def fn(batch):
            x = np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            d = x.shape[1]
            if d not in planes:
                planes[d] = np.random.default_rng(seed).standard_normal((d, trees * bits))
            signs = (x @ planes[d] >= 0).reshape(len(x), trees, bits)
            return [batch.column(0), batch.column(1), [r.tobytes() for r in x], (signs @ power).tolist()]
        return fn

    return map_batches(rows, start, "row long, vec_id long, data binary, codes array<long>", 1024)


def _prefixes(rows: DataFrame, lengths: Column, bits: int, *columns: str) -> DataFrame:
    """A row per tree and length: ``tree``, ``length``, ``prefix``; at length 0 only one tree is needed."""
    trees = F.posexplode("codes").alias("tree", "code")
    long = rows.select(*columns, F.col("codes"), F.explode(lengths).alias("length")).select(*columns, "length", trees)
    return (long.where("length > 0 or tree = 0")
            .select(*columns, "tree", "length", F.expr(f"shiftright(code, {bits} - length)").alias("prefix")))


def best(scores: np.ndarray, q: np.ndarray, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: int, k: int) -> list[tuple]:
    """The ``k`` best rows for one query: score, id, row; equal scores by id.

    ``scores`` come from a matrix product and choose who may be among them; the reported ones are summed anew,
    the same way for every pair."""
    other = rows != own
    if not other.any():
        return []
    usable_scores = np.where(other, scores, -np.inf)
    n = min(k, int(other.sum()))
    bound = np.partition(usable_scores, -n)[-n]
    near = np.flatnonzero(usable_scores >= bound - 1e-9 * (1 + abs(bound)))
    exact = (x[near] * q).sum(1)
    order = np.lexsort((rows[near], ids[near], -exact))[:k]
    return [(float(exact[i]), None if ids[near[i]] == _NULL else int(ids[near[i]]), int(rows[near[i]])) for i in order]


def calibrate(coded: DataFrame, queries: DataFrame, counts: DataFrame, k: int, bits: int, trees: int) -> int | None:
    """The least number of candidates that finds ``TARGET`` of the sample's true neighbours; None: all rows."""
    sample = queries.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).collect()       # SAMPLE vectors
    if not sample:
        return None
    spark = coded.sparkSession
    own = np.array([r["row"] for r in sample])
    shared = spark.sparkContext.broadcast((own, np.array([np.frombuffer(r["data"]) for r in sample]),
                                           np.array([r["codes"] for r in sample])))

    def start():
        rows_q, q, codes_q = shared.value

        def fn(batch):
            rows = np.array(batch.column(0).to_pylist())
            ids = _ids(batch.column(1).to_pylist())
            x = np.array([np.frombuffer(b) for b in batch.column(2).to_pylist()])
            codes = np.array(batch.column(3).to_pylist())
            scores, out, at = q @ x.T, [], {int(r): i for i, r in enumerate(rows)}
            for i, r in enumerate(rows_q):
                for s, v, row in best(scores[i], q[i], x, ids, rows, r, k):
                    differ = int((codes[at[row]] ^ codes_q[i]).min())       # the tree that agrees longest
                    out.append((int(r), s, v, row, bits - differ.bit_length()))
            return list(zip(*out)) if out else [[]] * 5
        return fn

    near = map_batches(coded.select("row", "vec_id", "data", "codes"), start,
                       "query long, score double, vec_id long, found long, shared int", 4096)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "found")
    true = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k).collect()
    sizes = {(r["row"], r["length"]): r["n"] for r in
             counts.where(F.col("row").isin([int(r) for r in own])).collect()}
    lengths = sorted({length for _, length in sizes}, reverse=True)

    def recall(wanted: int) -> float:
        stop = {r: next((n for n in lengths if sizes.get((r, n), 0) >= wanted), 0) for r in own.tolist()}
        return sum(t["shared"] >= stop[t["query"]] for t in true) / max(1, len(true))

    least = trees * (k + 1)                     # then one tree alone has k other rows
    for wanted in sorted({least, *(n for n in sizes.values() if n > least)}):
        if recall(wanted) >= TARGET:
            return wanted
    return None


FOUND = "query_row long, query_id long, score double, vec_id long, found long"


def search(rows: DataFrame, is_query: Callable[[Column], Column], vec_id: str = "vec_id", vector: str = "embedding",
           k: int = K, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """The ``k`` nearest other rows of every query row by inner product: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    coded = checkpointed(with_codes(usable(rows, vec_id, vector), trees, bits), "ann-codes")
    queries = coded.where(is_query(F.col("vec_id")))
    steps = F.array(*[F.lit(n) for n in LENGTHS if n <= bits])
    wanted_places = _prefixes(queries, steps, bits, "row")
    sizes = _prefixes(coded, steps, bits).groupBy("tree", "length", "prefix").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(wanted_places.join(sizes, ["tree", "length", "prefix"])
                          .groupBy("row", "length").agg(F.sum("n").alias("n")), "ann-counts")
    wanted = calibrate(coded, queries, counts, k, bits, trees)
    enough = counts.where(F.col("n") >= wanted) if wanted is not None else counts.where("false")
    stops = enough.groupBy("row").agg(F.max("length").alias("stop"))
    stopped = checkpointed(queries.join(stops, "row", "left").withColumn("stop", F.coalesce("stop", F.lit(0))), "ann-queries")

    used = [r["stop"] for r in stopped.select("stop").distinct().collect()]          # some of LENGTHS, and 0
    place = ["tree", "length", "prefix"]
    q = _prefixes(stopped, F.array("stop"), bits, "row", "vec_id", "data")
    v = _prefixes(coded, F.array(*[F.lit(n) for n in used]), bits, "row", "vec_id", "data") if used else q.limit(0)
    at_q = q.groupBy(*place).agg(F.count(F.lit(1)).alias("nq"))
    at_v = (_prefixes(coded, F.array(*[F.lit(n) for n in used]), bits) if used else q).groupBy(*place).agg(F.count(F.lit(1)).alias("nv"))
    cuts = checkpointed(at_q.join(at_v, place).select(*place, F.ceil(F.col("nq") / BLOCK_QUERIES).cast("int").alias("q_blocks"),
                                                      F.ceil(F.col("nv") / BLOCK_VECTORS).cast("int").alias("v_blocks")), "ann-cuts")

    def dealt(side: DataFrame, mine: str, theirs: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("row"), F.col(mine)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(theirs) - 1))
        return (side.join(cuts, place).withColumn(mine[0], block).withColumn(theirs[0], every)
                .select(*place, "q", "v", F.lit(name).alias("side"), "row", "vec_id", "data"))

    met = (dealt(q, "q_blocks", "v_blocks", "query").unionByName(dealt(v, "v_blocks", "q_blocks", "vector"))
           .repartition(*place, "q", "v").sortWithinPartitions(*place, "q", "v", "side"))

    def score(batches, schema):
        out = []
        for _, group in runs(batches, 5):
            asked = [r for r in group if r[0] == "query"]
            given = group[len(asked):]
            if not asked or not given:
                continue
            x = np.array([np.frombuffer(r[3]) for r in given])
            ids, own_rows = _ids(r[2] for r in given), np.array([r[1] for r in given])
            y = np.array([np.frombuffer(r[3]) for r in asked])
            scores = y @ x.T
            for i, (_, row, qid, _) in enumerate(asked):
                out += [(row, qid, *found) for found in best(scores[i], y[i], x, ids, own_rows, row, k)]
            if len(out) > 20_000:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    # A pair that met in several trees has the same score in each.
    found = map_partitions(met, score, FOUND).distinct()
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "found")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def brute_force(ids: np.ndarray, x: np.ndarray, query: int, k: int = K) -> list[tuple[int, float]]:
    """Exact neighbours of row ``query`` of a small table: (id, score)."""
    scores = (x * x[query]).sum(1)
    order = [i for i in np.lexsort((ids, -scores)) if i != query][:k]
    return [(int(ids[i]), float(scores[i])) for i in order]
