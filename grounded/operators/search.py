"""Nearest-neighbour search (O14-O22, O16 IVF, R08 quantised pass).

Plan shape for a question set Q and a collection C:

* If Q, counted, fits the byte bound, it goes to the executors once as a broadcast
  variable (never C).  C is scanned once with ``mapInPandas``: every task scores its
  rows against Q with float64 matrix multiplies and keeps a running per-question
  top-k, so a task emits at most |Q| * k rows.
* A larger Q is never brought to the driver: a question block of bounded bytes and a
  block of vectors meet in a task, which holds the questions while the vectors stream by,
  and each pair of blocks emits its top-k (without k every hit, a few thousand at a time).
* A final ``row_number() <= k`` per question merges the lists; Spark plans a partial
  ``WindowGroupLimit`` before that shuffle.

With pivots the search is IVF: a vector is multiplied only with the questions that
probe its cell.  Filters and projections on C are applied before the Python stage so
Catalyst pushes them into the Parquet scan; the payload is joined back to the winners
only (late materialisation).  Ids of questions and vectors may be integers or strings.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.config import SearchConfig
from grounded.functions.vectors import (TopK, common_width, densify_buckets, reaching, round_scores, same_ids, single_margin, stack_vectors,
                                         unit_rows)
from grounded.session import materialize, small_batches

# Score matrices are sliced to about this many cells per step.
_MAX_CELLS = 4_000_000
# Questions, and vectors, that are multiplied at a time: their products fit a core's cache.
_TILE, _CHUNK = 256, 1024
# Dense bytes of the questions of a block, and of the vectors that they meet at once.
_BLOCK_BYTES = 32 << 20
# Hits that a task without k hands over at once.
_OUT_ROWS = 1 << 16
# More questions than this are dealt out in blocks too: a scan makes as many tasks as the collection has splits.
_SCAN_QUESTIONS = 8192
# Probe lists (questions x nprobe) that the driver may make; the cells of a question that its row is repeated for.
_MAX_PROBES, _WIDE_PROBE = 2_000_000, 16
# Questions that are worth a group of their own.
_BLOCK_QUESTIONS = 1024
# Candidate pairs of a block that are rescored together.
_BLOCK_PAIRS = 1_000_000


@dataclass(frozen=True)
class VecCol:
    """How a DataFrame carries its vectors: a dense array column, or hashed bucket ids."""
    name: str
    kind: str = "dense"          # "dense" | "buckets"
    dim: int | None = None       # declared width; required for "buckets"

    def matrix(self, values, dim: int | None = None) -> np.ndarray:
        """Rows as float64; rows of another width than the declared one are NaN, all others unaffected."""
        if self.kind == "buckets":
            return densify_buckets(list(values), self.dim)
        return stack_vectors(list(values), self.dim or dim or 0)

    def arrow_matrix(self, values: pa.Array, dim: int | None = None) -> np.ndarray:
        """``matrix`` of an Arrow column; floating vectors of the wanted width are read without a Python object per row."""
        dim, n = self.dim or dim or 0, len(values)
        if self.kind == "dense" and dim and n and pa.types.is_list(values.type) and pa.types.is_floating(values.type.value_type) and not values.null_count:
            ends = values.offsets.to_numpy()
            if (np.diff(ends) == dim).all():
                flat = values.values.slice(int(ends[0]), n * dim)
                return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, dim)
        return self.matrix(values.to_pandas(), dim)


def _quantize(m: np.ndarray) -> np.ndarray:
    return np.floor(m * 127.0 + 0.5)


def id_type(df: DataFrame, col: str) -> T.DataType:
    """Integers of any width are ids as LONG; everything else as STRING."""
    t = df.schema[col].dataType
    return T.LongType() if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else T.StringType()


def _ids(values: pd.Series, t: T.DataType) -> np.ndarray:
    return values.to_numpy(dtype=np.int64) if isinstance(t, T.LongType) else np.array(list(values), dtype=str)


def _arrow_ids(values: pa.Array, t: T.DataType) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(t, T.LongType) else np.array(values.to_pylist(), dtype=str)


def _out(ids: np.ndarray):
    return pd.Series(ids.astype(object), dtype=object) if ids.dtype.kind == "U" else ids


def _with_id(df: DataFrame, id_col: str, out: str, *cols) -> DataFrame:
    """``out`` (a LONG or STRING id) and ``cols``; rows without an id cannot be hits and are left out."""
    return (df.select(F.col(id_col).cast(id_type(df, id_col)).alias(out), *cols)
            .where(F.col(out).isNotNull()))


def unscorable(df: DataFrame, id_col: str, vec: VecCol, dim: int) -> DataFrame:
    """Reject frame: rows of a dense column that search never scores, with the reason."""
    v = F.col(vec.name)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")))
    reason = (F.when(F.col(id_col).isNull(), "no id").when(v.isNull(), "no vector")
              .when(F.size(v) != dim, f"vector size is not {dim}").when(bad, "a component is missing")
              .when(~F.exists(v, lambda x: x != 0), "zero vector"))
    return df.select(F.col(id_col).cast("string").alias("id"), reason.alias("reason")).where(F.col("reason").isNotNull())


def _found(q: DataFrame, q_id: str, c: DataFrame, c_id: str) -> T.StructType:
    return T.StructType([T.StructField("qid", id_type(q, q_id)), T.StructField(c_id, id_type(c, c_id)),
                         T.StructField("score", T.DoubleType())])


class _Scorer:
    """Scores blocks of vectors against a question matrix and keeps what the settings ask for.

    Products in single precision, whose error is bounded, sort out the pairs that can be hits; only these are scored in
    double precision and compared.  The int8 pass has whole numbers that single precision holds exactly."""

    def __init__(self, Q, qids, cfg: SearchConfig, budget: int, probes: Probes | WideProbes | None = None, coarse: int | None = None):
        self.Q, self.qids, self.cfg, self.probes, self.coarse = Q, qids, cfg, probes, coarse
        self.fast = self._fast(Q)
        self.margin = 0.0 if coarse else 2 * single_margin(Q.shape[1]) + 2 * 10.0 ** -cfg.round_digits
        self.cells = min(_TILE * _CHUNK, budget)          # of a score matrix
        # the int8 pass takes a question without a direction as zeros
        self.known = np.arange(len(qids)) if coarse else np.flatnonzero(~np.isnan(Q).any(axis=1))
        k = coarse or cfg.k
        self.top = TopK(len(qids), k) if k else None

    def _fast(self, m: np.ndarray) -> np.ndarray:
        if self.coarse:
            return _quantize(np.nan_to_num(m)).astype(np.float32 if m.shape[1] * 127 ** 2 < 1 << 24 else np.float64)
        return m.astype(np.float32)

    def _exact(self, q: np.ndarray, V: np.ndarray, v: np.ndarray) -> np.ndarray:
        out, step = np.empty(len(q)), max(1, (1 << 20) // max(V.shape[1], 1))
        for lo in range(0, len(q), step):
            out[lo:lo + step] = np.einsum("ij,ij->i", self.Q[q[lo:lo + step]], V[v[lo:lo + step]])
        return round_scores(out, self.cfg.round_digits)

    def add(self, V, ids, cells=None):
        """Yields (question rows, ids, scores) at once if there is no k."""
        good = ~np.isnan(V).any(axis=1)
        if not good.all():
            V, ids, cells = V[good], ids[good], None if cells is None else cells[good]
        if not len(ids):
            return
        fast = self._fast(V)
        if cells is None or self.probes is None:
            parts = [(self.known, slice(None))]
        else:
            parts = self._by_cell(cells)
        for rows, sel in parts:
            if len(rows):
                yield from self._part(rows, V[sel], fast[sel], ids[sel])

    def _by_cell(self, cells):
        """Every cell only with the questions that probe it; cells that all of them probe go together."""
        order = np.argsort(cells, kind="stable")
        cuts = np.flatnonzero(np.diff(cells[order])) + 1
        common = []
        for p in np.split(order, cuts):
            if len(p) and cells[p[0]] >= 0:
                rows = self.probes.questions(cells[p[0]])
                if len(rows) == len(self.known):          # only questions with a direction probe
                    common.append(p)
                else:
                    yield rows, p
        if common:
            sel = np.sort(np.concatenate(common))
            yield self.known, slice(None) if len(sel) == len(cells) else sel

    def _part(self, rows, V, fast, ids):
        order = np.argsort(ids, kind="stable") if self.cfg.exclude_self else None
        chunk = max(1, min(_CHUNK, len(ids), self.cells // min(_TILE, self.cells)))
        tile = max(1, self.cells // chunk)                # few vectors meet more questions at a time
        for lo in range(0, len(rows), tile):
            at = rows[lo:lo + tile]
            own = None if order is None else same_ids(self.qids[at], ids, order)
            for r, c, s in reaching(self.fast[at], fast, self.margin, chunk, self.top, at,
                                    None if self.coarse else self.cfg.threshold, own):
                r = at[r]
                if not self.coarse:
                    s = self._exact(r, V, c)
                    if self.cfg.threshold is not None:
                        hit = s >= self.cfg.threshold
                        r, c, s = r[hit], c[hit], s[hit]
                if self.top is not None:
                    self.top.push(r, ids[c], s.astype(np.float64))
                elif len(r):
                    yield r, ids[c], s

    def rest(self):
        if self.top is not None:
            qi, ids, s = self.top.items()
            if len(qi):
                yield qi, ids, s


@dataclass(frozen=True)
class PivotTree:
    """Pivots in two levels: every leaf pivot belongs to its nearest coarse one (ties to the lower), and a search goes
    down into the ``beam`` nearest coarse pivots only.  With about the root of the leaves as coarse pivots a row is compared with
    ``(1 + beam) * sqrt(leaves)`` pivots in place of all."""
    leaves: np.ndarray
    coarse: np.ndarray
    group: np.ndarray            # coarse pivot of every leaf
    beam: int = 4

    @property
    def shape(self) -> tuple[int, int]:
        return self.leaves.shape

    def __len__(self) -> int:
        return len(self.leaves)


def pivot_tree(pivots: np.ndarray, beam: int = 4, n_coarse: int | None = None, digits: int = 6) -> PivotTree:
    """A tree over flat pivots: the first ``n_coarse`` (the root of their number, rounded up) are the coarse ones."""
    n = n_coarse or max(1, int(np.ceil(np.sqrt(len(pivots)))))
    return PivotTree(pivots, pivots[:n], nearest_cells(pivots, pivots[:n], 1, digits)[:, 0], beam)


def _best(rows: np.ndarray, cells: np.ndarray, scores: np.ndarray, n_rows: int, n: int) -> np.ndarray:
    """Per row the ``n`` cells of the highest scores, ties to the lower cell; -1 where there are fewer."""
    known = np.flatnonzero(scores > -np.inf)
    order = known[np.lexsort((cells[known], -scores[known], rows[known]))]
    rows, cells = rows[order], cells[order]
    first = np.searchsorted(rows, np.arange(n_rows))
    slot = np.arange(len(rows)) - first[rows]
    out = np.full((n_rows, n), -1, dtype=np.int64)
    out[rows[slot < n], slot[slot < n]] = cells[slot < n]
    return out


def nearest_cells(V: np.ndarray, pivots: np.ndarray | PivotTree, n: int, digits: int) -> np.ndarray:
    """(rows x n) nearest cells of every vector, ties to the lower cell; -1 for rows that cannot be scored and where
    there are fewer.  Rows go in slices, so the score matrices stay bounded whatever the number of rows and pivots."""
    tree = isinstance(pivots, PivotTree)
    top = pivots.coarse if tree else pivots
    out = np.full((len(V), n), -1, dtype=np.int64)
    good = np.flatnonzero(~np.isnan(V).any(axis=1))
    step = max(1, _MAX_CELLS // max(len(pivots), 1))
    members = [np.flatnonzero(pivots.group == g) for g in range(len(top))] if tree else []
    for lo in range(0, len(good), step):
        at = good[lo:lo + step]
        S = np.nan_to_num(round_scores(V[at] @ top.T, digits), nan=-np.inf)
        take = min(pivots.beam if tree else n, len(top))
        # Only what reaches the row's take-th score can be among its nearest.
        kth = np.partition(S, -take, axis=1)[:, -take][:, None]
        r, c = np.nonzero((S >= kth) & (S > -np.inf))
        near = _best(r, c, S[r, c], len(at), take)
        if tree:
            r, c, s = [], [], []
            for g, own in enumerate(members):
                asks = np.flatnonzero((near == g).any(axis=1))
                if len(asks) and len(own):
                    part = np.nan_to_num(round_scores(V[at[asks]] @ pivots.leaves[own].T, digits), nan=-np.inf)
                    r.append(np.repeat(asks, len(own)))
                    c.append(np.tile(own, len(asks)))
                    s.append(part.ravel())
            near = _best(np.concatenate(r), np.concatenate(c), np.concatenate(s), len(at), n) if r else np.full((len(at), n), -1)
        out[at, :near.shape[1]] = near
    return out


def _nearest_cell(V: np.ndarray, pivots: np.ndarray | PivotTree, digits: int) -> np.ndarray:
    """Cell of every vector (ties to the lower cell); -1 for rows that cannot be scored."""
    return nearest_cells(V, pivots, 1, digits)[:, 0]


class Probes:
    """Which questions probe a cell: the question rows sorted by cell, so memory is questions x nprobe."""

    def __init__(self, lists: np.ndarray):
        rows, slots = np.nonzero(lists >= 0)
        cells = lists[rows, slots]
        order = np.lexsort((rows, cells))
        self.rows, self.cells = rows[order].astype(np.int32), cells[order].astype(np.int32)

    def questions(self, cell: int) -> np.ndarray:
        return self.rows[np.searchsorted(self.cells, cell, "left"):np.searchsorted(self.cells, cell, "right")]

    def probed(self) -> list[int]:
        return [int(c) for c in np.unique(self.cells)]


class WideProbes:
    """As ``Probes``, where questions probe many cells: a bit per question and cell, made for a slice of questions at a time."""

    def __init__(self, Q: np.ndarray, pivots: np.ndarray | PivotTree, n: int, digits: int):
        cells, step = len(pivots), max(8, _MAX_CELLS // max(n, len(pivots)) // 8 * 8)
        self.n, self.bits = len(Q), np.zeros((cells, -(-len(Q) // 8)), np.uint8)
        for lo in range(0, len(Q), step):
            part = Q[lo:lo + step]
            if isinstance(pivots, PivotTree) or n < cells:
                mask = np.zeros((cells, len(part)), bool)
                lists = nearest_cells(part, pivots, n, digits)
                rows, slots = np.nonzero(lists >= 0)
                mask[lists[rows, slots], rows] = True
            else:                                # every cell that can be scored, whatever its score
                mask = ~np.isnan(pivots).any(axis=1)[:, None] & ~np.isnan(part).any(axis=1)
            self.bits[:, lo // 8:lo // 8 + -(-len(part) // 8)] = np.packbits(mask, axis=1)

    def questions(self, cell: int) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(self.bits[cell], count=self.n))


def project_hits(hits: DataFrame, collection: DataFrame, c_id: str, payload: list[str],
                 vec_col: str | None = None, with_vectors: bool = False) -> DataFrame:
    """Payload (and optionally the vector) for the winners only.

    The collection is read a second time with just the requested columns; the
    winners side is bounded by |questions| * k."""
    cols = [c_id] + payload + ([vec_col] if with_vectors and vec_col else [])
    return hits.join(collection.select(*cols), c_id)


def _rank(scored: DataFrame, id_col: str, k: int | None) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col(id_col).asc())
    out = scored.withColumn("rk", F.row_number().over(w).cast("long"))
    return out.where(F.col("rk") <= k) if k else out


def _width(questions: DataFrame, q_vec: VecCol, c_vec: VecCol) -> int:
    """Declared width of the vectors; else the commonest one among the questions (a one-row aggregate)."""
    declared = q_vec.dim or c_vec.dim
    if declared:
        return declared
    row = (questions.where(F.size(q_vec.name) > 0).groupBy(F.size(q_vec.name).alias("d"))
           .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first())
    return row["d"] if row else 0


def nn_search(spark: SparkSession, questions: DataFrame, collection: DataFrame, *,
              q_id: str, q_vec: VecCol, c_id: str, c_vec: VecCol, cfg: SearchConfig,
              pivots: np.ndarray | PivotTree | None = None, cell_col: str | None = None,
              dim_hint: int = 768, n_questions: int | None = None) -> DataFrame:
    """Cosine top-k of every question against a collection.

    Returns ``(qid, <c_id>, score, rk)``; ``score`` is rounded to
    ``cfg.round_digits`` and only scores ``>= cfg.threshold`` survive.  With
    ``pivots`` the search is IVF: each question probes its ``cfg.nprobe`` nearest
    cells, and with a stored ``cell_col`` cells that no question probes are pruned
    at the scan.  Questions beyond ``cfg.max_broadcast_bytes``, probe lists too long for the
    driver and exact searches of many questions go through the block cogroup, with the same results."""
    cfg.validate()
    n = questions.count() if n_questions is None else n_questions
    lists = cfg.nprobe if pivots is not None else 0
    if n * max(dim_hint, 1) * 8 > cfg.max_broadcast_bytes or n * lists > _MAX_PROBES or (pivots is None and n > _SCAN_QUESTIONS):
        return block_search(spark, questions, collection, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec, cfg=cfg,
                            pivots=pivots, cell_col=cell_col)
    scored = _broadcast_scan(spark, questions, collection, q_id, q_vec, c_id, c_vec, cfg, pivots, cell_col)
    return _rank(scored, c_id, cfg.k)


def _broadcast_scan(spark, questions, collection, q_id, q_vec, c_id, c_vec, cfg, pivots=None, cell_col=None,
                    coarse: int | None = None) -> DataFrame:
    """One scan of the collection against questions that fit the byte bound."""
    sc, qt, ct = spark.sparkContext, id_type(questions, q_id), id_type(collection, c_id)
    dim = _width(questions, q_vec, c_vec)
    if c_vec.kind == "buckets":                  # a batch becomes a dense matrix, far larger than its bucket lists
        small_batches(spark)
    rows = _with_id(questions, q_id, "qid", F.col(q_vec.name).alias("v")).toArrow()      # counted: within the bound
    qids = _ids(pd.Series(rows.column("qid").to_pylist(), dtype=object), qt) if rows.num_rows else np.zeros(0, np.int64)
    vecs = [q_vec.matrix(part.to_pandas(), dim) for part in rows.column("v").chunks if len(part)]      # no Python number per component
    Q = unit_rows(np.concatenate(vecs)) if vecs else q_vec.matrix([], dim)
    del rows, vecs
    coll = _with_id(collection, c_id, c_id, F.col(c_vec.name).alias("_v"),
                    *([F.col(cell_col).alias("_cell")] if cell_col else []))
    probes = None
    if pivots is not None:
        probes = Probes(nearest_cells(Q, pivots, cfg.nprobe, cfg.round_digits))
        if cell_col is not None:
            coll = coll.where(F.col("_cell").isin(probes.probed()))      # partition pruning on an IVF layout
    shared = sc.broadcast((Q, qids, probes, pivots if cell_col is None else None))
    budget, digits = _MAX_CELLS, cfg.round_digits

    def run(batches):
        Q, qids, probes, pivots = shared.value
        scorer = _Scorer(Q, qids, cfg, budget, probes, coarse)
        if not len(qids):
            return

        def frames(found):
            for qi, ids, s in found:
                yield pd.DataFrame({"qid": _out(qids[qi]), c_id: _out(ids), "score": s})

        for pdf in batches:
            if not len(pdf):
                continue
            V = unit_rows(c_vec.matrix(pdf["_v"], Q.shape[1]))
            cells = None
            if probes is not None:
                if pivots is not None:
                    cells = _nearest_cell(V, pivots, digits)
                else:
                    cells = pdf["_cell"].fillna(-1).to_numpy(dtype=np.int64)
            yield from frames(scorer.add(V, _ids(pdf[c_id], ct), cells))
        yield from frames(scorer.rest())

    return coll.mapInPandas(run, _found(questions, q_id, collection, c_id))


# ---- IVF ---------------------------------------------------------------------

def default_nlist(n_vectors: int) -> int:
    """Cells of an index: the square root of the number of vectors."""
    return max(1, int(np.ceil(np.sqrt(n_vectors))))


def hash_pivots(vectors: DataFrame, id_col: str, vec_col: str, nlist: int | None = None) -> DataFrame:
    """Reproducible pivots drawn from the whole table: the ``nlist`` rows of the smallest id hash, numbered ``cell``."""
    nlist = default_nlist(vectors.count()) if nlist is None else nlist
    h = F.md5(F.col(id_col).cast("string"))
    chosen = vectors.select(id_col, vec_col, h.alias("_h")).orderBy("_h", id_col).limit(nlist)
    return chosen.withColumn("cell", F.row_number().over(Window.orderBy("_h", id_col)) - 1).drop("_h")    # nlist rows


def kmeans_pivots(vectors: DataFrame, vec_col: str, nlist: int, seed: int = 7) -> np.ndarray:
    """Trained pivots (production path): distributed k-means with cosine distance."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    feats = vectors.select(array_to_vector(F.col(vec_col)).alias("features"))
    model = KMeans(k=nlist, seed=seed, distanceMeasure="cosine", maxIter=20).fit(feats)
    return unit_rows(np.array([c for c in model.clusterCenters()]))


def pivot_matrix(pivots: DataFrame, vec: VecCol) -> np.ndarray:
    """Pivots in the order of their cells; bounded by ``nlist`` rows, so safe to bring to the driver."""
    rows = [r[vec.name] for r in pivots.orderBy("cell").collect()]
    return unit_rows(vec.matrix(rows, common_width(rows)))


def assign_cells(vectors: DataFrame, vec: VecCol, pivots: np.ndarray | PivotTree, digits: int = 6,
                 cell_col: str = "cell") -> DataFrame:
    """Index build: nearest pivot per vector (ties to the lower pivot), NULL if unscorable."""
    pb = vectors.sparkSession.sparkContext.broadcast(pivots)
    schema = T.StructType(vectors.schema.fields + [T.StructField(cell_col, T.IntegerType())])

    def run(batches):
        P = pb.value
        for pdf in batches:
            if len(pdf):
                cell = _nearest_cell(unit_rows(vec.matrix(pdf[vec.name], P.shape[1])), P, digits)
                texts = {c: object for c in pdf.columns if isinstance(pdf[c].dtype, pd.StringDtype)}
                yield pdf.astype(texts).assign(**{cell_col: pd.array(np.where(cell < 0, None, cell), dtype="Int32")})

    return vectors.mapInPandas(run, schema)


def ivf_search(spark: SparkSession, questions: DataFrame, collection: DataFrame, *, q_id: str,
               q_vec: VecCol, c_id: str, c_vec: VecCol, cfg: SearchConfig, pivots: np.ndarray | PivotTree,
               cell_col: str | None = None, dim_hint: int = 768) -> DataFrame:
    """Approximate search: probe the ``cfg.nprobe`` nearest cells, rescore exactly.

    With ``cell_col`` (a persisted index, ideally written ``partitionBy(cell)``)
    cells that no question probes are pruned at the scan; without it cells are
    computed in the scoring task from the broadcast pivots."""
    return nn_search(spark, questions, collection, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec,
                     cfg=cfg, pivots=pivots, cell_col=cell_col, dim_hint=dim_hint)


def with_int8(vectors: DataFrame, vec_col: str, out: str = "v8") -> DataFrame:
    """The vector scaled to unit length and rounded to int8, as a column to store with the collection."""
    v = F.col(vec_col)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    eight = F.transform(v, lambda x: F.floor(x.cast("double") / norm * 127.0 + 0.5).cast("tinyint"))
    return vectors.withColumn(out, F.when(norm > 0, eight))


def quantized_search(spark: SparkSession, questions: DataFrame, collection: DataFrame, *, q_id: str,
                     q_vec: VecCol, c_id: str, c_vec: VecCol, cfg: SearchConfig, candidates: int,
                     dim_hint: int = 768) -> DataFrame:
    """An int8 coarse pass selects ``candidates`` per question, full precision picks top k.

    Candidate lists are merged across tasks before rescoring, so the coarse top is
    global.  Candidates (at most |questions| * candidates rows) then meet both
    vectors in blocks and are scored in full precision."""
    cfg.validate()
    n = questions.count()
    coarse_fn = _broadcast_scan if n * max(dim_hint, 1) * 8 <= cfg.max_broadcast_bytes and n <= _SCAN_QUESTIONS else _block_scan
    coarse = coarse_fn(spark, questions, collection, q_id, q_vec, c_id, c_vec, cfg, coarse=candidates)
    return rescored(questions, collection, _rank(coarse, c_id, candidates).select("qid", c_id), q_id=q_id, q_vec=q_vec,
                    c_id=c_id, c_vec=c_vec, cfg=cfg, n_candidates=candidates)


def rescored(questions: DataFrame, collection: DataFrame, cand: DataFrame, *, q_id: str, q_vec: VecCol, c_id: str,
             c_vec: VecCol, cfg: SearchConfig, n_candidates: int) -> DataFrame:
    """Candidate pairs (``qid``, ``c_id``; about ``n_candidates`` a question) scored in full precision, the top k of each question.

    Pairs are ids only; they meet the vectors in blocks, so a vector is sent once per block of questions and not once per pair."""
    dim, digits = _width(questions, q_vec, c_vec), cfg.round_digits
    per_block = max(1, _BLOCK_BYTES // (8 * max(dim, 1)))
    n_q, n_v = questions.count(), collection.count()
    nv = -(-n_v // per_block) or 1
    cores = questions.sparkSession.sparkContext.defaultParallelism
    nq = max(1, -(-n_q // per_block), min(-(-cores // nv), n_q), -(-n_q * n_candidates // (nv * _BLOCK_PAIRS)))
    qt, ct = id_type(questions, q_id), id_type(collection, c_id)
    qb, vb = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("qid", nq), ("cid", nv)))
    # rows of both kinds go together; the other kind's id is never read
    none = lambda t: F.lit(0 if isinstance(t, T.LongType) else "").cast(t)
    asks = (_with_id(questions, q_id, "qid", F.col(q_vec.name).alias("qv")).withColumn("qb", qb)
            .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
            .select("qb", "vb", F.lit(True).alias("asks"), "qid", none(ct).alias("cid"), "qv", F.lit(None).cast(collection.schema[c_vec.name].dataType).alias("cv")))
    vecs = (_with_id(collection, c_id, "cid", F.col(c_vec.name).alias("cv")).withColumn("vb", vb)
            .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
            .select("qb", "vb", F.lit(False).alias("asks"), none(qt).alias("qid"), "cid", F.lit(None).cast(questions.schema[q_vec.name].dataType).alias("qv"), "cv"))
    pairs = cand.select("qid", F.col(c_id).alias("cid")).withColumn("qb", qb).withColumn("vb", vb)

    def rescore(pairs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        q, v = rows[rows["asks"]], rows[~rows["asks"]]
        if not len(pairs) or not len(q) or not len(v):
            return pd.DataFrame()
        Q, V = unit_rows(q_vec.matrix(q["qv"], dim)), unit_rows(c_vec.matrix(v["cv"], dim))
        # an id may be that of several rows: every one is scored
        both = (pairs[["qid", "cid"]].merge(pd.DataFrame({"qid": q["qid"], "q": np.arange(len(q), dtype=np.int32)}), on="qid")
                .merge(pd.DataFrame({"cid": v["cid"], "v": np.arange(len(v), dtype=np.int32)}), on="cid"))
        at_q, at_v, s = both["q"].to_numpy(), both["v"].to_numpy(), np.empty(len(both))
        step = max(1, (1 << 20) // max(dim, 1))
        for lo in range(0, len(s), step):
            s[lo:lo + step] = np.einsum("ij,ij->i", Q[at_q[lo:lo + step]], V[at_v[lo:lo + step]])
        s = round_scores(s, digits)
        good = np.ones(len(s), bool) if cfg.threshold is None else s >= cfg.threshold         # not a number becomes null
        return pd.DataFrame({"qid": both["qid"][good], c_id: both["cid"][good], "score": s[good]})

    scored = (pairs.groupBy("qb", "vb").cogroup(asks.unionByName(vecs).groupBy("qb", "vb"))
              .applyInPandas(rescore, _found(questions, q_id, collection, c_id)))
    return _rank(scored, c_id, cfg.k)


def filtered_search(spark: SparkSession, questions: DataFrame, collection: DataFrame, where, *, q_id: str, q_vec: VecCol, c_id: str,
                    c_vec: VecCol, cfg: SearchConfig, pivots: np.ndarray | PivotTree, cell_col: str | None = None, dim_hint: int = 768,
                    widen: int = 4) -> DataFrame:
    """O19 over IVF: a rare filter can leave the probed cells without ``cfg.k`` hits, so questions that found fewer probe
    ``widen`` times as many cells, until all are probed: no question has fewer than ``k`` hits where ``k`` exist.

    ``where`` is a Column (``filters.compiled``) and reaches the scan.  Every round asks only the questions that are left; with
    a tree of pivots the last round searches all of its groups."""
    if not cfg.k:
        raise ValueError("a filtered search needs k")
    kept, left, nprobe, done = collection.where(where), questions, cfg.nprobe, None
    while True:
        last = nprobe >= len(pivots)
        used = replace(pivots, beam=len(pivots.coarse)) if last and isinstance(pivots, PivotTree) else pivots
        hits = materialize(ivf_search(spark, left, kept, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec, cfg=replace(cfg, nprobe=nprobe),
                                      pivots=used, cell_col=cell_col, dim_hint=dim_hint), "filtered-hits")
        if last:
            return hits if done is None else done.unionByName(hits)
        full = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.k).select("qid")
        enough = hits.join(full, "qid", "left_semi")
        done = enough if done is None else done.unionByName(enough)
        asked = F.col(q_id).cast(id_type(questions, q_id))
        left = materialize(left.join(full.withColumnRenamed("qid", "_full"), asked == F.col("_full"), "left_anti"), "filtered-left")
        if not left.limit(1).count():
            return done
        nprobe *= widen


# ---- IVF index layout and the block cogroup ------------------------------------

def build_ivf_index(collection: DataFrame, c_id: str, c_vec: VecCol, pivots: np.ndarray | PivotTree, path: str,
                    cell_col: str = "cell") -> str:
    """Write the collection partitioned by cell; searches then prune unprobed cells
    at the scan (``PartitionFilters``).  Unscorable vectors land in ``cell=NULL``
    (the not-indexed partition).  Rows are dealt by (cell, salt) first, so a cell is a
    few files, and a cell with many rows several."""
    cols = [c_id, c_vec.name] + [c for c in collection.columns if c not in (c_id, c_vec.name)]
    n = max(1, collection.sparkSession.sparkContext.defaultParallelism // 4)
    (assign_cells(collection.select(*cols), c_vec, pivots, cell_col=cell_col)
     .repartition(F.col(cell_col), F.pmod(F.xxhash64(c_id), F.lit(n)))
     .write.mode("errorifexists").partitionBy(cell_col).parquet(path))
    return path


def block_search(spark: SparkSession, questions: DataFrame, collection: DataFrame, *, q_id: str,
                 q_vec: VecCol, c_id: str, c_vec: VecCol, cfg: SearchConfig, pivots: np.ndarray | PivotTree | None = None,
                 cell_col: str | None = None, block_bytes: int | None = None) -> DataFrame:
    """Search without bringing questions to the driver, exact or (with pivots) IVF.

    Questions and vectors meet on (cell, vector block, question block); exact search has a
    single cell.  Block counts come from per-cell cardinalities (one row per cell), so a
    cell holding a third of the collection is split into many groups.  Vectors are
    repeated for each question block of their cell and probes for each vector block.  A task
    holds the questions of a group, at most about ``block_bytes``, and lets its vectors stream by;
    every group emits only its per-question top-k, or without k its hits as they are found.  Questions that
    probe many cells are not repeated for each of them: as in exact search they meet every block of vectors once, and a
    group multiplies the cells with the questions that probe them."""
    return _rank(_block_scan(spark, questions, collection, q_id, q_vec, c_id, c_vec, cfg, pivots, cell_col,
                             block_bytes=block_bytes), c_id, cfg.k)


def _even_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` partitions a whole number that ``repartition(n, number)`` deals there."""
    found: dict[int, int] = {}
    for i, p in spark.range(0, 20 * n + 200, numPartitions=1).selectExpr("id", f"pmod(hash(CAST(id AS INT)), {n}) AS p").collect():
        found.setdefault(p, i)
    return [found.get(p, p) for p in range(n)]


def _block_scan(spark, questions, collection, q_id, q_vec, c_id, c_vec, cfg, pivots=None, cell_col=None,
                coarse: int | None = None, block_bytes: int | None = None) -> DataFrame:
    cfg.validate()
    digits, nprobe, budget = cfg.round_digits, cfg.nprobe, _MAX_CELLS
    dim = _width(questions, q_vec, c_vec)
    qt, ct = id_type(questions, q_id), id_type(collection, c_id)
    per_block = max(1, (block_bytes or _BLOCK_BYTES) // (8 * max(dim, 1)))
    per_asks = max(1, min(per_block, _MAX_CELLS // (coarse or cfg.k or 1)))        # of each question the best hits are held
    vecs = _with_id(collection, c_id, "cid", F.col(c_vec.name).alias("cv"),
                    *([F.col(cell_col).cast("int").alias("cell")] if cell_col else []))
    asks = _with_id(questions, q_id, "qid", F.col(q_vec.name).alias("qv"))
    wide, pb = pivots is not None and nprobe > _WIDE_PROBE, None
    if pivots is not None:
        pb = spark.sparkContext.broadcast(pivots)
    if pivots is None:
        vecs, asks = vecs.withColumn("cell", F.lit(0)), asks.withColumn("cell", F.lit(0))
    elif wide:
        if cell_col is None:
            vecs = assign_cells(vecs, VecCol("cv", c_vec.kind, c_vec.dim or dim), pivots, digits)
        vecs = vecs.where(F.col("cell").isNotNull()).withColumnRenamed("cell", "own").withColumn("cell", F.lit(0))
        asks = asks.withColumn("cell", F.lit(0))
    else:
        if cell_col is None:
            vecs = assign_cells(vecs, VecCol("cv", c_vec.kind, c_vec.dim or dim), pivots, digits)

        def probe(batches):
            for pdf in batches:
                if len(pdf):
                    lists = nearest_cells(unit_rows(q_vec.matrix(pdf["qv"], dim)), pb.value, nprobe, digits)
                    rows, slots = np.nonzero(lists >= 0)
                    out = pdf.iloc[rows].copy()
                    out["qid"] = out["qid"].astype(object)
                    out["cell"] = lists[rows, slots].astype(np.int32)
                    yield out.reset_index(drop=True)

        asks = asks.mapInPandas(probe, T.StructType([*asks.schema.fields, T.StructField("cell", T.IntegerType())]))
    vecs = materialize(vecs.where(F.col("cell").isNotNull()), "search-vectors")    # read twice: sizes and blocks
    asks = materialize(asks, "search-questions")
    if pivots is None or wide:                                                     # one cell: at least two groups a core, where there are so many questions
        nv, nq = max(1, vecs.count()), max(1, asks.count())
        cores, least = max(1, spark.sparkContext.defaultParallelism), -(-nq // per_asks)
        vn = max(1, min(-(-nv // per_block), -(-2 * cores // least)))
        qn = max(least, min(-(-2 * cores // vn), -(-nq // _BLOCK_QUESTIONS)))
        if vn * qn > cores:                                                        # as many for each core
            qn = -(-(-(-vn * qn // cores) * cores) // vn)
        keys = _even_keys(spark, vn * qn)
        place = F.element_at(F.array(*[F.lit(k) for k in keys]), F.col("vb") * qn + F.col("qb") + 1)
        vecs, asks = (x.withColumn("vn", F.lit(vn)).withColumn("qn", F.lit(qn)) for x in (vecs, asks))
        deal = lambda both: both.withColumn("place", place).repartition(vn * qn, "place").drop("place")
    else:
        vsizes = vecs.groupBy("cell").agg(F.count(F.lit(1)).alias("nv"))
        qsizes = asks.groupBy("cell").agg(F.count(F.lit(1)).alias("nq"))
        blocks = vsizes.join(qsizes, "cell").select("cell", F.ceil(F.col("nv") / per_block).cast("int").alias("vn"),
                                                    F.ceil(F.col("nq") / per_asks).cast("int").alias("qn"))
        blocks = F.broadcast(blocks)                                               # one row per cell
        vecs, asks = vecs.join(blocks, "cell"), asks.join(blocks, "cell")
        deal = lambda both: both.repartition("cell", "vb", "qb")
    # vectors of the other side are empty and not null: for a null list Spark's Arrow writer goes back over all rows since the last list
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    no_vector = lambda df, c: F.array().cast(df.schema[c].dataType).alias(c)
    own = ["own"] if wide else []
    qside = (asks.withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("qn")).cast("int"))
             .withColumn("vb", F.explode(F.sequence(F.lit(0), F.col("vn") - 1)))
             .select("cell", "vb", "qb", F.lit(0).alias("side"), "qid", "qv", none(vecs, "cid"), no_vector(vecs, "cv"), *[none(vecs, c) for c in own]))
    vside = (vecs.withColumn("vb", F.pmod(F.xxhash64("cid"), F.col("vn")).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qn") - 1)))
             .select("cell", "vb", "qb", F.lit(1).alias("side"), none(asks, "qid"), no_vector(asks, "qv"), "cid", "cv", *own))
    met = deal(qside.unionByName(vside)).sortWithinPartitions("cell", "vb", "qb", "side")
    bound = min(per_block, max(1, _BLOCK_BYTES // (8 * max(dim, 1))))

    def scorer_of(asked):
        qids = np.concatenate([_arrow_ids(b.column(4), qt) for b in asked])
        Q = unit_rows(np.concatenate([q_vec.arrow_matrix(b.column(5), dim) for b in asked]))
        return _Scorer(Q, qids, cfg, budget, WideProbes(Q, pb.value, nprobe, digits) if wide else None, coarse)

    def scored(scorer, given):
        V = unit_rows(np.concatenate([c_vec.arrow_matrix(b.column(7), dim) for b in given]))
        ids = np.concatenate([_arrow_ids(b.column(6), ct) for b in given])
        cells = np.concatenate([b.column(8).to_numpy(zero_copy_only=False) for b in given]).astype(np.int64) if wide else None
        return scorer.add(V, ids, cells)

    def hits(batches):
        """Question ids, ids and scores of the hits: the questions of a group come first, then its vectors in pieces of ``bound`` rows."""
        scorer, asked, given, n = None, [], [], 0

        def found(parts):
            return ((scorer.qids[qi], ids, s) for qi, ids, s in parts)

        last = None
        for group, side, rows in _runs(batches):
            if group != last:                                # the group before has ended
                if given:
                    yield from found(scored(scorer, given))
                if scorer is not None:
                    yield from found(scorer.rest())
                scorer, asked, given, n, last = None, [], [], 0, group
            if side == 0:
                asked.append(rows)
                continue
            if scorer is None:
                if not asked:
                    continue                                 # vectors that nobody asks for
                scorer, asked = scorer_of(asked), []
            while rows.num_rows:
                part, rows = rows.slice(0, bound - n), rows.slice(bound - n)
                given.append(part)
                n += part.num_rows
                if n >= bound:
                    yield from found(scored(scorer, given))
                    given, n = [], 0
        if given:
            yield from found(scored(scorer, given))
        if scorer is not None:
            yield from found(scorer.rest())

    def run(batches):
        held, n = [], 0
        for part in hits(batches):
            held.append(part)
            n += len(part[0])
            if n >= _OUT_ROWS:
                yield from batches_of(held)
                held, n = [], 0
        if held:
            yield from batches_of(held)

    def batches_of(held):
        qids, ids, s = (np.concatenate(x) for x in zip(*held))
        types = [pa.int64() if isinstance(t, T.LongType) else pa.string() for t in (qt, ct)]
        for lo in range(0, len(s), _OUT_ROWS):
            at = slice(lo, lo + _OUT_ROWS)
            columns = [pa.array(x[at] if x.dtype.kind != "U" else x[at].tolist(), t) for x, t in zip((qids, ids), types)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(s[at], pa.float64())], names=["qid", c_id, "score"])

    return met.mapInArrow(run, _found(questions, q_id, collection, c_id))


def _runs(batches):
    """Slices of batches sorted by group and side (columns 0 to 2, and 3): group, side and rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield tuple(keys[lo, :3].tolist()), int(keys[lo, 3]), batch.slice(lo, hi - lo)


def search(spark: SparkSession, questions: DataFrame, collection: DataFrame, *, q_id: str, q_vec: VecCol,
           c_id: str, c_vec: VecCol, cfg: SearchConfig, pivots: np.ndarray | PivotTree | None = None,
           cell_col: str | None = None, dim_hint: int = 768, n_questions: int | None = None) -> DataFrame:
    """One entry point honouring the reference's search settings.

    ``exact`` -> full scan (O15); otherwise IVF with the beam's counterpart, ``nprobe``
    cells (O16), and exact when no pivots exist; ``indexed_only`` keeps vectors that have
    an index cell (O17); ``threshold`` (O18) and ``k`` apply in every mode."""
    if cfg.indexed_only:
        if cell_col is None:
            if pivots is None:
                raise ValueError("indexed_only needs an index (cell column) or pivots")
            collection = assign_cells(collection, c_vec, pivots)
            cell_col = "cell"
        collection = collection.where(F.col(cell_col).isNotNull())
    if cfg.exact:
        pivots = cell_col = None
    return nn_search(spark, questions, collection, q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec, cfg=cfg,
                     pivots=pivots, cell_col=cell_col if pivots is not None else None, dim_hint=dim_hint,
                     n_questions=n_questions)
