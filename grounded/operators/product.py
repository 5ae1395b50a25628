"""Product quantisation (R08): sub-space codebooks, one byte per sub-space, lookup tables per question, exact rescoring.

A vector is scaled to unit length, in fixed point (whole numbers of 1 / ``SCALE``), and cut into ``parts`` sub-spaces.
Every sub-space has a codebook; a vector's code is its nearest codeword per sub-space.  A question's table holds its inner
products with all codewords, so a stored code costs ``parts`` lookups.  The best ``candidates`` codes of a question are
then scored in full precision.

Fixed point makes every sum exact, so codebooks, codes and candidates do not depend on how rows are partitioned.
Vectors that are null, of another width, zero or with a missing component have a null code and are never found."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.config import SearchConfig
from grounded.functions.vectors import TopK, reaching, single_margin
from grounded.operators import search as srch
from grounded.session import materialize

SCALE = 1 << 16
# Rows whose distances or lookups one step holds.
_STEP = 512


@dataclass(frozen=True)
class Codebook:
    """Codewords in fixed point: (parts, codewords, width of a part)."""
    words: np.ndarray

    @property
    def dim(self) -> int:
        return self.words.shape[0] * self.words.shape[2]

    def split(self, m: np.ndarray) -> np.ndarray:
        """(n, dim) -> (parts, n, width)."""
        return m.reshape(len(m), len(self.words), -1).transpose(1, 0, 2)

    def encode(self, m: np.ndarray) -> np.ndarray:
        """Nearest codeword of every row in every sub-space, ties to the lower: (n, parts) bytes."""
        out = np.empty((len(m), len(self.words)), np.uint8)
        half = (self.words.astype(np.float64) ** 2).sum(2)
        for lo in range(0, len(m), _STEP):
            for p, x in enumerate(self.split(m[lo:lo + _STEP])):
                # |x|^2 is the same for all codewords; whole numbers below 2^53 are exact in float64
                out[lo:lo + _STEP, p] = (half[p] - 2 * (x @ self.words[p].T.astype(np.float64))).argmin(1)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The codewords of every code, one after the other: (n, dim) in single precision."""
        return np.concatenate([w.astype(np.float32)[codes[:, p]] for p, w in enumerate(self.words)], axis=1)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of every question with every codeword: (parts, n, codewords)."""
        return np.stack([x @ w.T.astype(np.float64) for x, w in zip(self.split(q), self.words)])


def fixed_point(vec: str, dim: int) -> Column:
    """The unit vector in whole numbers of 1 / ``SCALE``; null where the row cannot be scored."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    # outside the lambda: inside it the norm would be summed anew for every component
    whole = F.zip_with(v, F.array_repeat(norm, F.size(v)), lambda x, n: F.floor(x / n * float(SCALE) + 0.5).cast("int"))
    # the comparison is false for zero, overflowing and not-a-number norms, null for missing components
    return F.when((F.size(v) == dim) & (norm > 0) & (norm < float("inf")), whole)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(list(rows)).astype(np.float64)


def train(vectors: DataFrame, id_col: str, vec: str, dim: int, parts: int = 16, codewords: int = 64, rounds: int = 3) -> Codebook:
    """Codebooks of all sub-spaces together: each round is one scan that assigns whole vectors and sums them per codeword.

    The first codewords are the vectors of the smallest id hash; a codeword without vectors stays.  A task sends
    ``parts`` x ``codewords`` sums at most, and as many are all that the driver sees."""
    if dim % parts or not 1 <= codewords <= 256:
        raise ValueError("parts must divide the dimension, and a code is one byte")
    rows = materialize(vectors.select(F.col(id_col).cast("string").alias("id"), fixed_point(vec, dim).alias("x"))
                       .where(F.col("x").isNotNull() & F.col("id").isNotNull()), "product-vectors")
    first = rows.orderBy(F.md5("id"), "id", "x").limit(codewords).collect()
    if not first:
        raise ValueError("no vector to learn codewords from")
    book = Codebook(np.array([r["x"] for r in first], dtype=np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2))
    schema = "part int, code int, n long, total array<long>"
    for _ in range(rounds):
        shared = vectors.sparkSession.sparkContext.broadcast(book)

        def sums(batches):
            book = shared.value
            n = np.zeros(book.words.shape[:2], np.int64)
            total = np.zeros(book.words.shape, np.int64)
            for pdf in batches:
                if len(pdf):
                    m = _matrix(pdf["x"])
                    codes = book.encode(m)
                    for p, x in enumerate(book.split(m)):
                        np.add.at(n[p], codes[:, p], 1)
                        np.add.at(total[p], codes[:, p], x.astype(np.int64))
            p, c = np.nonzero(n)
            yield pd.DataFrame({"part": p.astype(np.int32), "code": c.astype(np.int32), "n": n[p, c], "total": list(total[p, c])})

        found = rows.select("x").mapInPandas(sums, schema)
        each = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dim // parts)]
        words = book.words.copy()
        for r in found.groupBy("part", "code").agg(F.sum("n").alias("n"), *each).collect():
            words[r["part"], r["code"]] = [r[f"s{i}"] // r["n"] for i in range(dim // parts)]
        book = Codebook(words)
    return book


def with_codes(vectors: DataFrame, vec: str, book: Codebook, out: str = "code") -> DataFrame:
    """``out``: the code of every vector as ``parts`` bytes, a column to store with the collection."""
    shared = vectors.sparkSession.sparkContext.broadcast(book)          # parts x codewords x width numbers

    @F.pandas_udf(T.BinaryType())
    def coded(x: pd.Series) -> pd.Series:
        codes = pd.Series([None] * len(x), dtype=object)
        there = np.flatnonzero(x.notna().to_numpy())
        if len(there):
            codes.iloc[there] = [c.tobytes() for c in shared.value.encode(_matrix(x.iloc[there]))]
        return codes

    return vectors.withColumn(out, coded(fixed_point(vec, book.dim)))


def _lookup(tables: np.ndarray, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Table sums of pairs: question ``rows[i]`` and code ``codes[i]``."""
    total = tables[0][rows, codes[:, 0]]
    for p in range(1, len(tables)):
        total = total + tables[p][rows, codes[:, p]]
    return total


def candidates(questions: DataFrame, collection: DataFrame, *, q_id: str, q_vec: str, c_id: str, code: str, book: Codebook,
               cfg: SearchConfig, n: int, block_bytes: int = 32 << 20) -> DataFrame:
    """The ``n`` best codes of every question: ``qid``, ``c_id``, ``score`` (inner product with the codewords).

    Questions and codes meet in blocks: a block of questions has tables of about ``block_bytes``, a block of codes as many
    bytes of codes and ids.  A task emits ``n`` rows per question, so nothing whole passes the driver or one task.  Products with
    the decoded codes in single precision, whose error is bounded, sort out what can be among the ``n`` best; the tables give its score."""
    qt, ct = srch.id_type(questions, q_id), srch.id_type(collection, c_id)
    asks = materialize(srch._with_id(questions, q_id, "qid", fixed_point(q_vec, book.dim).alias("x")).where("x IS NOT NULL"), "product-questions")
    codes = srch._with_id(collection, c_id, "cid", F.col(code).alias("code")).where(F.col("code").isNotNull())
    parts, words, _ = book.words.shape
    n_asks = asks.count()
    nq = -(-n_asks * parts * words * 8 // block_bytes) or 1
    nv = -(-codes.count() * (parts + 16) // block_bytes) or 1
    # enough blocks for all cores: of questions, as every block of codes emits n rows a question
    nq = max(nq, min(-(-2 * questions.sparkSession.sparkContext.defaultParallelism // nv), -(-n_asks // srch._TILE)))
    qside = (asks.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(nq)).cast("int"))
             .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(nv - 1)))))
    vside = (codes.withColumn("vb", F.pmod(F.xxhash64("cid"), F.lit(nv)).cast("int"))
             .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))))
    shared = questions.sparkSession.sparkContext.broadcast(book)
    exclude, margin = cfg.exclude_self, 2 * single_margin(book.dim)

    def score(qpdf: pd.DataFrame, vpdf: pd.DataFrame) -> pd.DataFrame:
        if not len(qpdf) or not len(vpdf):
            return pd.DataFrame()
        qids, ids = srch._ids(qpdf["qid"], qt), srch._ids(vpdf["cid"], ct)
        book, x = shared.value, _matrix(qpdf["x"])
        coded = np.frombuffer(b"".join(vpdf["code"]), np.uint8).reshape(len(ids), -1)
        decoded, asked = book.decode(coded) / np.float32(SCALE), (x / SCALE).astype(np.float32)
        order = np.argsort(ids, kind="stable") if exclude else None
        top, chunk = TopK(len(qids), n), max(1, srch._MAX_CELLS // (4 * srch._TILE))
        for lo in range(0, len(qids), srch._TILE):
            at = np.arange(lo, min(lo + srch._TILE, len(qids)))
            tables = book.tables(x[at])
            own = None if order is None else srch.same_ids(qids[at], ids, order)
            for r, c, _ in reaching(asked[at], decoded, margin, chunk, top, at, own=own):
                top.push(at[r], ids[c], _lookup(tables, r, coded[c]) / SCALE ** 2)
        qi, found, s = top.items()
        return pd.DataFrame({"qid": srch._out(qids[qi]), c_id: srch._out(found), "score": s})

    found = (qside.groupBy("qb", "vb").cogroup(vside.groupBy("qb", "vb"))
             .applyInPandas(score, srch._found(questions, q_id, collection, c_id)))
    return srch._rank(found, c_id, n)


def product_search(spark: SparkSession, questions: DataFrame, collection: DataFrame, *, q_id: str, q_vec: srch.VecCol, c_id: str,
                   c_vec: srch.VecCol, book: Codebook, cfg: SearchConfig, n_candidates: int, code: str | None = None) -> DataFrame:
    """``n_candidates`` codes per question by table lookups, then ``cfg.k`` of them by the full vectors.

    ``code`` names a stored column of ``with_codes``; without it the collection is encoded here."""
    cfg.validate()
    if code is None:
        collection, code = with_codes(collection, c_vec.name, book, "_code"), "_code"
    near = candidates(questions, collection, q_id=q_id, q_vec=q_vec.name, c_id=c_id, code=code, book=book, cfg=cfg, n=n_candidates)
    return srch.rescored(questions, collection, near.select("qid", c_id), q_id=q_id, q_vec=q_vec, c_id=c_id, c_vec=c_vec, cfg=cfg,
                         n_candidates=n_candidates)
