"""Lexical retrieval (R05 BM25, hybrid reciprocal-rank fusion) and rerank.

BM25 plan: question terms that fit a counted bound are broadcast.  One pass over the
documents writes a row per document with its length and the counts of question terms;
document frequencies and corpus statistics are aggregates of these rows, and a second
scan of them scores whole blocks against all questions, keeping a running top-k per
task.  No (question, document) pair is shuffled but the tasks' winners.  More terms
than the bound go through joins on the term instead, with the same results."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.functions import text as tf
from grounded.functions.vectors import TopK
from grounded.session import broadcast_if_bounded, ensure_checkpoint_dir, materialize, small_batches

# ---- fixed values: BM25 parameters and fusion constant ----
BM25_K1 = 1.2
BM25_B = 0.75
RRF_K = 60
# ------------------------------------------------------------------------------


def query_terms(questions: DataFrame, q_key: str, text_col: str) -> DataFrame:
    return (questions.select(q_key, F.explode_outer(F.array_distinct(tf.tokens(text_col, lower=True))).alias("term"))
            .where(F.col("term").isNotNull()))


# Question terms (rows of question and term) that are broadcast, and the bytes of their (terms x questions) matrix.
MAX_QUERY_TERMS = 200_000
MAX_MATRIX_BYTES = 256 << 20


def bm25(questions: DataFrame, docs: DataFrame, q_key: str = "item_id", q_text: str = "text",
         d_key: str = "doc_id", d_text: str = "text", k: int = 10, k1: float = BM25_K1,
         b: float = BM25_B) -> DataFrame:
    """Top-k BM25 documents per question: ``q_key``, ``d_key``, ``score`` (6 decimals), ``rk``."""
    qt = query_terms(questions, q_key, q_text)
    rows = qt.limit(MAX_QUERY_TERMS + 1).collect()                    # bounded
    cells = len({r["term"] for r in rows}) * len({r[q_key] for r in rows})
    if len(rows) > MAX_QUERY_TERMS or cells * 8 > MAX_MATRIX_BYTES:
        return _bm25_join(questions, docs, q_key, q_text, d_key, d_text, k, k1, b)
    return _bm25_scan(rows, docs, q_key, questions.schema[q_key].dataType, d_key, d_text, k, k1, b)


def _bm25_scan(rows, docs, q_key, q_type, d_key, d_text, k, k1, b) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    terms = sorted({r["term"] for r in rows})
    qids = sorted({r[q_key] for r in rows})
    index = {t: i for i, t in enumerate(terms)}
    at_q = {q: i for i, q in enumerate(qids)}
    asked = np.zeros((len(terms), len(qids)))
    for r in rows:
        asked[index[r["term"]], at_q[r[q_key]]] = 1.0
    d_type = docs.schema[d_key].dataType
    out = T.StructType([T.StructField(q_key, q_type), T.StructField(d_key, d_type), T.StructField("score", T.DoubleType())])
    if not rows:
        return spark.createDataFrame([], T.StructType([*out.fields, T.StructField("rk", T.LongType())]))
    vocab = spark.sparkContext.broadcast(index)

    def count(batches):
        pat, get = re.compile(tf.TOKEN_PATTERN), vocab.value.get
        for pdf in batches:
            found = []
            for text in pdf["_t"]:
                words = pat.findall(text) if isinstance(text, str) else None
                c = Counter(i for i in map(get, words or ()) if i is not None)
                found.append((None if words is None else len(words), list(c), list(c.values())))
            yield pd.DataFrame({d_key: pdf[d_key], "dl": pd.array([f[0] for f in found], dtype="Int64"),
                                "terms": [f[1] for f in found], "tf": [f[2] for f in found]})

    # F.lower, not Python's: the SQL side of a comparison lowers the same way
    postings = materialize(docs.select(d_key, F.lower(d_text).alias("_t")).mapInPandas(
        count, T.StructType([T.StructField(d_key, d_type), T.StructField("dl", T.LongType()),
                             T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType()))])),
        "bm25-postings")
    st = postings.agg(F.count(d_key).alias("n"), F.avg("dl").alias("avgdl")).first()
    df = np.zeros(len(terms))
    for r in postings.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():   # a row per term
        df[r["t"]] = r["n"]
    n_docs, avgdl = float(st["n"]), float(st["avgdl"] or 0.0)
    idf = np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((idf, asked, np.array(qids, dtype=object)))
    int_ids = not isinstance(d_type, T.StringType)

    def score(batches):
        idf, asked, qids = shared.value
        top = TopK(len(qids), k)
        step = max(1, min(2048, 8_000_000 // max(len(idf), 1)))        # bounded block of documents x terms
        for whole in batches:
            for lo in range(0, len(whole), step):
                pdf = whole.iloc[lo:lo + step]
                lens = pdf["terms"].map(len).to_numpy()
                if not lens.sum():
                    continue
                row = np.repeat(np.arange(len(pdf)), lens)
                term = np.concatenate(list(pdf["terms"])).astype(np.int64)
                tf_ = np.concatenate(list(pdf["tf"])).astype(np.float64)
                dl = pdf["dl"].fillna(0).to_numpy(dtype=np.float64)[row]
                x = np.zeros((len(pdf), len(idf)))
                x[row, term] = idf[term] * (tf_ * (k1 + 1.0) / (tf_ + k1 * (1.0 - b + b * dl / avgdl)))
                s = np.floor((x @ asked).T * 1e6 + 0.5) / 1e6
                s[((x > 0).astype(np.float32) @ asked.astype(np.float32)).T == 0] = -np.inf     # shares no term
                ids = pdf[d_key].to_numpy(dtype=np.int64) if int_ids else np.array(list(pdf[d_key]), dtype=str)
                top.add(s, ids)
        qi, ids, s = top.items()
        if len(qi):
            yield pd.DataFrame({q_key: pd.Series(qids[qi], dtype=object), d_key: ids if int_ids else pd.Series(ids.astype(object), dtype=object), "score": s})

    w = Window.partitionBy(q_key).orderBy(F.col("score").desc(), F.col(d_key).asc())
    return (postings.mapInPandas(score, out)
            .withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k))


def _bm25_join(questions: DataFrame, docs: DataFrame, q_key: str, q_text: str, d_key: str, d_text: str, k: int,
               k1: float, b: float) -> DataFrame:
    ensure_checkpoint_dir(questions.sparkSession)
    qt = query_terms(questions, q_key, q_text)
    # query vocabulary (bounded by the question set) with fixed-width ids; the ids
    # are checked collision-free, so aggregating on them is exact
    vocab = qt.select("term").distinct().withColumn("tid", F.xxhash64("term"))
    chk = qt.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("term").alias("n"),
                 F.countDistinct(F.xxhash64("term")).alias("u")).first()      # one job: sizes and collisions
    if chk["n"] != chk["u"]:
        vocab = vocab.withColumn("tid", F.dense_rank().over(Window.orderBy("term")).cast("long"))
    n_qt = chk["rows"]
    vocab = broadcast_if_bounded(vocab, chk["n"])
    toks = docs.select(d_key, tf.tokens(d_text, lower=True).alias("_t"))
    # corpus statistics: one aggregate row, used as two scalars
    st = (docs.select(d_key, F.size(tf.tokens(d_text)).alias("dl"))
          .agg(F.count(d_key).cast("double").alias("n"), F.avg("dl").alias("avgdl")).first())
    # postings of query terms only, computed once: both tf and df read them
    postings = (toks.select(d_key, F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))
                .join(vocab, "term")
                .groupBy(d_key, "dl", "tid").agg(F.count(F.lit(1)).alias("tf"))
                .checkpoint(eager=True))
    df_ = postings.groupBy("tid").agg(F.count(F.lit(1)).alias("df"))
    scored_terms = postings.join(broadcast_if_bounded(df_, chk["n"]), "tid")   # one row per query term
    n_docs, avgdl = F.lit(float(st["n"])), F.lit(float(st["avgdl"] or 0.0))
    idf = F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tfw = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / avgdl))
    contrib = scored_terms.select(d_key, "tid", (idf * tfw).alias("c"))
    qtid = qt.join(vocab, "term").select(q_key, "tid")
    scores = (broadcast_if_bounded(qtid, n_qt).join(contrib, "tid")
              .groupBy(q_key, d_key).agg(F.round(F.sum("c"), 6).alias("score")))
    w = Window.partitionBy(q_key).orderBy(F.col("score").desc(), F.col(d_key).asc())
    return scores.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)


def rrf(lists: list[DataFrame], q_key: str, d_key: str, k: int = 10, c: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists ``(q_key, d_key, rk)``: union + sum
    (equivalent to a full outer join of the lists, with partial aggregation)."""
    u = lists[0].select(q_key, d_key, "rk")
    for l in lists[1:]:
        u = u.unionByName(l.select(q_key, d_key, "rk"))
    fused = u.groupBy(q_key, d_key).agg(F.round(F.sum(1.0 / (F.lit(float(c)) + F.col("rk"))), 6).alias("score"))
    w = Window.partitionBy(q_key).orderBy(F.col("score").desc(), F.col(d_key).asc())
    return fused.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)


def rerank_overlap(hits: DataFrame, questions: DataFrame, q_key: str, q_text: str, chunk_col: str,
                   id_cols: list[str]) -> DataFrame:
    """Second score over the top-k only: share of distinct question tokens
    present in the hit.  Ranked by (overlap, first score, ids)."""
    qt = questions.select(F.col(q_key).alias("qid"), F.array_distinct(tf.tokens(q_text, lower=True)).alias("_q"))
    ct = F.array_distinct(tf.tokens(chunk_col, lower=True))
    ov = F.when(F.size("_q") > 0, F.size(F.array_intersect("_q", ct)) / F.size("_q")).otherwise(F.lit(0.0))
    scored = hits.join(qt, "qid").withColumn("overlap", F.round(ov, 6))
    w = Window.partitionBy("qid").orderBy(F.col("overlap").desc(), F.col("score").desc(),
                                          *[F.col(c).asc() for c in id_cols])
    return scored.withColumn("rk", F.row_number().over(w).cast("long")).drop("_q")


# ---- persisted inverted index: build once, query many --------------------------

def build_bm25_index(docs: DataFrame, path: str, d_key: str = "doc_id", d_text: str = "text",
                     n_buckets: int = 64) -> str:
    """Postings ``(term, doc_id, dl, tf)`` of every term, written ``partitionBy(tb)``
    with ``tb = pmod(xxhash64(term), n_buckets)``, plus one corpus-statistics row.

    Term counts are aggregated partially in every task; a stop word in a third of
    all documents is spread over many tasks by the (doc, term) key.  A table of fewer splits than cores is dealt out first."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select(d_key, d_text)
    docs = docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs
    toks = docs.select(d_key, tf.tokens(d_text, lower=True).alias("_t"))
    postings = (toks.select(d_key, F.size("_t").alias("dl"), F.explode_outer("_t").alias("term"))
                .where(F.col("term").isNotNull())
                .groupBy(d_key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
                .withColumn("tb", F.pmod(F.xxhash64("term"), F.lit(n_buckets)).cast("int")))
    # A bucket is a few sorted files, not one per task: a stop word's rows are spread by the salt.
    salt = F.pmod(F.xxhash64(d_key), F.lit(max(1, docs.sparkSession.sparkContext.defaultParallelism // 8)))
    (postings.repartition("tb", salt).sortWithinPartitions("tb", "term")
     .write.mode("errorifexists").partitionBy("tb").parquet(f"{path}/postings"))
    (toks.agg(F.count(d_key).cast("double").alias("n"), F.avg(F.size("_t")).alias("avgdl"))
     .withColumn("n_buckets", F.lit(n_buckets))
     .coalesce(1).write.mode("errorifexists").parquet(f"{path}/stats"))
    return path


def bm25_from_index(questions: DataFrame, path: str, q_key: str = "item_id", q_text: str = "text",
                    d_key: str = "doc_id", k: int = 10, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """Top-k BM25 reading only the index buckets that hold query terms.

    The question terms (counted, bounded) go to the tasks; the postings that they touch are gathered per document, and a task
    scores documents with all questions and emits those that reach the k-th score so far: no (question, document) pair is
    shuffled but these.  More terms than the bound are joined instead, with the same results."""
    spark = questions.sparkSession
    st = spark.read.parquet(f"{path}/stats").first()
    qt = query_terms(questions, q_key, q_text)
    nb = int(st["n_buckets"])
    buckets = [r[0] for r in qt.select(F.pmod(F.xxhash64("term"), F.lit(nb)).cast("int")).distinct().collect()]
    index = spark.read.parquet(f"{path}/postings").where(F.col("tb").isin(buckets))   # partition pruning
    n_docs, avgdl = float(st["n"]), float(st["avgdl"] or 0.0)
    rows = qt.limit(MAX_QUERY_TERMS + 1).collect()                                    # bounded
    if len(rows) > MAX_QUERY_TERMS:
        scores = _join_postings(index, qt, q_key, d_key, n_docs, avgdl, k1, b)
    else:
        scores = _scan_postings(index, rows, questions.schema[q_key].dataType, q_key, d_key, n_docs, avgdl, k, k1, b)
    w = Window.partitionBy(q_key).orderBy(F.col("score").desc(), F.col(d_key).asc())
    return scores.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k)


def _scan_postings(index, rows, q_type, q_key, d_key, n_docs, avgdl, k, k1, b) -> DataFrame:
    """Scores of the documents that can be among the ``k`` best of a question."""
    import pyarrow as pa

    spark = index.sparkSession
    d_type = index.schema[d_key].dataType
    out = T.StructType([T.StructField(q_key, q_type), T.StructField(d_key, d_type), T.StructField("score", T.DoubleType())])
    if not rows:
        return spark.createDataFrame([], out)
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    qids = {q: i for i, q in enumerate(dict.fromkeys(r[q_key] for r in rows))}
    # the questions of every term, one after the other; a term counts as often as rows of the question hold it
    asks = np.array(sorted((terms[r["term"]], qids[r[q_key]]) for r in rows), dtype=np.int64)
    first = np.searchsorted(asks[:, 0], np.arange(len(terms) + 1))
    vocab = F.broadcast(spark.createDataFrame(list(terms.items()), "term string, tid int"))
    postings = index.join(vocab, "term").select(d_key, "tid", "dl", "tf")
    df = np.zeros(len(terms))
    for r in postings.groupBy("tid").agg(F.count(F.lit(1)).alias("n")).collect():     # a row per term
        df[r["tid"]] = r["n"]
    # terms without postings are never looked up
    idf = np.log(np.maximum(1.0 + (n_docs - df + 0.5) / (df + 0.5), 1e-300))
    by_doc = postings.groupBy(d_key).agg(F.collect_list(F.struct("tid", "dl", "tf")).alias("terms"))      # at most the vocabulary
    shared = spark.sparkContext.broadcast((idf, first, asks[:, 1], list(qids)))
    cells = 4_000_000

    def score(batches):
        idf, first, of, qids = shared.value
        nq, held = len(qids), np.full((len(qids), k), -np.inf)                        # the k best scores so far
        for batch in batches:
            lists = batch.column(1)
            at = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            flat = lists.flatten()
            tid, dl, tf_ = (np.asarray(flat.field(i)).astype(np.int64) for i in range(3))
            w = idf[tid] * (tf_ * (k1 + 1.0) / (tf_ + k1 * (1.0 - b + b * dl / avgdl)))
            n_of = first[tid + 1] - first[tid]
            pairs = np.concatenate([[0], np.cumsum(n_of)])
            lo, n = 0, len(at) - 1
            while lo < n:                                                             # bounded pairs and score matrix
                hi = int(np.searchsorted(pairs[at], pairs[at[lo]] + cells, "right")) - 1
                hi = min(n, max(lo + 1, hi), lo + max(1, cells // nq))
                e = slice(at[lo], at[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(at[lo:hi + 1]))
                many = n_of[e]
                q = of[np.repeat(first[tid[e]] - (pairs[at[lo]:at[hi]] - pairs[at[lo]]), many) + np.arange(many.sum())]
                cell = q * (hi - lo) + np.repeat(row, many)
                s = np.bincount(cell, np.repeat(w[e], many), nq * (hi - lo)).reshape(nq, hi - lo)
                s = np.floor(s * 1e6 + 0.5) / 1e6
                none = np.ones(s.size, bool)
                none[cell] = False                                                    # shares no term
                s[none.reshape(s.shape)] = -np.inf
                best = np.partition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else s
                held = np.partition(np.concatenate([held, best], axis=1), -k, axis=1)[:, -k:]
                r, c = np.nonzero((s >= held.min(axis=1)[:, None]) & (s > -np.inf))   # ties at the k-th score stay
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in r], names[0]), batch.column(0).take(pa.array(c + lo)).cast(names[1]),
                                                  pa.array(s[r, c])], schema=pa.schema([(q_key, names[0]), (d_key, names[1]), ("score", pa.float64())]))
                lo = hi

    from pyspark.sql.pandas.types import to_arrow_type
    names = (to_arrow_type(q_type), to_arrow_type(d_type))
    return by_doc.mapInArrow(score, out)


def _join_postings(index, qt, q_key, d_key, n_docs, avgdl, k1, b) -> DataFrame:
    n_qt = qt.count()
    postings = index.join(broadcast_if_bounded(qt.select("term").distinct(), n_qt), "term")
    df_ = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1.0 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tfw = F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.lit(avgdl)))
    contrib = postings.join(broadcast_if_bounded(df_, n_qt), "term").select(d_key, "term", (idf * tfw).alias("c"))
    return (broadcast_if_bounded(qt, n_qt).join(contrib, "term")
            .groupBy(q_key, d_key).agg(F.round(F.sum("c"), 6).alias("score")))
