"""BM25 over postings in blocks with upper bounds (R05): blocks that cannot reach a question's k-th score are not read.

Documents are cut into blocks of at most ``BLOCK`` rows, the same ones for every term.  The index holds a row per (term,
block): the largest term frequency and the smallest length in it, which bound the term's part of any score there, and the
postings themselves.  A question's bound for a block is the sum over its terms.  First the ``first`` blocks of the
highest bounds are scored, which gives each question a k-th score; then, in rounds of four times as many, only the blocks
whose bound reaches it.  Blocks are whole documents for all terms, so a scored block gives complete scores, and the result
equals the full search.

The bounds are narrow columns read without the postings.  No group is larger than a block, whatever term it is: a stop
word is as many rows as there are blocks.

A block's documents are neighbours in one partition, so its postings are put together there, in the task: the build tokenises
every text once, and shuffles the texts and then whole blocks, not a row per posting.  A round's postings are gathered per
block and scored there with the questions that chose the block, so no (question, document) pair is shuffled but a task's best."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.functions import text as tf
from grounded.operators.lexical import BM25_B, BM25_K1, MAX_QUERY_TERMS, query_terms
from grounded.session import broadcast_if_bounded, materialize, small_batches

# Documents of a block: a power of two.
BLOCK_BITS = 6
BLOCK = 1 << BLOCK_BITS
# Blocks that every question reads before it has a k-th score to compare bounds with, and how the rounds after that widen.
FIRST, WIDEN = 4, 4
# The bucket of the rows that hold the ids and lengths of a block.
DOCS = -1
# Rows of a block where documents are repeated, and (question, posting) pairs and scores of one step.
_ROWS, _CELLS = 16 * BLOCK, 4_000_000


def _blocks(rows: DataFrame, d_key: str) -> DataFrame:
    """``term, block, n, max_tf, min_dl, postings`` of ``d_key, _t, _row``, rows numbered on within every partition, and a row
    without a term per block: ``docs`` and ``dls``, the ids and lengths in it, and the ``n_tokens`` of all its rows.

    A posting is ``tf * BLOCK + at``, where ``at`` is the place of its document in the block; rows of one id and length
    follow each other, share it and are not cut apart (but for runs of over ``_ROWS``)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("max_tf", T.IntegerType()), T.StructField("min_dl", T.IntegerType()), T.StructField("postings", T.ArrayType(T.LongType())),
                           T.StructField("docs", T.ArrayType(rows.schema[d_key].dataType)), T.StructField("dls", T.ArrayType(T.IntegerType())),
                           T.StructField("n_tokens", T.LongType())])
    out, find = to_arrow_schema(schema), re.compile(tf.TOKEN_PATTERN).findall

    def grouped(entries, base):
        block, at, dl = (np.array([e[i] for e in entries]) for i in (0, 1, 3))
        new = np.flatnonzero((np.diff(block, prepend=-1) != 0) | (np.diff(at, prepend=-1) != 0))      # a row per document
        own, ends = np.unique(block[new], return_index=True)
        ends = pa.array([*ends, len(new)], pa.int32())
        held = {"docs": [entries[i][2] for i in new], "dls": dl[new]}
        lists = [pa.ListArray.from_arrays(ends, pa.array(v, out.field(c).type.value_type), type=out.field(c).type) for c, v in held.items()]
        nulls = lambda names, n: [pa.nulls(n, out.field(c).type) for c in names]
        yield pa.RecordBatch.from_arrays([*nulls(["term"], len(own)), pa.array(own + base), *nulls(["n", "max_tf", "min_dl", "postings"], len(own)), *lists,
                                          pa.array(np.bincount(block - block[0], dl).astype(np.int64))], schema=out)
        counts = [e[4] for e in entries]
        row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        if not len(row):
            return
        terms = pa.array([t for c in counts for t in c], pa.string()).dictionary_encode()
        tf_, most = np.array([n for c in counts for n in c.values()], dtype=np.int32), int(own[-1] - own[0]) + 1
        key = np.asarray(terms.indices).astype(np.int64) * most + block[row] - own[0]
        order = np.argsort(key, kind="stable")
        key, row, tf_ = key[order], row[order], tf_[order]
        start = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
        yield pa.RecordBatch.from_arrays([
            terms.dictionary.take(pa.array(key[start] // most)), pa.array(key[start] % most + own[0] + base), pa.array(np.diff([*start, len(key)])),
            pa.array(np.maximum.reduceat(tf_, start)), pa.array(np.minimum.reduceat(dl[row], start).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array([*start, len(key)], pa.int32()), pa.array(tf_ * np.int64(BLOCK) + at[row]), type=out.field("postings").type),
            *nulls(["docs", "dls", "n_tokens"], len(start))], schema=out)

    def run(batches):
        entries, base, block, place, n, last = [], None, 0, -1, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            base = int(batch.column(2)[0].as_py()) >> BLOCK_BITS if base is None else base
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = find(text or "")
                if (doc, len(words)) != last or n == _ROWS:
                    place, last = place + 1, (doc, len(words))
                    if place == BLOCK or n == _ROWS:
                        block, place, n = block + 1, 0, 0
                n += 1
                entries.append((block, place, doc, len(words), Counter(words)))
            done = next(i for i, e in enumerate(entries) if e[0] == block)                   # a block may go on in the next batch
            if done:
                yield from grouped(entries[:done], base)
                entries = entries[done:]
        if entries:
            yield from grouped(entries, base)

    return rows.mapInArrow(run, schema)


def build_block_index(docs: DataFrame, path: str, d_key: str = "doc_id", d_text: str = "text", n_buckets: int = 64) -> str:
    """Write ``blocks`` (``term, block, n, max_tf, min_dl, postings``; ``docs, dls, n_tokens``), by buckets of terms, and one row of ``stats``.

    Documents are dealt by ranges of their length in bytes, so a block holds documents of like length and its bounds are close;
    null ids are left out."""
    spark, t, key = docs.sparkSession, F.col(d_text), F.col(d_key)
    small_batches(spark)
    rows = (docs.where(key.isNotNull()).select(d_key, d_text, F.octet_length(t).alias("_n"))
            .repartitionByRange("_n", F.xxhash64(d_key)).sortWithinPartitions("_n", F.xxhash64(d_key))
            # F.lower, not Python's: the SQL side of a comparison lowers the same way
            .select(d_key, F.lower(t).alias("_t"), F.monotonically_increasing_id().alias("_row")))
    ids, salt = F.col("term").isNull(), F.lit(max(1, spark.sparkContext.defaultParallelism // 8))
    blocks = _blocks(rows, d_key).withColumn("tb", F.when(ids, DOCS).otherwise(F.pmod(F.xxhash64("term"), F.lit(n_buckets))).cast("int"))
    (blocks.repartition("tb", F.pmod("block", F.when(ids, n_buckets).otherwise(salt)))
     .sortWithinPartitions("tb", "term", "block").write.mode("errorifexists").partitionBy("tb").parquet(f"{path}/blocks"))
    # Null texts have no length and are not part of the mean.
    tokens = spark.read.schema(blocks.schema).parquet(f"{path}/blocks").where(F.col("tb") == DOCS).agg(F.sum("n_tokens").alias("all"))
    (docs.agg(F.count(key).cast("double").alias("n"), F.count(F.when(key.isNotNull(), t)).alias("texts")).crossJoin(tokens)     # a row each
     .select("n", (F.coalesce("all", F.lit(0)).cast("double") / F.nullif("texts", F.lit(0))).alias("avgdl"))
     .withColumns({"n_buckets": F.lit(n_buckets), "schema": F.lit(blocks.schema.json())}).coalesce(1).write.mode("errorifexists").parquet(f"{path}/stats"))
    return path


def block_topk(questions: DataFrame, path: str, q_key: str = "item_id", q_text: str = "text", d_key: str = "doc_id", k: int = 10,
               k1: float = BM25_K1, b: float = BM25_B, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """``(hits, report)``: ``q_key, d_key, score, rk``, and per question ``n_blocks`` (with any of its terms), ``n_read``."""
    spark = questions.sparkSession
    st = spark.read.parquet(f"{path}/stats").first()
    n_docs, avgdl = F.lit(float(st["n"])), F.lit(float(st["avgdl"] or 0.0))
    qt = materialize(query_terms(questions, q_key, q_text), "block-terms")
    n_qt = qt.count()
    buckets = [r[0] for r in qt.select(F.pmod(F.xxhash64("term"), F.lit(int(st["n_buckets"]))).cast("int")).distinct().collect()]     # n_buckets at most
    stored = spark.read.schema(T.StructType.fromJson(json.loads(st["schema"]))).parquet(f"{path}/blocks")
    index, ids = stored.where(F.col("tb").isin(buckets)), stored.where(F.col("tb") == DOCS).select("block", "docs", "dls")

    def part(tf_: Column, dl: Column) -> Column:
        return tf_ * (k1 + 1.0) / (tf_ + k1 * (1.0 - b + b * dl / avgdl))

    vocabulary = broadcast_if_bounded(qt.select("term").distinct(), n_qt)
    known = index.select("term", "block", "n", "max_tf", "min_dl").join(vocabulary, "term")                      # no postings are read
    idf = materialize(known.groupBy("term").agg(F.sum("n").alias("df")).select(
        "term", F.log(1.0 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "block-idf")
    asked = qt.join(broadcast_if_bounded(idf, n_qt), "term")
    asked = broadcast_if_bounded(asked, n_qt)
    bounds = materialize(known.join(asked, "term").groupBy(q_key, "block")
                         .agg(F.sum(F.col("idf") * part(F.col("max_tf"), F.col("min_dl"))).alias("bound")), "block-bounds")
    order = Window.partitionBy(q_key).orderBy(F.col("bound").desc(), "block")
    ranked = materialize(bounds.withColumn("no", F.row_number().over(order)), "block-order")
    best = Window.partitionBy(q_key).orderBy(F.col("score").desc(), F.col(d_key).asc())

    few = asked.collect() if n_qt <= MAX_QUERY_TERMS else None                                                    # bounded

    def scored(chosen: DataFrame, n: int) -> DataFrame:
        """Complete scores of the documents of the ``n`` chosen (question, block) pairs that can be among the k best of a question.

        Postings of other blocks are dropped at the scan, before a row meets its questions."""
        blocks = broadcast_if_bounded(chosen.select("block").distinct(), n)
        near = index.select("term", "block", "postings").join(blocks, "block", "left_semi")
        if few is not None:
            return _score_blocks(near, chosen, ids, few, questions.schema[q_key], d_key, lambda tf_, dl: tf_ * (k1 + 1.0) / (
                tf_ + k1 * (1.0 - b + b * dl / float(st["avgdl"] or 0.0))), k)
        rows = (near.join(asked, "term").join(broadcast_if_bounded(chosen, n), [q_key, "block"])
                .select(q_key, "block", "idf", F.explode("postings").alias("p")).join(ids, "block"))
        at = F.col("p").bitwiseAND(F.lit(BLOCK - 1)).cast("int")
        return rows.groupBy(q_key, F.get("docs", at).alias(d_key), F.get("dls", at).alias("dl")).agg(
            F.round(F.sum(F.col("idf") * part(F.shiftright("p", BLOCK_BITS), F.get("dls", at))), 6).alias("score")).drop("dl")

    hits, read, done, upto = None, None, 0, first
    while True:
        chosen = ranked.where((F.col("no") > done) & (F.col("no") <= upto))
        if hits is not None:
            reached = hits.where(F.col("rk") == k).select(q_key, F.col("score").alias("least"))
            # Scores are rounded to 6 decimals; a bound may miss the k-th score by that much and still hold a document of it.
            chosen = (chosen.join(reached, q_key, "left")
                      .where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-5)))
        chosen = materialize(chosen.select(q_key, "block"), "block-chosen")
        n_chosen = chosen.count()
        # Blocks come in falling order of their bounds: without one in this round there is none in any later one.
        if hits is not None and not n_chosen:
            break
        new = scored(chosen, n_chosen)
        every = new if hits is None else hits.drop("rk").unionByName(new)
        hits = materialize(every.withColumn("rk", F.row_number().over(best).cast("long")).where(F.col("rk") <= k), "block-hits")
        read = chosen if read is None else read.unionByName(chosen)
        done, upto = upto, upto * WIDEN
    report = (ranked.groupBy(q_key).agg(F.count(F.lit(1)).alias("n_blocks"))
              .join(read.groupBy(q_key).agg(F.count(F.lit(1)).alias("n_read")), q_key))
    return hits, report


def _score_blocks(near: DataFrame, chosen: DataFrame, ids: DataFrame, asked: list, q_field: T.StructField, d_key: str, weight, k: int) -> DataFrame:
    """``q_field, d_key, score`` from the postings ``near`` (``term, block, postings``) of the ``chosen`` (question, block) pairs.

    ``ids``: ``block, docs, dls``; ``asked``: rows of question, term and idf.  Postings, ids and questions of a block come together, sorted by block; a task
    scores a few blocks at a time and emits what reaches the k-th score of a question so far."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

    spark, q_key = near.sparkSession, q_field.name
    d_type = ids.schema["docs"].dataType.elementType
    schema = T.StructType([q_field, T.StructField(d_key, d_type), T.StructField("score", T.DoubleType())])
    if not asked:
        return spark.createDataFrame([], schema)
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in asked}))}
    numbers = {q: i for i, q in enumerate(dict.fromkeys(r[q_key] for r in asked))}
    idf = np.zeros(len(terms))
    for r in asked:
        idf[terms[r["term"]]] = r["idf"]
    # the questions of every term, one after the other
    asks = np.array(sorted((terms[r["term"]], numbers[r[q_key]]) for r in asked), dtype=np.int64)
    first = np.searchsorted(asks[:, 0], np.arange(len(terms) + 1))
    shared = spark.sparkContext.broadcast((idf, first, asks[:, 1], pa.array(list(numbers), to_arrow_type(q_field.dataType))))
    vocab = F.broadcast(spark.createDataFrame(list(terms.items()), "term string, tid int"))
    which = F.broadcast(spark.createDataFrame(list(numbers.items()), T.StructType([q_field, T.StructField("no", T.IntegerType())])))
    of_block = chosen.join(which, q_key).groupBy("block").agg(F.collect_list("no").alias("nos")).join(ids, "block")        # at most the questions
    rows = (near.join(vocab, "term").select("block", "tid", "postings").unionByName(of_block.withColumn("tid", F.lit(-1)), allowMissingColumns=True)
            .repartition("block").sortWithinPartitions("block"))
    out = to_arrow_schema(schema)
    small_batches(spark)

    def score(batches):
        idf, first, of, qids = shared.value
        nq, held = len(qids), np.full((len(qids), k), -np.inf)                       # the k best scores so far

        def step(part):
            block, tid, lists, nos, docs, dls = part.columns
            at_block = np.unique(np.asarray(block), return_inverse=True)[1].ravel()
            nb = int(at_block[-1]) + 1
            open_, n_nos = np.zeros((nq, nb), bool), np.asarray(nos.value_lengths().fill_null(0))
            open_[np.asarray(nos.flatten()), np.repeat(at_block, n_nos)] = True
            n = np.asarray(lists.value_lengths().fill_null(0))
            # ids and lengths of the documents, by place
            of_docs = np.asarray(docs.value_lengths().fill_null(0))
            place = np.repeat(at_block * BLOCK - np.concatenate([[0], np.cumsum(of_docs)[:-1]]), of_docs) + np.arange(of_docs.sum())
            length, some = np.zeros(nb * BLOCK), np.zeros(nb * BLOCK, dtype=np.int64)
            length[place], some[place] = np.asarray(dls.flatten()), np.arange(len(place))
            flat, tid, in_block = np.asarray(lists.flatten()), np.repeat(np.asarray(tid), n), np.repeat(at_block, n)
            row = in_block * BLOCK + flat % BLOCK
            w, many = idf[tid] * weight((flat >> BLOCK_BITS).astype(np.float64), length[row]), first[tid + 1] - first[tid]
            e = np.repeat(np.arange(len(tid)), many)
            q = of[np.repeat(first[tid] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(len(e))] if len(e) else e
            asks = open_[q, in_block[e]]
            q, e = q[asks], e[asks]
            if not len(e):
                return
            cell = q * (nb * BLOCK) + row[e]
            s = np.bincount(cell, w[e], nq * nb * BLOCK).reshape(nq, nb * BLOCK)
            s = np.floor(s * 1e6 + 0.5) / 1e6
            none = np.ones(s.size, bool)
            none[cell] = False                                                       # shares no term, or was not asked for
            s[none.reshape(s.shape)] = -np.inf
            best = np.partition(s, -k, axis=1)[:, -k:] if s.shape[1] > k else s
            held[:] = np.partition(np.concatenate([held, best], axis=1), -k, axis=1)[:, -k:]
            r, c = np.nonzero((s >= held.min(axis=1)[:, None]) & (s > -np.inf))      # ties at the k-th score stay
            yield pa.RecordBatch.from_arrays([qids.take(pa.array(r)), docs.flatten().take(pa.array(some[c])), pa.array(s[r, c])], schema=out)

        def steps(rows):
            """Whole blocks of ``rows``, few enough that scores and pairs stay bounded."""
            block, tid = np.asarray(rows.column(0)), np.asarray(rows.column(1))
            n = np.asarray(rows.column(2).value_lengths().fill_null(0))
            pairs = np.concatenate([[0], np.cumsum(np.where(tid < 0, 0, n * (first[tid + 1] - first[tid])))])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1, [len(block)]])
            most, lo = max(1, _CELLS // (nq * BLOCK)), 0
            while lo < len(cuts) - 1:
                hi = int(np.searchsorted(pairs[cuts], pairs[cuts[lo]] + _CELLS, "right")) - 1
                hi = min(len(cuts) - 1, lo + most, max(lo + 1, hi))
                yield from step(rows.slice(cuts[lo], cuts[hi] - cuts[lo]))
                lo = hi

        held_rows, n_held = [], 0
        for batch in batches:
            held_rows.append(batch)
            n_held += batch.num_rows
            if n_held < 1 << 14:
                continue
            rows = pa.Table.from_batches(held_rows).combine_chunks().to_batches()[0]
            block = np.asarray(rows.column(0))
            full = int(np.searchsorted(block, block[-1]))                            # the last block may go on
            if full:
                yield from steps(rows.slice(0, full))
            held_rows, n_held = [rows.slice(full)], rows.num_rows - full
        if n_held:
            yield from steps(pa.Table.from_batches(held_rows).combine_chunks().to_batches()[0])

    return rows.mapInArrow(score, schema)
