"""Context selection and prompt assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grounded.functions import text as tf

# ---- fixed values: prompt templates (own wording, the reference's slots) ----
SYSTEM_LINE = "You are a helpful assistant."
WITH_CONTEXT = SYSTEM_LINE + "\nUse the context below as your primary source when you answer.\n\nContext:\n{context}\n\nQuestion: {question}"
WITHOUT_CONTEXT = SYSTEM_LINE + "\nAnswer the question below.\n\nQuestion: {question}"
CONTEXT_ONLY = (SYSTEM_LINE + "\nAnswer only from the context below. If the context does not contain the answer, "
                "say that you do not know.\n\nContext:\n{context}\n\nQuestion: {question}")
HIT_SEPARATOR = "\n\n"
# ------------------------------------------------------------------------------


def _fill(template: str, **cols) -> F.Column:
    """Template with ``{slot}`` markers -> concat of literals and columns."""
    parts, rest = [], template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        slot, _, rest = tail.partition("}")
        parts += [F.lit(pre), F.coalesce(cols[slot], F.lit(""))]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def context_top1(questions: DataFrame, hits: DataFrame, q_key: str, hit_cols: list[str],
                 chunk_col: str = "chunk") -> DataFrame:
    """The rank-1 hit's chunk; questions without a hit get ``''`` (left join)."""
    best = hits.where(F.col("rk") == 1).select(F.col("qid").alias(q_key), *hit_cols, "score",
                                                F.col(chunk_col).alias("ctx"))
    return (questions.join(best, q_key, "left")
            .withColumn("ctx", F.coalesce(F.col("ctx"), F.lit(""))))


def context_concat(questions: DataFrame, hits: DataFrame, q_key: str, k: int, chunk_col: str = "chunk",
                   cite_cols: list[str] | None = None) -> DataFrame:
    """Top-k hit texts joined in rank order, plus a citation string.

    Per-question aggregation holds at most k rows (ranked upstream)."""
    cite_cols = cite_cols or []
    top = hits.where(F.col("rk") <= k)
    cite = F.concat_ws(":", F.col("rk").cast("string"), *[F.col(c).cast("string") for c in cite_cols],
                       F.format_string("%.6f", F.col("score"))) if cite_cols else F.lit("")
    agg = (top.groupBy(F.col("qid").alias(q_key))
           .agg(F.sort_array(F.collect_list(F.struct("rk", F.col(chunk_col).alias("c"), cite.alias("s"))))
                .alias("_h")))
    agg = agg.select(q_key, F.size("_h").alias("n_hits"),
                     F.array_join(F.transform("_h", lambda x: x["c"]), HIT_SEPARATOR).alias("ctx"),
                     F.array_join(F.transform("_h", lambda x: x["s"]), ";").alias("sources"))
    return (questions.join(agg, q_key, "left")
            .select(*questions.columns, F.coalesce("n_hits", F.lit(0)).alias("n_hits"),
                    F.coalesce("ctx", F.lit("")).alias("ctx"), F.coalesce("sources", F.lit("")).alias("sources")))


def joined_windows(hits: DataFrame, doc_col: str, i_col: str, stride: int, budget: int, chunk_col: str = "chunk") -> DataFrame:
    """R02 without repetition: ``(qid, ctx, n_tokens, n_parts)`` from a question's ranked token windows.

    Windows of one document overlap, so the hits are read as token intervals ``[i * stride, i * stride + tokens)``.  In rank order
    each hit adds the tokens that its document has not given yet, until ``budget`` tokens are reached (the last hit is cut
    there).  What was taken is then joined: intervals of a document that touch become one part; parts stand in the
    order of their document's best hit and of their place in it, separated like the hits of ``context_concat``.

    No token of a document stands twice, and a question's row holds its k hits at most, so nothing is shuffled but
    the hits."""
    toks = tf.tokens(chunk_col)
    doc = F.struct(*[F.col(c) for c in ([doc_col] if isinstance(doc_col, str) else doc_col)])
    begin = F.col(i_col).cast("long") * stride
    hit = F.struct("rk", doc.alias("doc"), begin.alias("start"), toks.alias("t"))
    rows = hits.groupBy("qid").agg(F.sort_array(F.collect_list(hit)).alias("_h"))
    # One row per token that is new to its document: its first hit in rank order gives it.
    one = rows.select("qid", F.explode(F.flatten(F.transform("_h", lambda h: F.transform(h["t"], lambda t, j: F.struct(
        h["rk"].alias("rk"), h["doc"].alias("doc"), (h["start"] + j).alias("at"), t.alias("t")))))).alias("x"))
    best = one.groupBy("qid", "x.doc", "x.at").agg(F.min(F.struct("x.rk", "x.t")).alias("b")).select("qid", "doc", "at", "b.rk", "b.t")
    # A question has at most k windows of tokens: the window below is bounded by the settings, not by the data.
    order = Window.partitionBy("qid").orderBy("rk", "at")
    taken = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= budget)
    per_doc = Window.partitionBy("qid", "doc")
    taken = (taken.withColumn("first", F.min("rk").over(per_doc))
             .withColumn("gap", F.col("at") - F.row_number().over(per_doc.orderBy("at"))))
    parts = (taken.groupBy("qid", "first", "doc", "gap").agg(F.sort_array(F.collect_list(F.struct("at", "t"))).alias("p"))
             .select("qid", F.struct("first", F.col("p")[0]["at"].alias("at"), F.array_join(F.transform("p", lambda x: x["t"]), " ").alias("text"),
                                     F.size("p").alias("n")).alias("part")))
    return (parts.groupBy("qid").agg(F.sort_array(F.collect_list("part")).alias("p"))
            .select("qid", F.array_join(F.transform("p", lambda x: x["text"]), HIT_SEPARATOR).alias("ctx"),
                    F.aggregate("p", F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_tokens"), F.size("p").alias("n_parts")))


def build_prompt(df: DataFrame, question_col: str = "text", ctx_col: str = "ctx",
                 context_only: bool = False, out: str = "prompt") -> DataFrame:
    """Choose the template by testing the context string (empty = none)."""
    q, c = F.col(question_col), F.col(ctx_col)
    with_ctx = _fill(CONTEXT_ONLY if context_only else WITH_CONTEXT, context=c, question=q)
    return df.withColumn(out, F.when(F.coalesce(c, F.lit("")) == "", _fill(WITHOUT_CONTEXT, question=q))
                         .otherwise(with_ctx))
