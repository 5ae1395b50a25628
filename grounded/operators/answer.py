"""Answer pipelines and request handling (O32-O36, O33 flagship).

A request is a row; a pipeline is a chain of column transformations over the
request DataFrame.  Only retrieval shuffles; completion and guards are narrow."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.config import AnswerConfig, EmbedConfig, SearchConfig, TextConfig
from grounded.functions import text as tf
from grounded.operators import context as ctxop
from grounded.operators import generate, guard
from grounded.operators import text as txt
from grounded.operators import embed
from grounded.operators.search import VecCol, project_hits, search
from grounded.session import MAX_BROADCAST_ROWS, broadcast_if_bounded, materialize

# ---- fixed values -------------------------------------------------------------
ERROR_BODY = "Sorry, cannot generate an answer at this time! Reason: {reason}\n"
STATUS_OK, STATUS_BAD_REQUEST, STATUS_ERROR = 200, 400, 500
ROUTE_PLAIN, ROUTE_RAG = "/query", "/ragquery"
QUERY_KEY = "query"        # request field, matched case-insensitively
CHUNK_ID_BITS = 24         # chunk id = doc_id * 2^24 + window index
CHUNK_ID_SHIFT = 1 << CHUNK_ID_BITS
MAX_DOC_ID = (1 << (63 - CHUNK_ID_BITS)) - 1
WINDOW_DIGITS = 8          # of the window index in the chunk id of any other document
# ------------------------------------------------------------------------------


def chunk_ids(chunks: DataFrame, doc_col: str = "doc_id", i_col: str = "i") -> DataFrame:
    """Single LONG id whose order equals (doc_id, i) order (for tie-breaks).

    Exact for 0 <= doc_id < 2^39 and fewer than 2^24 windows per document (a
    document row is capped at 2 GB, far below 2^24 windows); out-of-range ids
    fail loudly instead of colliding."""
    d = F.col(doc_col).cast("long")
    ok = (d >= 0) & (d <= MAX_DOC_ID) & (F.col(i_col) < CHUNK_ID_SHIFT)
    cid = F.shiftleft(d, CHUNK_ID_BITS) + F.col(i_col)
    return chunks.withColumn("chunk_id", F.when(ok, cid).otherwise(
        F.raise_error(F.lit("doc_id or window index out of range for chunk ids")).cast("long")))


def document_keys(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", out: str = "_key") -> DataFrame:
    """``out``: a string per (id, text), in the order of the ids, whatever their type; null ids come last.

    Integers are written as 16 hexadecimal digits of their offset from the smallest LONG, other ids as the
    hexadecimal bytes of their text; the hash of the text tells documents that share an id apart."""
    t = docs.schema[doc_col].dataType
    d = F.col(doc_col)
    if isinstance(t, T.IntegralType):
        shown = F.lpad(F.hex(d.cast("long").bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    else:
        shown = F.hex(F.encode(d.cast("string"), "UTF-8"))
    return docs.withColumn(out, F.concat(F.coalesce(shown, F.lit("~")), F.lit(" "),
                                         F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, 32)))


def plain_ids(docs: DataFrame, doc_col: str = "doc_id") -> bool:
    """Whether every id is an integer that ``chunk_ids`` can hold and stands in one row only (one narrow aggregate)."""
    if not isinstance(docs.schema[doc_col].dataType, T.IntegralType):
        return False
    d = F.col(doc_col)
    per_id = docs.groupBy(d.alias("d")).agg(F.count(F.lit(1)).alias("n"))
    odd = F.col("d").isNull() | (F.col("d") < 0) | (F.col("d") > MAX_DOC_ID) | (F.col("n") > 1)
    return per_id.where(odd).limit(1).count() == 0


def chunk_index(docs: DataFrame, ecfg: EmbedConfig = EmbedConfig(), tcfg: TextConfig = TextConfig(),
                plain: bool | None = None) -> DataFrame:
    """The searchable chunk collection ``(chunk_id, cb)``: window ids and hashed tokens.

    ``chunk_id`` is one LONG (``chunk_ids``) for plain ids (``plain_ids``, asked of the table unless ``plain`` is given), else the
    document's key and eight digits of the window index."""
    if plain_ids(docs) if plain is None else plain:
        return chunk_ids(txt.window_buckets(docs, "text", ["doc_id"], ecfg.dim, tcfg)).select("chunk_id", "cb")
    wins = txt.window_buckets(document_keys(docs), "text", ["_key"], ecfg.dim, tcfg)
    return wins.select(F.concat("_key", F.lpad(F.col("i").cast("string"), WINDOW_DIGITS, "0")).alias("chunk_id"), "cb")


def build_chunk_index(spark: SparkSession, docs: DataFrame, path: str, ecfg: EmbedConfig = EmbedConfig(),
                      tcfg: TextConfig = TextConfig()) -> DataFrame:
    """Persist the chunk collection once (e.g. before a question stream starts)."""
    chunk_index(docs, ecfg, tcfg).write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)


def retrieve(spark: SparkSession, questions: DataFrame, docs: DataFrame, q_key: str, q_text: str,
             cfg: SearchConfig, ecfg: EmbedConfig = EmbedConfig(), tcfg: TextConfig = TextConfig(),
             index: DataFrame | None = None, pivots=None, cell_col: str | None = None) -> DataFrame:
    """O04 + O07 + O14 + O18 + O20: questions x token-window chunks of ``docs(doc_id, text)``.

    The search honours ``cfg`` (``search.search``): approximate with ``pivots`` unless ``exact``, only indexed
    chunks with ``indexed_only`` and an index that has a cell column.

    Returns ``(qid, doc_id, i, chunk, score, rk)``.  Scoring reads only window
    ids and hashed tokens.  The winners (bounded by |questions| * k) are then
    broadcast against the document scan and only each winner's own window text
    is rebuilt; the scoring result is consumed once, so it is computed once.

    Ids may be of any type, null, negative or repeated: equal scores go to the smaller id (null last), then by the
    hash of the text and the window index; rows that share an id are documents of their own, and every repetition of a
    row (same id, same text) is a hit of its own.  Documents without text have no windows."""
    dim = ecfg.dim
    q = questions.select(q_key, tf.token_buckets(tf.strip_newlines(q_text), dim).alias("qb"))
    cvec = index if index is not None else chunk_index(docs, ecfg, tcfg)
    n_q = questions.count()
    hits = search(spark, q, cvec, q_id=q_key, q_vec=VecCol("qb", "buckets", dim), c_id="chunk_id",
                  c_vec=VecCol("cb", "buckets", dim), cfg=cfg, pivots=pivots, cell_col=cell_col, dim_hint=dim,
                  n_questions=n_q)
    stride = tcfg.window_tokens - tcfg.window_overlap
    chunk = F.array_join(F.slice(tf.tokens("text"), F.col("i") * stride + 1, tcfg.window_tokens), " ")
    bound = n_q * cfg.k if cfg.k else MAX_BROADCAST_ROWS + 1    # winners <= |questions| * k
    if isinstance(cvec.schema["chunk_id"].dataType, T.IntegralType):
        hits = hits.select("qid", F.shiftright("chunk_id", CHUNK_ID_BITS).alias("doc_id"),
                           F.col("chunk_id").bitwiseAND(F.lit(CHUNK_ID_SHIFT - 1)).alias("i"), "score", "rk")
        found = docs.select("doc_id", "text").join(broadcast_if_bounded(hits, bound), "doc_id")
        return found.select("qid", "doc_id", "i", chunk.alias("chunk"), "score", "rk")
    cut = F.length("chunk_id") - WINDOW_DIGITS
    hits = materialize(hits.select("qid", F.substring(F.col("chunk_id"), F.lit(1), cut).alias("_key"),
                                   F.substring(F.col("chunk_id"), cut + 1, F.lit(WINDOW_DIGITS)).cast("long").alias("i"), "score", "rk"), "hits")
    wanted = broadcast_if_bounded(hits.select("_key").distinct(), bound)
    # A row that is repeated, however often, leaves one text per task before it is shuffled.
    texts = (document_keys(docs.select("doc_id", "text")).join(wanted, "_key", "left_semi")
             .groupBy("_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")))
    return texts.join(broadcast_if_bounded(hits, bound), "_key").select("qid", "doc_id", "i", chunk.alias("chunk"), "score", "rk")


def grounded_answer(spark: SparkSession, questions: DataFrame, docs: DataFrame, *, q_key: str = "item_id",
                    q_text: str = "text", cfg: SearchConfig = SearchConfig(k=1),
                    answer_cfg: AnswerConfig = AnswerConfig(),
                    model: generate.CompletionProvider | None = None,
                    guard_provider: guard.GuardProvider | None = None,
                    output_guard: guard.GuardProvider | None = None,
                    index: DataFrame | None = None) -> DataFrame:
    """Retrieve -> best chunk -> prompt -> complete -> response guard -> status.

    No request guard unless ``answer_cfg.guard_request_on_rag``; refused questions
    then skip retrieval and the model and come back as refusals.  The response
    guard defaults to the request guard (one guard model serves both)."""
    guard_provider = guard_provider or guard.RuleGuard()
    output_guard = output_guard or guard_provider
    qs = questions.select(q_key, q_text)
    refused = None
    if answer_cfg.guard_request_on_rag:
        req = guard.guard_request(qs, q_text, guard_provider, q_key)
        refused = req.where(~F.col("passed")).select(q_key, "error")
        qs = req.where(F.col("passed")).select(q_key, q_text)
    hits = retrieve(spark, qs, docs, q_key, q_text, cfg, index=index)
    ctx = ctxop.context_top1(qs, hits, q_key, ["doc_id", "i"])
    prompts = ctxop.build_prompt(ctx, q_text, "ctx")
    done = generate.complete(prompts, "prompt", model, answer_cfg.main_temperature)
    checked = guarded(done, output_guard, q_key)
    out = (checked.withColumn("has_context", F.col("ctx") != "")
           .withColumn("prompt_tokens", F.size(tf.tokens("prompt")).cast("long")))
    if refused is not None:
        out = out.unionByName(refused.withColumn("has_context", F.lit(False)), allowMissingColumns=True)
    return response_status(out, "answer", "error")


def guarded(done: DataFrame, output_guard: guard.GuardProvider, q_key: str) -> DataFrame:
    """O27 on completed rows.  A row whose model failed keeps the model's own error: it has nothing to guard."""
    checked = guard.guard_response(done.withColumnRenamed("error", "_model_error"), "completion", output_guard, q_key)
    failed = F.col("_model_error").isNotNull()
    return (checked.withColumn("answer", F.when(~failed, F.col("answer")))
            .withColumn("verdict", F.when(~failed, F.col("verdict")))
            .withColumn("error", F.coalesce("_model_error", "error")).drop("_model_error"))


def plain_answer(df: DataFrame, *, q_key: str = "item_id", q_text: str = "text",
                 answer_cfg: AnswerConfig = AnswerConfig(),
                 model: generate.CompletionProvider | None = None,
                 guard_provider: guard.GuardProvider | None = None,
                 output_guard: guard.GuardProvider | None = None) -> DataFrame:
    """Request guard -> complete -> response guard.  Refused requests skip the model."""
    guard_provider = guard_provider or guard.RuleGuard()
    output_guard = output_guard or guard_provider
    req = guard.guard_request(df.select(q_key, q_text), q_text, guard_provider, q_key)
    refused = req.where(~F.col("passed")).select(q_key, F.lit(None).cast("string").alias("answer"), "error")
    ok = req.where(F.col("passed")).select(q_key, F.col("query_out").alias("prompt"))
    done = generate.complete(ok, "prompt", model, answer_cfg.main_temperature)
    checked = guarded(done, output_guard, q_key).select(q_key, "answer", "error")
    return response_status(checked.unionByName(refused), "answer", "error")


def response_status(df: DataFrame, answer_col: str = "answer", error_col: str = "error") -> DataFrame:
    """Error (refusals included) -> 500 with apology and reason, else 200 and the text."""
    err = F.col(error_col)
    body = F.when(err.isNotNull(), F.concat(F.lit(ERROR_BODY.split("{reason}")[0]), err,
                                            F.lit(ERROR_BODY.split("{reason}")[1])))
    return (df.withColumn("status", F.when(err.isNotNull(), F.lit(STATUS_ERROR)).otherwise(F.lit(STATUS_OK)))
            .withColumn("body", F.coalesce(body, F.col(answer_col))))


def _decoded(body: str | None) -> tuple[int, str | None]:
    """One request body as the service's decoder reads it: the first JSON value; keys in any case; every
    occurrence of the key counts in turn, the last one wins and a null leaves what was there."""
    import json

    def refuse(_):
        raise ValueError("not JSON")

    try:
        pairs, _ = json.JSONDecoder(object_pairs_hook=lambda p: ("object", p), parse_constant=refuse).raw_decode((body or "").lstrip(" \t\r\n"))
    except (ValueError, RecursionError):
        return STATUS_BAD_REQUEST, None
    if pairs is None:
        return STATUS_OK, ""
    if not (isinstance(pairs, tuple) and pairs[0] == "object"):
        return STATUS_BAD_REQUEST, None
    query = ""
    for k, v in pairs[1]:
        if k.lower() == QUERY_KEY and v is not None:
            if not isinstance(v, str):
                return STATUS_BAD_REQUEST, None
            query = v
    return STATUS_OK, query


# A body that is an object of one plain key and one plain string (no escapes, no control characters): nothing in it can be read
# in two ways, so the JVM's pattern gives what the decoder would.
_PLAIN_BODY = r'^[ \t\r\n]*\{[ \t\r\n]*"([A-Za-z0-9_]*)"[ \t\r\n]*:[ \t\r\n]*"([^"\\\x00-\x1f]*)"[ \t\r\n]*\}'


def decode_request(df: DataFrame, body_col: str = "body") -> DataFrame:
    """JSON body -> query.  Malformed JSON or a non-object body -> 400 (a JSON ``null`` body is an empty
    request); a missing or null value gives ``''``; a non-string value -> 400.

    Plain bodies, the common case, are read by a pattern in the JVM.  Built-in JSON functions drop repeated keys or their
    order, so all other bodies are decoded in Python, per Arrow batch; plain ones reach it as nulls."""
    @F.pandas_udf("status int, query string")
    def decode(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_decoded(b) for b in bodies], columns=["status", "query"])

    body = F.col(body_col)
    plain = F.coalesce(body.rlike(_PLAIN_BODY), F.lit(False))
    named = F.lower(F.regexp_extract(body, _PLAIN_BODY, 1)) == QUERY_KEY
    read = F.struct(F.lit(STATUS_OK).alias("status"), F.when(named, F.regexp_extract(body, _PLAIN_BODY, 2)).otherwise("").alias("query"))
    return (df.withColumn("_o", decode(F.when(~plain, body))).withColumn("_d", F.when(plain, read).otherwise(F.col("_o")))
            .select(*df.columns, "_d.status", "_d.query"))


def answer_from_collection(spark: SparkSession, questions: DataFrame, collection: DataFrame, *, q_key: str = "item_id",
                           q_text: str = "text", cfg: SearchConfig = SearchConfig(k=1), dim: int = 768,
                           pivots=None, cell_col: str | None = None,
                           model: generate.CompletionProvider | None = None,
                           guard_provider: guard.GuardProvider | None = None) -> DataFrame:
    """O33 over a stored collection (``point_id``, ``path``, ``chunk``, ``embedding``): embed the question, search
    the stored vectors, answer from the stored chunk.  Nothing is embedded or read from the corpus again."""
    asked = embed.dense_embed(questions.select(q_key, q_text), q_text, out="qv", cfg=EmbedConfig(dim=dim), float32=False)
    hits = search(spark, asked, collection, q_id=q_key, q_vec=VecCol("qv", dim=dim), c_id="point_id",
                  c_vec=VecCol("embedding", dim=dim), cfg=cfg, pivots=pivots, cell_col=cell_col, dim_hint=dim)
    found = project_hits(hits, collection, "point_id", ["path", "chunk"])
    ctx = ctxop.context_top1(questions.select(q_key, q_text), found, q_key, ["point_id", "path"])
    done = generate.complete(ctxop.build_prompt(ctx, q_text, "ctx"), "prompt", model)
    return response_status(guarded(done, guard_provider or guard.RuleGuard(), q_key), "answer", "error")


def answer_batch(spark: SparkSession, requests: DataFrame, docs: DataFrame, *, q_key: str = "item_id",
                 q_text: str = "text", route_col: str = "route", cfg: SearchConfig = SearchConfig(k=1),
                 answer_cfg: AnswerConfig = AnswerConfig()) -> DataFrame:
    """Dispatch by route; each pipeline runs on its share, results are unioned."""
    plain = plain_answer(requests.where(F.col(route_col) == ROUTE_PLAIN).select(q_key, q_text),
                         q_key=q_key, q_text=q_text, answer_cfg=answer_cfg)
    rag = grounded_answer(spark, requests.where(F.col(route_col) == ROUTE_RAG).select(q_key, q_text), docs,
                          q_key=q_key, q_text=q_text, cfg=cfg, answer_cfg=answer_cfg)
    cols = [q_key, "status", "body"]
    return (plain.select(*cols, F.lit(ROUTE_PLAIN).alias(route_col))
            .unionByName(rag.select(*cols, F.lit(ROUTE_RAG).alias(route_col))))
