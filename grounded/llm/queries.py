"""The registered queries of this subpackage: ``opN_<name>`` over whole tables, and the pipeline."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grounded.llm.common import read
from grounded.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


@query("op2_byte_bpe")
def op2(spark, sf_dir):
    from grounded.llm import bpe
    return bpe.digests(read(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])

@query("op4_language_id")
def op4(spark, sf_dir):
    from pyspark.sql import functions as F

    from grounded.llm import langid
    from grounded.llm.common import crc_bucket
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.where(crc_bucket("doc_id", 4) != 2))
    found = langid.identify(docs.drop("lang"), model, ["doc_id"])
    return found.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op6_chat_format")
def op6(spark, sf_dir):
    from grounded.llm import chat
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    own = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)],
                                  "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_conversations(rows.unionByName(extra)))


@query("op8_warc")
def op8(spark, sf_dir):
    from grounded.llm import warc
    found = warc.archived(read(spark, sf_dir, "pages", "page_id", "url", "html"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# The same shards stated over all prefix lengths at once: a row's shard is its shortest prefix that fits.
_BITS = ("array_to_string(list_transform(string_split(md5(coalesce(doc_id::VARCHAR, '')), ''), lambda c: "
         "substr('0000000100100011010001010110011110001001101010111100110111101111', "
         "4 * strpos('0123456789abcdef', c)::INT - 3, 4)), '')")


@query("op10_extendible_shards", f"""
WITH r AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, {_BITS} AS b FROM documents),
     p AS (SELECT r.*, depth::INT AS depth, substr(b, 1, depth::INT) AS shard FROM r, range(0, 65) t(depth)),
     s AS (SELECT *, sum(n_bytes) OVER w AS shard_bytes, count(*) OVER w AS shard_rows FROM p
           WINDOW w AS (PARTITION BY depth, shard))
SELECT doc_id, n_bytes, shard, depth, shard_bytes::BIGINT AS shard_bytes, shard_rows::BIGINT AS shard_rows
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
      FROM s WHERE shard_bytes <= 1048576 OR shard_rows = 1) WHERE k = 1""")
def op10(spark, sf_dir):
    from grounded.llm import sharding
    rows, _directory = sharding.assign(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return rows


@query("op5_html_text")
def op5(spark, sf_dir):
    from grounded.llm import html
    return html.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"), html.train(spark))


@query("op9_toxicity")
def op9(spark, sf_dir):
    from grounded.llm import toxicity
    from grounded.llm.common import crc_bucket
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(crc_bucket("doc_id", 5) != 0)
    found = toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"])
    return found.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query("op1_prefix_forest")
def op1(spark, sf_dir):
    from grounded.llm import ann
    return ann.search(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda vec_id: vec_id % 20 == 0)


@query("op3_jaccard_join")
def op3(spark, sf_dir):
    from pyspark.sql import functions as F

    from grounded.llm import jaccard
    found = jaccard.join(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_texts", "copy_of")


@query("op7_decontaminate")
def op7(spark, sf_dir):
    from grounded.llm import decontaminate
    return decontaminate.leaks(read(spark, sf_dir, "documents", "doc_id", "text"),
                               read(spark, sf_dir, "benchmark", "item_id", "text"))


# CRC-32 of the decimal id, bit by bit: duckdb has no function for it.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in fields) + ")"


@query("op11_merkle_manifest", f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('v' || lang, '-') AS g, {_leaf_sql("text")} AS d,
         CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(l, g, pos, d, n) AS (
  SELECT 0, g, pos, d, n FROM placed
  UNION ALL
  SELECT l + 1, g, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY l, g, pos // 8, n),
subroots AS (
  SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(l, pos, d, n) AS (
  SELECT 0, pos, d, n FROM subroots
  UNION ALL
  SELECT l + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (n + 7) // 8 FROM crown WHERE n > 1 GROUP BY l, pos // 8, n),
nodes AS (
  SELECT l, g, pos, d FROM tree WHERE n > 1 UNION ALL SELECT 100 + l, '', pos, d FROM crown WHERE n > 1),
sides AS (
  SELECT l, g, pos,
         coalesce(string_agg(d, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(d, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM nodes WINDOW r AS (PARTITION BY l, g, pos // 8 ORDER BY pos)),
steps AS (
  SELECT p.doc_id, s.lft, s.rgt, row_number() OVER (PARTITION BY p.doc_id ORDER BY s.l) AS k
  FROM placed p JOIN subroots r ON r.g = p.g
  JOIN sides s ON (s.l < 100 AND s.g = p.g AND s.pos = p.pos // (8 ** s.l)::BIGINT)
               OR (s.l >= 100 AND s.pos = r.pos // (8 ** (s.l - 100))::BIGINT)),
proofs AS (SELECT doc_id, sha256(string_agg(lft || rgt, '' ORDER BY k)) AS proof_sha256, max(k) AS depth FROM steps GROUP BY doc_id),
folded(doc_id, k, d) AS (
  SELECT doc_id, 0::BIGINT, coalesce(changed, d) FROM placed
  UNION ALL
  SELECT f.doc_id, s.k, sha256(s.lft || f.d || s.rgt) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
top AS (SELECT d AS root FROM crown WHERE n = 1)
SELECT p.doc_id, p.d AS leaf, r.d AS subroot, top.root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256, f.d AS folded_root,
       f.d = top.root AS verified
FROM placed p JOIN subroots r ON r.g = p.g LEFT JOIN proofs q ON q.doc_id = p.doc_id
JOIN folded f ON f.doc_id = p.doc_id AND f.k = coalesce(q.depth, 0) CROSS JOIN top""")
def op11(spark, sf_dir):
    from pyspark.sql import functions as F

    from grounded.llm import merkle
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    found = merkle.manifest(read(spark, sf_dir, "documents", *fields), "doc_id", "lang", fields,
                            F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, ("text", merkle.lower_ascii(F.col("text"))))
    return merkle.proofs(found).withColumnRenamed("id", "doc_id")


@query("op12_bloom_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op12(spark, sf_dir):
    from grounded.llm import dedup
    return dedup.decide(read(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


@query("op13_whitening")
def op13(spark, sf_dir):
    from grounded.llm import whitening
    rows = whitening.quantised(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return whitening.whiten(rows, whitening.fit(rows)).withColumnRenamed("id", "vec_id")
