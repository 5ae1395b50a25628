"""Corpus pipeline: from raw documents to token ids, in stages that each reread what the one before wrote.

Each stage is one operator of ``grounded.llm`` and works on all rows that the stage before kept.  The first four
return rows of ``documents`` with all columns, the last one ids per document.  Null and empty texts go in the
first stage, as they have no language; repeated rows stay together until the third, which leaves one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grounded.llm import bpe, decontaminate, jaccard, langid, toxicity
from grounded.llm.common import as_text, checkpointed, crc_bucket, keep_rows, read
from grounded.session import ship_package


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents without a language go."""
    model = langid.fit(docs.where(crc_bucket("doc_id", 4) != 2))
    shared = spark.sparkContext.broadcast(model)
    return keep_rows(docs, "text", lambda: lambda t: shared.value.predict(as_text(t))[0] != langid.UNKNOWN)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents that score as toxic go."""
    labels = read(spark, sf_dir, "labels", "doc_id", "toxic").where(crc_bucket("doc_id", 5) != 0)
    shared = spark.sparkContext.broadcast(toxicity.fit(docs, labels))
    return keep_rows(docs, "text", lambda: lambda t: shared.value.score(as_text(t)) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: the document of the smallest id of each group of near-duplicates stays."""
    return jaccard.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a copy of a test item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one row per document with its number of ids and both digests."""
    return bpe.digests(docs, ["doc_id"])


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates),
          ("benchmark", benchmark), ("byte_bpe", encode)]

# Learned models and hashing decide which rows stay: SQL cannot restate that, tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the shared folder and reread."""
    ship_package(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
