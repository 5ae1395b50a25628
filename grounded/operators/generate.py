"""Batch completion (O25) behind a provider seam.

A provider either offers a JVM ``expr`` (kept inside codegen) or a pandas
``complete`` called once per Arrow batch.  Failures become a per-row ``error``
value; a task is never failed by a provider, and calls must be safe to retry."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.functions import text as tf

# ---- fixed values: stand-in model output shape ----
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
ANSWER_PREFIX = "Answer: "
CONTEXT_PATTERN = r"(?s)Context:\n(.*)\n\nQuestion: "
QUESTION_PATTERN = r"(?s)^.*Question: (.*)$"
# ------------------------------------------------------------------------------


class CompletionProvider:
    name = "provider"

    def expr(self, prompt: Column, temperature: float) -> Column | None:
        return None

    def complete(self, prompts: pd.Series, temperature: float) -> pd.DataFrame:  # pragma: no cover
        """Return a frame with ``completion`` and ``error`` columns, one row per prompt."""
        raise NotImplementedError


class StandinModel(CompletionProvider):
    """Deterministic offline model: a reasoning block, then an answer that echoes
    the whole context (or the question when there is none)."""
    name = "standin-main"

    def expr(self, prompt: Column, temperature: float) -> Column:
        ctx = F.regexp_extract(prompt, CONTEXT_PATTERN, 1)
        q = F.regexp_extract(prompt, QUESTION_PATTERN, 1)
        body = F.when(ctx != "", ctx).when(q != "", q).otherwise(prompt)
        return F.concat(F.lit(THINK_OPEN), F.md5(prompt), F.lit(THINK_CLOSE + "\n" + ANSWER_PREFIX), body)


def complete(df: DataFrame, prompt_col: str = "prompt", provider: CompletionProvider | None = None,
             temperature: float = 0.0, out: str = "completion") -> DataFrame:
    provider = provider or StandinModel()
    e = provider.expr(F.col(prompt_col), temperature)
    if e is not None:
        return df.withColumn(out, e).withColumn("error", F.lit(None).cast("string"))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType()),
                                              T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            try:
                res = provider.complete(pdf[prompt_col], temperature)
                pdf[out] = res["completion"].to_numpy()
                pdf["error"] = res["error"].to_numpy()
            except Exception as exc:          # provider outage: rows carry the error
                pdf[out] = None
                pdf["error"] = f"completion failed: {exc}"
            yield pdf
    return df.mapInPandas(run, schema)


def strip_reasoning(df: DataFrame, raw_col: str, ans: str = "ans", th: str = "th") -> DataFrame:
    """Answer without reasoning blocks, plus the first block's flattened body."""
    return df.withColumn(ans, tf.strip_think(raw_col)).withColumn(th, tf.think_body(raw_col))
