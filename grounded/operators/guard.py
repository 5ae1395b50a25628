"""Moderation.

A guard turns a text into a free-text verdict; only the exact string ``safe``
passes (a trailing newline or other casing fails closed).  Verdicts come from a
provider: a JVM rule set (offline stand-in), a label table join, or a model
called per Arrow batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.config import AnswerConfig
from grounded.functions import text as tf

# ---- fixed values -------------------------------------------------------------
SAFE = "safe"
REQUEST_REFUSAL = "cannot answer your query. It does not conform to our standards"
RESPONSE_REFUSAL = "cannot answer your query. The response might not be good for you"
# Stand-in rule guard: blocked words (violent content) and the privacy patterns.
BLOCKED_WORDS_PATTERN = r"(?i)(bomb|explosive|weapon|poison)"
UNSAFE_VIOLENT = "unsafe\nS1"
UNSAFE_PRIVACY = "unsafe\nS7"
UNSAFE_LABEL = "unsafe\nS10"
# Policy groups of the two moderation policies, in their order.
REQUEST_GROUPS = ("HATE", "VIOLENCE", "SELF_HARM", "SEXUAL", "ILLEGAL", "TOXICITY", "THEMES", "PII")
RESPONSE_GROUPS = ("HATE", "VIOLENCE", "SELF_HARM", "SEXUAL", "ILLEGAL", "PII", "ADVICE", "TOXICITY")
# Structured moderation record.
ALLOW, BLOCK = "ALLOW", "BLOCK"
MODERATION_SCHEMA = "decision STRING, categories ARRAY<STRING>, confidence DOUBLE, brief_rationale STRING"
MIN_CONFIDENCE = 0.5
# ------------------------------------------------------------------------------


class GuardProvider:
    def verdict(self, df: DataFrame, text_col: str, key: str | None = None) -> DataFrame:
        raise NotImplementedError


class RuleGuard(GuardProvider):
    """Offline stand-in guard: blocked words -> S1, personal data -> S7, else ``safe``."""

    @staticmethod
    def expr(text: Column) -> Column:
        pii = F.size(tf.pii_categories(text)) > 0
        return (F.when(text.isNull(), F.lit(None).cast("string"))
                .when(text.rlike(BLOCKED_WORDS_PATTERN), F.lit(UNSAFE_VIOLENT))
                .when(pii, F.lit(UNSAFE_PRIVACY))
                .otherwise(F.lit(SAFE)))

    def verdict(self, df, text_col, key=None):
        return df.withColumn("verdict", self.expr(F.col(text_col)))


class LabelGuard(GuardProvider):
    """Verdicts from a label table ``(key, toxic)``; unlabelled rows get NULL (blocked)."""

    def __init__(self, labels: DataFrame, key: str = "doc_id"):
        self.labels = labels.select(key, "toxic")
        self.key = key

    def verdict(self, df, text_col, key=None):
        v = F.when(F.col("toxic") == 0, F.lit(SAFE)).when(F.col("toxic") == 1, F.lit(UNSAFE_LABEL))
        return df.join(self.labels, key or self.key, "left").withColumn("verdict", v).drop("toxic")


class BatchGuard(GuardProvider):
    """A guard model called once per Arrow batch: ``call(texts, model, temperature)`` returns a verdict per text.

    A failed call leaves NULL verdicts, which do not pass, and the error in ``guard_error``."""

    def __init__(self, call, model: str, temperature: float = 0.0):
        self.call, self.model, self.temperature = call, model, temperature

    def verdict(self, df, text_col, key=None):
        call, model, temperature = self.call, self.model, self.temperature
        schema = T.StructType([*df.schema.fields, T.StructField("verdict", T.StringType()),
                               T.StructField("guard_error", T.StringType())])

        def run(batches):
            for pdf in batches:
                out = pdf.copy()
                try:
                    out["verdict"], out["guard_error"] = list(call(pdf[text_col], model, temperature)), None
                except Exception as exc:  # noqa: BLE001 - the rows carry the error
                    out["verdict"], out["guard_error"] = None, f"guard failed: {exc}"
                yield out

        return df.mapInPandas(run, schema)


def guards(cfg: AnswerConfig, call) -> tuple[BatchGuard, BatchGuard]:
    """Input and output guard with the configured models and temperatures."""
    return (BatchGuard(call, cfg.input_guard_model, cfg.input_temperature),
            BatchGuard(call, cfg.effective_output_guard, cfg.output_temperature))


def passes(verdict: Column) -> Column:
    """Exact, null-safe comparison: NULL, ``Safe`` and ``safe\\n`` all fail."""
    return F.coalesce(verdict.eqNullSafe(F.lit(SAFE)), F.lit(False))


def guard_request(df: DataFrame, text_col: str, guard: GuardProvider, key: str | None = None) -> DataFrame:
    """Passing rows keep the question unchanged; others get the refusal."""
    v = guard.verdict(df, text_col, key)
    ok = passes(F.col("verdict"))
    return (v.withColumn("passed", ok)
            .withColumn("query_out", F.when(ok, F.col(text_col)))
            .withColumn("error", F.when(~ok, F.lit(REQUEST_REFUSAL))))


def guard_response(df: DataFrame, raw_col: str, guard: GuardProvider, key: str | None = None) -> DataFrame:
    """The guard sees the raw completion (reasoning included); passing rows are
    cleaned (O28), refused ones carry the refusal."""
    v = guard.verdict(df, raw_col, key)
    ok = passes(F.col("verdict"))
    return (v.withColumn("passed", ok)
            .withColumn("answer", F.when(ok, tf.strip_think(raw_col)))
            .withColumn("error", F.when(~ok, F.lit(RESPONSE_REFUSAL))))


def moderation_record(text: Column) -> Column:
    """Stand-in structured moderation output (JSON text) built from the rule guard."""
    cats = tf.pii_categories(text)
    violent = text.rlike(BLOCKED_WORDS_PATTERN)
    cats = F.when(violent, F.array_union(cats, F.array(F.lit("VIOLENCE")))).otherwise(cats)
    decision = F.when(F.size(cats) > 0, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    conf = F.when(F.size(cats) > 0, F.lit(0.9)).otherwise(F.lit(0.8))
    rec = F.to_json(F.struct(decision.alias("decision"), cats.alias("categories"), conf.alias("confidence"),
                             F.lit("rule stand-in").alias("brief_rationale")))
    # a model may stop mid-answer: records of texts without any letter lose their closing brace
    return F.when(text.rlike("[A-Za-z]"), rec).otherwise(F.regexp_replace(rec, "}$", ""))


def parse_verdict(df: DataFrame, json_col: str) -> DataFrame:
    """Parse the record; any category, low confidence, unknown decision or
    malformed JSON -> BLOCK."""
    p = F.from_json(F.col(json_col), MODERATION_SCHEMA, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json(F.col(json_col)).isNotNull()
    d = (F.when(~valid, F.lit(BLOCK))
         .when(F.coalesce(F.size(p["categories"]), F.lit(0)) > 0, F.lit(BLOCK))
         .when(F.coalesce(p["confidence"], F.lit(0.0)) < MIN_CONFIDENCE, F.lit(BLOCK))
         .when(p["decision"] == ALLOW, F.lit(ALLOW))
         .otherwise(F.lit(BLOCK)))
    return (df.withColumn("valid", valid)
            .withColumn("decision", F.when(valid, p["decision"]))
            .withColumn("n_categories", F.when(valid, F.coalesce(F.size(p["categories"]), F.lit(0))))
            .withColumn("final", d))


def moderate(df: DataFrame, text_col: str, call, groups: tuple[str, ...], model: str = "", temperature: float = 0.0,
             out: str = "record") -> DataFrame:
    """O29 through a provider: ``call(texts, groups, model, temperature)`` returns a JSON record per text, once per
    Arrow batch.  A failed call leaves NULL records, which parse to BLOCK."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        for pdf in batches:
            try:
                records = list(call(pdf[text_col], groups, model, temperature))
            except Exception:  # noqa: BLE001 - no record is a block
                records = None
            yield pdf.assign(**{out: records})

    return df.mapInPandas(run, schema)


def policy_groups(text: Column, toxic: Column | None = None) -> Column:
    """Policy groups that the stand-in rules (and a toxicity label, if there is one) trigger."""
    hits = [F.when(text.rlike(BLOCKED_WORDS_PATTERN), F.lit("VIOLENCE")), F.when(F.size(tf.pii_categories(text)) > 0, F.lit("PII"))]
    if toxic is not None:
        hits.append(F.when(toxic == 1, F.lit("TOXICITY")))
    return F.array_compact(F.array(*hits))


def policy_report(df: DataFrame, groups_col: str, groups: tuple[str, ...]) -> DataFrame:
    """Rows that trigger each group of a policy, zeros included, in one aggregate."""
    counts = [F.count(F.when(F.array_contains(groups_col, g), 1)).alias(g) for g in groups]
    one = df.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(g).alias("category"), F.col(g).alias("n")) for i, g in enumerate(groups)])
    return one.select(F.explode(pairs).alias("x")).select("x.no", "x.category", "x.n")


def pii_matches(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """One row per (text, category) with the number of matches."""
    rows = [F.struct(F.lit(name).alias("cat"),
                     F.size(F.regexp_extract_all(F.col(text_col), F.lit(p), 0)).alias("m"))
            for name, p in tf.PII_PATTERNS]
    return (df.select(key, F.explode(F.array(*rows)).alias("x"))
            .select(key, F.col("x.cat").alias("cat"), F.col("x.m").alias("m"))
            .where(F.col("m") > 0))


def pii_report(df: DataFrame, text_col: str, key: str) -> DataFrame:
    """Documents and matches per personal-data category; every category is
    reported, with zeros when nothing matched (the category list is the fixed
    pattern table, five rows)."""
    counts = (pii_matches(df, text_col, key).groupBy("cat")
              .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("m").cast("long").alias("n_matches")))
    cats = df.sparkSession.createDataFrame([(n,) for n, _ in tf.PII_PATTERNS], "cat string")
    return (F.broadcast(cats).join(counts, "cat", "left")
            .select("cat", F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"),
                    F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches")))


def confusion(verdicts: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decided verdict vs. label counts (small output: 2 x 3 groups)."""
    dec = F.when(passes(F.col("verdict")), F.lit(ALLOW)).otherwise(F.lit(BLOCK))
    return (verdicts.select(key, dec.alias("verdict"))
            .join(labels.select(key, "toxic"), key, "left")
            .groupBy("verdict", "toxic").agg(F.count(F.lit(1)).alias("n")))
