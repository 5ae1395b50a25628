"""Held-out retrieval evaluation (R07): containment gold, hit@k and MRR, NDCG, bootstrap confidence.

Gold pairs are found without a theta join: every question contributes one
anchor (a run of interior tokens, which are whitespace-bounded in any text that
contains the question verbatim); documents are shingled at every token position
with the anchor lengths in use, equi-joined on the shingle hash against the
broadcast anchors, and candidate pairs are verified with an exact substring test.

Completeness: a question of ``TOKEN_ANCHORED`` or more tokens is found wherever it
occurs verbatim (its interior tokens are whitespace-bounded in any containing
text).  A shorter one contributes its first characters instead, at most
``ANCHOR_CHARS`` of them, and documents are shingled at every character with the
lengths in use; so it is found inside longer words too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grounded.functions import text as tf
from grounded.session import broadcast_if_bounded

ANCHOR_TOKENS = 8
TOKEN_ANCHORED = 5
ANCHOR_CHARS = 24
# Metrics are summed in whole millionths, so that a sum does not depend on the order of its rows.
UNIT = 1_000_000
# A weight is the number of bounds at or below a hash of 32 bits: Poisson(1) up to what 32 bits can tell.
POISSON_BOUNDS = tuple(math.floor(math.exp(-1) * sum(1 / math.factorial(i) for i in range(n + 1)) * 2 ** 32) for n in range(12))


def containment_gold(questions: DataFrame, docs: DataFrame, q_key: str = "item_id", q_text: str = "text",
                     d_key: str = "doc_id", d_text: str = "text") -> DataFrame:
    # every token is hashed once; shingles hash slices of those longs
    qt = questions.select(q_key, q_text, F.transform(tf.tokens(q_text), lambda t: F.xxhash64(t)).alias("_t"))
    n = F.size("_t")
    # interior tokens 2..(1+L), L = min(ANCHOR_TOKENS, n - 2); short questions: their first characters, L < 0
    L = F.least(F.lit(ANCHOR_TOKENS), n - 2)
    C = F.least(F.lit(ANCHOR_CHARS), F.length(q_text))
    by_tokens = n >= TOKEN_ANCHORED
    anchors = (qt.where(n > 0)
               .select(q_key, F.when(by_tokens, L).otherwise(-C).alias("L"),
                       F.when(by_tokens, F.xxhash64(F.slice("_t", F.lit(2), L)))
                       .otherwise(F.xxhash64(F.substring(q_text, F.lit(1), C))).alias("h")))
    per_len = {r[0]: r[1] for r in anchors.groupBy("L").count().collect()}     # a handful of small ints
    lengths = sorted(x for x in per_len if x > 0)
    dt = docs.select(d_key, F.transform(tf.tokens(d_text), lambda t: F.xxhash64(t)).alias("_t"))
    shingles = None
    for ln in lengths:
        # one hash per token position, computed inside the row: linear in the text
        hs = F.transform(F.sequence(F.lit(1), F.size("_t") - ln + 1), lambda p: F.xxhash64(F.slice("_t", p, ln)))
        hs = F.when(F.size("_t") >= ln, F.array_distinct(hs))
        s = (dt.select(d_key, F.lit(ln).alias("L"), F.explode_outer(hs).alias("h"))
             .where(F.col("h").isNotNull()))
        shingles = s if shingles is None else shingles.unionByName(s)
    for ln in sorted(-x for x in per_len if x < 0):
        at = F.sequence(F.lit(1), F.length(d_text) - ln + 1)
        hs = F.when(F.length(d_text) >= ln, F.array_distinct(F.transform(at, lambda p: F.xxhash64(F.substring(d_text, p, F.lit(ln))))))
        s = (docs.select(d_key, F.lit(-ln).alias("L"), F.explode_outer(hs).alias("h")).where(F.col("h").isNotNull()))
        shingles = s if shingles is None else shingles.unionByName(s)
    if shingles is None:
        return questions.sparkSession.createDataFrame([], f"{q_key} long, {d_key} long")
    cand = shingles.join(broadcast_if_bounded(anchors, sum(per_len.values())), ["L", "h"]).select(q_key, d_key).distinct()
    verified = (cand.join(questions.select(q_key, q_text), q_key)
                .join(docs.select(d_key, F.col(d_text).alias("_dt")), d_key)
                .where(F.instr(F.col("_dt"), F.col(q_text)) > 0))
    return verified.select(q_key, d_key)


def hit_at_k(ranked: DataFrame, gold: DataFrame, q_key: str, d_key: str, ks=(1, 4, 10)) -> DataFrame:
    """``ranked``: (q_key, d_key, rk).  Per k: gold questions, questions with a gold
    document in the top k, and MRR restricted to the top k.  One pass: the k
    values are exploded next to each gold question's first gold rank."""
    first = (ranked.join(gold, [q_key, d_key]).groupBy(q_key).agg(F.min("rk").alias("first_rk")))
    gq = gold.select(q_key).distinct().join(first, q_key, "left")
    per_k = gq.select("first_rk", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    hit = F.col("first_rk") <= F.col("k")
    return (per_k.groupBy("k")
            .agg(F.count(F.lit(1)).alias("n_items"), F.count(F.when(hit, 1)).alias("hits"),
                 F.round(F.sum(F.when(hit, 1.0 / F.col("first_rk")).otherwise(0.0)) / F.count(F.lit(1)), 6)
                 .alias("mrr")))


def question_metrics(ranked: DataFrame, gold: DataFrame, q_key: str, d_key: str, k: int = 10) -> DataFrame:
    """``rr`` and ``ndcg`` at ``k`` of every question that has gold, in whole millionths; 0 where no gold document is found.

    ``ranked``: (q_key, d_key, rk).  Gold counts as relevance 1; the ideal list has all gold documents first."""
    gold = gold.select(q_key, d_key).where(F.col(q_key).isNotNull() & F.col(d_key).isNotNull()).distinct()
    # one rank per document, the best, should a ranking repeat it
    best = ranked.where(F.col("rk") <= k).groupBy(q_key, d_key).agg(F.min("rk").alias("rk"))
    gain = [0.0] + [1.0 / math.log2(i + 1) for i in range(1, k + 1)]
    ideal = [round(sum(gain[:i + 1]) * UNIT) for i in range(k + 1)]
    at = F.array(*[F.lit(round(g * UNIT)) for g in gain]), F.array(*[F.lit(x) for x in ideal])
    found = (gold.join(best, [q_key, d_key], "left").groupBy(q_key)
             .agg(F.count(F.lit(1)).alias("n_gold"), F.min("rk").alias("first"),
                  F.sum(F.get(at[0], F.col("rk").cast("int"))).alias("dcg")))
    most = F.get(at[1], F.least(F.col("n_gold"), F.lit(k)).cast("int"))
    return found.select(q_key, F.coalesce(F.floor(UNIT / F.col("first") + 0.5), F.lit(0)).cast("long").alias("rr"),
                        F.floor(F.coalesce("dcg", F.lit(0)) * float(UNIT) / most + 0.5).cast("long").alias("ndcg"))


def poisson_weight(key: Column, replicate: Column) -> Column:
    """Poisson(1) weight of a question in a replicate, from an MD5 of both: the same on every run and partitioning."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("long")
    return sum((F.when(u >= bound, 1).otherwise(0) for bound in POISSON_BOUNDS), F.lit(0)).cast("long")


def paired_bootstrap(modes: dict[str, DataFrame], q_key: str, metrics=("rr", "ndcg"), replicates: int = 200,
                     level: float = 0.95) -> DataFrame:
    """Means of every retrieval mode and their differences, with intervals from ``replicates`` weighted resamples.

    ``modes``: name -> ``question_metrics``.  All modes of a replicate share the questions' weights, which pairs them.  One
    aggregate makes all replicates: a task sends one row of sums per replicate, whatever the number of questions.  A question
    that one mode lacks counts 0 there.  Rows: ``metric``, ``mode``, ``against`` (null: the mean itself), ``n_items``, ``value``,
    ``low``, ``high``, ``n_above`` (replicates with a value above 0)."""
    every = None
    for name, df in modes.items():
        part = df.where(F.col(q_key).isNotNull()).select(q_key, F.lit(name).alias("mode"), *metrics)
        every = part if every is None else every.unionByName(part)
    cells = [(m, name) for m in metrics for name in modes]
    wide = every.groupBy(q_key).agg(*[F.coalesce(F.sum(F.when(F.col("mode") == name, F.col(m))), F.lit(0)).alias(f"c{i}")
                                      for i, (m, name) in enumerate(cells)])
    # replicate -1 is the sample itself, every weight 1
    runs = wide.withColumn("b", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1))))
    runs = runs.withColumn("w", F.when(F.col("b") < 0, F.lit(1)).otherwise(poisson_weight(F.col(q_key), F.col("b"))))
    sums = runs.groupBy("b").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(f"c{i}")).alias(f"s{i}") for i in range(len(cells))])
    total = F.nullif(F.col("w"), F.lit(0)) * F.lit(float(UNIT))
    of = {cell: F.col(f"s{i}") for i, cell in enumerate(cells)}
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(a).alias("mode"), F.lit(b).cast("string").alias("against"),
                     ((of[m, a] - (of[m, b] if b else F.lit(0))) / total).alias("x"))
            for m in metrics for i, a in enumerate(modes) for b in (None, *list(modes)[:i])]
    each = sums.select("b", "w", F.explode(F.array(*rows)).alias("r")).select("b", "w", "r.*")
    sample, tail = F.col("b") < 0, (1 - level) / 2
    edge = lambda p: F.round(F.percentile(F.when(~sample, F.col("x")), F.lit(p)), 6)
    return (each.groupBy("metric", "mode", "against")
            .agg(F.max(F.when(sample, F.col("w"))).alias("n_items"), F.round(F.max(F.when(sample, F.col("x"))), 6).alias("value"),
                 edge(tail).alias("low"), edge(1 - tail).alias("high"), F.count(F.when(~sample & (F.col("x") > 0), 1)).alias("n_above")))
