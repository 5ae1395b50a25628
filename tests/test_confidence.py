"""Bootstrap of retrieval metrics against plain loops."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from grounded.operators import evaluate as ev

UNIT = ev.UNIT


def weight(key, b):
    u = int(hashlib.md5(f"{key}:{b}".encode()).hexdigest()[:8], 16)
    return sum(u >= x for x in ev.POISSON_BOUNDS)


def test_weights_are_poisson(spark):
    df = spark.range(20000).select(ev.poisson_weight(F.col("id"), F.lit(3)).alias("w"))
    got = [r.w for r in df.collect()]
    assert got[:200] == [weight(i, 3) for i in range(200)]
    mean = sum(got) / len(got)
    assert abs(mean - 1) < 0.03 and abs(sum((w - mean) ** 2 for w in got) / len(got) - 1) < 0.05


def test_metrics_of_questions(spark):
    gold = [(1, 10), (1, 11), (2, 10), (3, 12), (3, 12), (None, 10), (4, None)]
    ranked = [(1, 11, 1), (1, 99, 2), (1, 10, 3), (1, 10, 4), (2, 98, 1), (2, 10, 11), (5, 10, 1)]
    got = {r.q: (r.rr, r.ndcg) for r in ev.question_metrics(
        spark.createDataFrame(ranked, "q long, d long, rk int"), spark.createDataFrame(gold, "q long, d long"), "q", "d").collect()}
    want = (1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert set(got) == {1, 2, 3} and got[1][0] == UNIT and abs(got[1][1] - want * UNIT) <= 2
    assert got[2] == (0, 0) and got[3] == (0, 0)                       # found beyond k, and not at all


def test_ideal_list_stops_at_k(spark):
    gold = spark.createDataFrame([(1, d) for d in range(30)], "q long, d long")
    ranked = spark.createDataFrame([(1, d, d + 1) for d in range(10)], "q long, d long, rk int")
    assert abs(ev.question_metrics(ranked, gold, "q", "d").collect()[0].ndcg - UNIT) <= 10


def test_intervals_equal_a_loop(spark):
    a = {i: (i * 7919) % 1000001 for i in range(60)}
    b = {i: (i * 104729) % 1000001 for i in range(50)}                 # the other mode lacks ten questions: 0 there
    frame = lambda x: spark.createDataFrame([(i, v, v // 2) for i, v in x.items()], "q long, rr long, ndcg long").repartition(7)
    out = ev.paired_bootstrap({"a": frame(a), "b": frame(b)}, "q", replicates=40)
    got = {(r.metric, r.mode, r.against): r for r in out.collect()}
    assert set(got) == {(m, *x) for m in ("rr", "ndcg") for x in (("a", None), ("b", None), ("b", "a"))}
    diffs = []
    for r in range(40):
        w = {i: weight(i, r) for i in a}
        diffs.append(sum(w[i] * (b.get(i, 0) - a[i]) for i in a) / sum(w.values()) / UNIT)
    diffs.sort()
    quantile = lambda p: (lambda at: diffs[int(at)] + (at - int(at)) * (diffs[min(int(at) + 1, 39)] - diffs[int(at)]))(p * 39)
    row = got["rr", "b", "a"]
    assert row.n_items == 60 and row.n_above == sum(d > 0 for d in diffs)
    assert row.low == pytest.approx(quantile(0.025), abs=2e-6) and row.high == pytest.approx(quantile(0.975), abs=2e-6)
    assert row.value == pytest.approx((sum(b.values()) - sum(a.values())) / 60 / UNIT, abs=1e-6)


def test_no_questions(spark):
    empty = spark.createDataFrame([], "q long, rr long, ndcg long")
    assert ev.paired_bootstrap({"a": empty, "b": empty}, "q", replicates=5).count() == 0
