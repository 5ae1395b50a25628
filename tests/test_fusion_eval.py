"""Reciprocal-rank fusion and hit@k / MRR on hand-computed fixtures."""

from grounded.operators import evaluate as ev
from grounded.operators import lexical as lex


def test_rrf_by_hand(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], "q long, d long, rk long")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 2)], "q long, d long, rk long")
    got = {(r.d, r.rk): r.score for r in lex.rrf([a, b], "q", "d", k=3).collect()}
    s10, s12, s11 = 1 / 61 + 1 / 62, 1 / 63 + 1 / 61, 1 / 62
    assert got == {(10, 1): round(s10, 6), (12, 2): round(s12, 6), (11, 3): round(s11, 6)}


def test_hit_at_k_by_hand(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1), (2, 8, 3), (3, 9, 1)], "q long, d long, rk long")
    gold = spark.createDataFrame([(1, 6), (2, 8), (2, 7), (4, 1)], "q long, d long")
    got = {r.k: (r.n_items, r.hits, r.mrr) for r in ev.hit_at_k(ranked, gold, "q", "d", ks=(1, 2, 3)).collect()}
    # gold questions 1, 2, 4; first gold ranks 2, 1, none
    assert got == {1: (3, 1, round(1 / 3, 6)), 2: (3, 2, round((1 + 0.5) / 3, 6)), 3: (3, 2, round(1.5 / 3, 6))}


def test_containment_gold_by_hand(spark):
    qs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "beta"), (3, "zeta eta theta")],
                               "item_id long, text string")
    docs = spark.createDataFrame([(10, "x alpha beta gamma delta y"), (11, "alphabeta gamma"), (12, "beta"),
                                  (13, "eta theta")], "doc_id long, text string")
    got = sorted((r.item_id, r.doc_id) for r in ev.containment_gold(qs, docs).collect())
    assert got == [(1, 10), (2, 10), (2, 11), (2, 12)]         # "beta" inside "alphabeta" is contained too
