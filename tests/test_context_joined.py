"""Context without repetition against plain Python; the bound of the BM25 matrix."""

import random

from grounded.operators import context as ctxop
from grounded.operators import lexical


def plain(hits, stride, budget):
    taken, order = {}, []
    for rk, doc, i, chunk in sorted(hits, key=lambda h: h[0]):
        for j, t in enumerate(chunk.split()):
            if (doc, i * stride + j) not in taken and len(taken) < budget:
                taken[doc, i * stride + j] = t
        if doc not in order:
            order.append(doc)
    parts = []
    for doc in order:
        at = sorted(a for d, a in taken if d == doc)
        runs = []
        for a in at:
            if runs and runs[-1][-1] == a - 1:
                runs[-1].append(a)
            else:
                runs.append([a])
        parts += [" ".join(taken[doc, a] for a in run) for run in runs]
    return "\n\n".join(parts), len(taken), len(parts)


def test_joined_windows(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for q in range(25):
        docs = {d: [f"d{d}t{k}" for k in range(rng.randint(1, 40))] for d in range(4)}
        wins = [(d, i, " ".join(t[4 * i:4 * i + 6])) for d, t in docs.items() for i in range((len(t) + 3) // 4)]
        rng.shuffle(wins)
        hits = [(rk, *w) for rk, w in enumerate(wins[:rng.randint(1, 9)], 1)]
        rows += [(q, *h) for h in hits]
        want[q] = plain(hits, 4, 20)
    df = spark.createDataFrame(rows, "qid long, rk long, doc_id long, i long, chunk string").repartition(5)
    got = {r.qid: (r.ctx, r.n_tokens, r.n_parts) for r in ctxop.joined_windows(df, "doc_id", "i", 4, 20).collect()}
    assert got == want
    assert ctxop.joined_windows(df.limit(0), "doc_id", "i", 4, 20).count() == 0


def test_null_and_string_documents(spark):
    rows = [(1, 1, None, 0, "a b c d e f"), (1, 2, None, 1, "e f g"), (1, 3, "x", 0, "a b")]
    df = spark.createDataFrame(rows, "qid long, rk long, doc_id string, i long, chunk string")
    r = ctxop.joined_windows(df, "doc_id", "i", 4, 100).first()
    assert (r.ctx, r.n_tokens, r.n_parts) == ("a b c d e f g\n\na b", 9, 2)


def test_the_bm25_matrix_is_bounded_in_bytes(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 3} text") for i in range(40)], "doc_id long, text string")
    qs = spark.createDataFrame([(i, f"word{i} text") for i in range(5)], "item_id long, text string")
    rows = lambda: sorted(map(tuple, lexical.bm25(qs, docs, k=4).select("item_id", "doc_id", "score", "rk").collect()))
    whole = rows()
    joined = []
    real = lexical._bm25_join
    monkeypatch.setattr(lexical, "_bm25_join", lambda *a: joined.append(1) or real(*a))
    monkeypatch.setattr(lexical, "MAX_MATRIX_BYTES", 100)
    assert rows() == whole and joined
