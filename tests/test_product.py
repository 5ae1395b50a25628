"""Product quantisation against plain loops, in blocks of any size and with rows that cannot be scored."""

import numpy as np
import pytest

from grounded.config import SearchConfig
from grounded.operators import product
from grounded.operators import search as srch

VC = srch.VecCol("v", dim=8)
CFG = SearchConfig(k=4, threshold=None, exclude_self=True)


def frame(spark, n=120, seed=2):
    r = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(n)]
    rows[9] = (9, rows[4][1])                                              # a tie
    odd = [(900, None), (901, [0.0] * 8), (902, [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("nan")] + [1.0] * 7),
           (905, [float("inf")] + [1.0] * 7), (None, [1.0] * 8)]
    return rows, spark.createDataFrame(rows + odd, "id long, v array<double>")


def whole(v):
    norm = 0.0
    for x in v:
        norm += x * x
    return [int(np.floor(x / np.sqrt(norm) * product.SCALE + 0.5)) for x in v]


def plain_books(rows, parts, words, rounds):
    import hashlib
    fixed = {i: whole(v) for i, v in rows}
    order = sorted(fixed, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), str(i)))[:words]
    w = 8 // parts
    cut = lambda x, p: x[p * w:(p + 1) * w]
    books = [[cut(fixed[i], p) for i in order] for p in range(parts)]
    nearest = lambda x, book: min(range(len(book)), key=lambda c: (sum((a - b) ** 2 for a, b in zip(x, book[c])), c))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for x in fixed.values():
                members.setdefault(nearest(cut(x, p), books[p]), []).append(cut(x, p))
            for c, xs in members.items():
                books[p][c] = [sum(col) // len(xs) for col in zip(*xs)]
    codes = {i: [nearest(cut(x, p), books[p]) for p in range(parts)] for i, x in fixed.items()}
    return fixed, books, codes


def test_equals_plain_loops(spark):
    rows, df = frame(spark)
    fixed, books, codes = plain_books(rows, 4, 10, 2)
    book = product.train(df.where("id is not null").repartition(5), "id", "v", 8, parts=4, codewords=10, rounds=2)
    assert book.words.tolist() == books
    coded = product.with_codes(df, "v", book)
    got = {r.id: r.code for r in coded.collect()}
    assert {i: list(c) for i, c in got.items() if i is not None and i < 900} == codes
    assert all(got[i] is None for i in range(900, 906))
    score = lambda q, i: sum(a * b for p in range(4) for a, b in zip(fixed[q][2 * p:2 * p + 2], books[p][codes[i][p]]))
    want = {(q, i) for q in fixed for i in sorted((i for i in fixed if i != q), key=lambda i: (-score(q, i), i))[:15]}
    for size in (32 << 20, 900):                                            # one block, and many on both sides
        near = product.candidates(df, coded, q_id="id", q_vec="v", c_id="id", code="code", book=book, cfg=CFG, n=15, block_bytes=size)
        assert {(r.qid, r.id) for r in near.collect()} == want


def test_all_candidates_are_the_exact_search(spark):
    _, df = frame(spark)
    book = product.train(df, "id", "v", 8, parts=2, codewords=4, rounds=1)
    args = dict(q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=CFG)
    key = lambda x: sorted((r.qid, r.id, r.score, r.rk) for r in x.collect())
    exact = key(srch.nn_search(spark, df, df, dim_hint=8, **args))
    assert exact and key(product.product_search(spark, df, df, book=book, n_candidates=500, **args)) == exact
    text = df.selectExpr("concat('k', id) AS id", "v")                      # ids may be strings
    found = product.product_search(spark, text, text, book=book, n_candidates=500, **args)
    assert {(r.qid, r.id) for r in found.collect()} == {(f"k{q}", f"k{i}") for q, i, *_ in exact}


def test_empty_inputs(spark):
    _, df = frame(spark)
    book = product.train(df, "id", "v", 8, parts=8, codewords=3, rounds=0)
    args = dict(q_id="id", q_vec=VC, c_id="id", c_vec=VC, cfg=CFG, book=book, n_candidates=5)
    assert product.product_search(spark, df.limit(0), df, **args).count() == 0
    assert product.product_search(spark, df, df.limit(0), **args).count() == 0
    with pytest.raises(ValueError):
        product.train(df.limit(0), "id", "v", 8, parts=2)
    with pytest.raises(ValueError):
        product.train(df, "id", "v", 8, parts=3)
