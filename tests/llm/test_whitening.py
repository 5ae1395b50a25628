"""Rank-one updates and the whitening against NumPy's eigendecomposition of the whole matrix."""

import math

import numpy as np
import pytest

from grounded.llm import whitening
from grounded.llm.eigen import Spectrum

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("kind, size, n", [("wide", 48, 400), ("few values", 8, 300), ("one line", 5, 40), ("one", 1, 20), ("short", 30, 7), ("zero", 6, 10)])
def test_updates_and_merges(kind, size, n):
    r = np.random.default_rng(n)
    x = {"wide": lambda: r.integers(-256, 256, (n, size)), "few values": lambda: r.integers(-2, 2, (n, size)),
         "one line": lambda: np.arange(1, size + 1) * r.integers(0, 3, (n, 1)), "one": lambda: r.integers(0, 9, (n, size)),
         "short": lambda: r.integers(-9, 9, (n, size)), "zero": lambda: np.full((n, size), 4)}[kind]()
    v = (x - x.mean(0)).T @ (x - x.mean(0))
    whole, parts = Spectrum(size), [Spectrum(size) for _ in range(4)]
    for i, row in enumerate(x):
        whole.add(row)
        parts[i % 3].add(row)
    for p in parts[1:]:
        parts[0].merge(p)
    for s in (whole, parts[0]):
        close = 1e-11 * max(1.0, np.trace(v))
        assert s.n == n and (s.total == x.sum(0)).all() and np.allclose(s.mean, x.mean(0), atol=1e-10)
        assert np.allclose(s.values, np.linalg.eigvalsh(v), atol=close)
        assert np.allclose(s.vectors.T @ s.vectors, np.eye(size), atol=1e-11)
        assert np.allclose(s.vectors * s.values @ s.vectors.T, v, atol=close)


def plain(rows):
    rows = [(k, e) for k, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    size = max(len(e) for _, e in rows)
    x = {i: [math.floor(256 * float(np.float32(c))) for c in e] + [0] * (size - len(e)) for i, (_, e) in enumerate(rows)}
    distinct = np.array(sorted(set(map(tuple, x.values()))))
    n, total = len(distinct), [sum(int(v) for v in c) for c in distinct.T]
    off = distinct - np.array(total) / n
    e, u = np.linalg.eigh(off.T @ off / n)
    e, u = e[::-1], u[:, ::-1]
    return rows, x, n, total, e, u


def check(spark, rows, components=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    q = whitening.quantised(df, "vec_id", "embedding")
    got = whitening.whiten(q, whitening.fit(q)).collect()
    rows, x, n, total, e, u = plain(rows)
    k = min(components, len(e))
    assert len(got) == k * len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.id, r)
    for c in range(1, k + 1):
        want, mine = [], []
        for i, (key, _) in enumerate(rows):
            r = by[c][key]
            assert r.n == n and r.deviation == sum((n * v - s) ** 2 for v, s in zip(x[i], total))
            assert r.explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
            want.append((np.array(x[i]) - np.array(total) / n) @ u[:, c - 1] / math.sqrt(e[c - 1]))
            mine.append(r.whitened)
        want, mine = np.array(want), np.array(mine)
        assert min(np.abs(want - mine).max(), np.abs(want + mine).max()) < 1e-8
    assert {r.identity_error for r in got}.pop() < 1e-9 and len({r.identity_error for r in got}) == 1


def test_equals_numpy(spark):
    r = np.random.default_rng(5)
    mix = r.normal(size=(16, 16))
    rows = [(i, [float(c) for c in mix @ r.normal(size=16)]) for i in range(500)]
    rows += [(1000 + i, rows[3][1]) for i in range(250)]                     # one vector of a third of all rows
    rows += [(2000, None), (2001, [float("nan")] * 16), (2002, [float("inf")] + [0.0] * 15), (2003, [None] + [1.0] * 15)]
    rows += [(2004, [0.5] * 3), (2005, [-0.0] * 16), (2006, [])]              # short vectors end in zeros
    check(spark, rows)


def test_fewer_dimensions_than_components(spark):
    check(spark, [(i, [float(i % 7), float(i * i % 11)]) for i in range(60)])


def test_without_variance_empty_and_odd_keys(spark):
    q = whitening.quantised(spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (1, [1.0, 2.0, 3.0, 4.0, 5.0]), (None, [1.0, 2.0, 3.0, 4.0, 5.0])], SCHEMA), "vec_id", "embedding")
    got = whitening.whiten(q, whitening.fit(q)).collect()
    assert len(got) == 12 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    q = whitening.quantised(spark.createDataFrame([(1, [0.0] * 5), (2, [1.0] * 5)], SCHEMA), "vec_id", "embedding")
    got = whitening.whiten(q, whitening.fit(q)).collect()
    assert sorted(abs(r.whitened) for r in got if r.component == 1) == pytest.approx([1, 1]) and {r.whitened for r in got if r.component > 1} == {None}
    for rows in ([], [(1, None)], [(1, [])]):
        q = whitening.quantised(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding")
        assert whitening.whiten(q, whitening.fit(q)).count() == 0
    odd = spark.createDataFrame([("a", [1e30, 2.0], 1), ("b", [0.0, -1e30], 2)], "x string, component array<double>, n int")
    q = whitening.quantised(odd, "x", "component")
    got = whitening.whiten(q, whitening.fit(q)).collect()
    assert len(got) == 4 and {r.id for r in got} == {"a", "b"}


def test_deviations_beyond_long():
    x = np.array([[2 ** 31, 0], [0, 0]])
    assert whitening.deviations(x, 2 ** 31, (0, 0)) == [None, 0]
    assert whitening.deviations(x, 2, (2 ** 31, 0)) == [2 ** 62, 2 ** 62]
