"""Forest search: recall against brute force, exactness of scores, odd rows, large places."""

import numpy as np
import pytest

from grounded.llm import ann

SF = "/root/testdata/sf0.1"
QUERY = lambda v: v % 20 == 0


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [x[1:] for x in sorted(v)] for q, v in out.items()}


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], None if v is None else [None if c is None else float(c) for c in v], "s", 1)
            for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")


def test_recall_on_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = result(ann.search(df, QUERY))
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert sorted(got) == [int(ids[i]) for i in queries]
    hits = total = 0
    for i in queries:
        true, found = ann.brute_force(ids, x, i), got[int(ids[i])]
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(abs(s - float(x[np.flatnonzero(ids == v)[0]] @ x[i])) < 1e-12 for v, s in found)
        total += len(true)
        hits += len({v for v, _ in true} & {v for v, _ in found})
    assert hits / total >= 0.9


def test_clustered_vectors_stop_early(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((40, 16))
    x = centres[rng.integers(0, 40, 4000)] + 0.1 * rng.standard_normal((4000, 16))
    ids = np.arange(4000)
    got = result(ann.search(table(spark, x), QUERY))
    hits = [len({v for v, _ in ann.brute_force(ids, x, i)} & {v for v, _ in got[i]}) for i in range(0, 4000, 20)]
    assert np.mean(hits) >= 18


def test_one_vector_is_a_third_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[::3] = x[0]
    got = result(ann.search(table(spark, x), QUERY))
    ids = np.arange(900)
    for q in (0, 60, 120, 300):                              # copies: all ties, to the smaller ids
        assert [v for v, _ in got[q]] == [v for v, _ in ann.brute_force(ids, x, q)]
    assert all(len(v) == 20 for v in got.values()) and len(got) == 45


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1, 0], [0, 0], None, [1, None], [nan, 1], [inf, 1], [], [1, 2, 3], [0.5, 0.5], [1, 0], [-1, 0]]
    ids = [0, 20, 40, 60, 80, 100, 120, 140, 160, 0, None]
    got = ann.search(table(spark, vectors, ids), QUERY).collect()
    rows = sorted((r.query_id, r["rank"], r.vec_id if r.vec_id is not None else -1, r.score) for r in got)
    assert {r[0] for r in rows} == {0, 160}
    assert [r[2:] for r in rows if r[0] == 160] == [(0, 0.5), (0, 0.5), (-1, -0.5)]
    # Two rows have id 0: each is a query, and the other's neighbour.
    assert [r[1:] for r in rows if r[0] == 0] == [(1, 0, 1.0)] * 2 + [(2, 160, 0.5)] * 2 + [(3, -1, -1.0)] * 2
    assert ann.search(table(spark, vectors, ids).limit(0), QUERY).count() == 0


@pytest.mark.parametrize("n", [1, 2, 15])
def test_fewer_rows_than_neighbours(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 5))
    got = result(ann.search(table(spark, x), QUERY))
    assert {q: len(v) for q, v in got.items()} == ({0: n - 1} if n > 1 else {})
