"""Pivots in two levels and sparse probe lists against plain loops."""

import numpy as np

from grounded.config import SearchConfig
from grounded.functions.vectors import round_scores, unit_rows
from grounded.operators import search as srch

VC = srch.VecCol("v", dim=8)


def plain_cells(V, tree, n):
    out = []
    for v in V:
        if np.isnan(v).any():
            out.append([-1] * n)
            continue
        c = round_scores(tree.coarse @ v, 6)
        groups = sorted(range(len(c)), key=lambda g: (-c[g], g))[:tree.beam]
        own = [i for i in range(len(tree.leaves)) if tree.group[i] in groups]
        s = round_scores(tree.leaves @ v, 6)
        out.append((sorted(own, key=lambda i: (-s[i], i)) + [-1] * n)[:n])
    return np.array(out)


def test_cells_equal_plain_loops(monkeypatch):
    r = np.random.default_rng(3)
    P = unit_rows(r.normal(size=(30, 8)))
    P[7] = P[2]                                                     # ties go to the lower cell
    V = unit_rows(np.vstack([r.normal(size=(200, 8)), P, np.zeros((1, 8))]))
    for budget in (4_000_000, 100):                                 # small slices give the same
        monkeypatch.setattr(srch, "_MAX_CELLS", budget)
        for beam in (1, 2, 6, 99):
            tree = srch.pivot_tree(P, beam)
            for n in (1, 5, 40):
                assert (srch.nearest_cells(V, tree, n, 6) == plain_cells(V, tree, n)).all()
        flat = srch.PivotTree(P, P[:1], np.zeros(30, int), 1)       # a single group is the flat search
        assert (srch.nearest_cells(V, P, 7, 6) == srch.nearest_cells(V, flat, 7, 6)).all()


def test_probe_lists_are_sparse_and_complete():
    r = np.random.default_rng(4)
    lists = np.array([r.choice(500, 6, replace=False) for _ in range(300)])
    lists[5] = -1
    p = srch.Probes(lists)
    assert p.rows.nbytes + p.cells.nbytes == 8 * 299 * 6
    for cell in (0, 17, 499, 500):
        assert list(p.questions(cell)) == [q for q in range(300) if cell in lists[q] and q != 5]
    assert p.probed() == sorted({int(c) for q, row in enumerate(lists) if q != 5 for c in row})


def test_every_form_agrees_and_full_probe_is_exact(spark):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(150)] + [(900, None), (901, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    tree = srch.pivot_tree(srch.pivot_matrix(srch.hash_pivots(df, "id", "v", 12), VC), beam=2)
    key = lambda x: sorted((r.qid, r.id, r.score, r.rk) for r in x.collect())
    args = dict(q_id="id", q_vec=VC, c_id="id", c_vec=VC)
    cfg = SearchConfig(k=5, threshold=0.1, nprobe=3, exclude_self=True)
    a = srch.ivf_search(spark, df, df, cfg=cfg, pivots=tree, dim_hint=8, **args)
    b = srch.block_search(spark, df, df, cfg=cfg, pivots=tree, block_bytes=400, **args)
    c = srch.ivf_search(spark, df, srch.assign_cells(df, VC, tree), cfg=cfg, pivots=tree, cell_col="cell", dim_hint=8, **args)
    assert key(a) == key(b) == key(c)
    whole = srch.PivotTree(tree.leaves, tree.coarse, tree.group, beam=len(tree.coarse))
    every = srch.ivf_search(spark, df, df, cfg=SearchConfig(k=5, threshold=0.1, nprobe=12, exclude_self=True), pivots=whole, dim_hint=8, **args)
    exact = srch.search(spark, df, df, cfg=SearchConfig(k=5, threshold=0.1, exact=True, exclude_self=True), dim_hint=8, **args)
    assert key(every) == key(exact)
