"""Filter trees against plain Python, and probes that widen until k hits are found."""

import pytest
from hypothesis import given, settings, strategies as st

from grounded.config import SearchConfig
from grounded.operators import filters as flt
from grounded.operators import search as srch

ROWS = [(i, i % 5 if i % 7 else None, None if i % 11 == 0 else f"s{i % 4}") for i in range(60)]
KEYS = ["id", "n", "s"]


def holds(tree, row):
    if "key" in tree:
        v = dict(zip(KEYS, row))[tree["key"]]
        if "is_null" in tree:
            return (v is None) == tree["is_null"]
        if v is None:
            return False
        if "match" in tree:
            return v == tree["match"]
        if "any" in tree:
            return v in tree["any"]
        if "except" in tree:
            return v not in tree["except"]
        r = tree["range"]
        return all({"gt": v > b, "gte": v >= b, "lt": v < b, "lte": v <= b}[k] for k, b in r.items())
    return (all(holds(c, row) for c in tree.get("must", [])) and (not tree.get("should") or any(holds(c, row) for c in tree["should"]))
            and not any(holds(c, row) for c in tree.get("must_not", [])))


number = st.integers(0, 5)
leaf = st.one_of(
    st.builds(lambda k, v: {"key": k, "match": v}, st.sampled_from(["id", "n"]), number),
    st.builds(lambda v, t: {"key": "s", t: v}, st.lists(st.sampled_from(["s0", "s1", "zz"]), max_size=3), st.sampled_from(["any", "except"])),
    st.builds(lambda k, r: {"key": k, "range": r}, st.sampled_from(["id", "n"]), st.dictionaries(st.sampled_from(["gt", "gte", "lt", "lte"]), number, min_size=1)),
    st.builds(lambda k, b: {"key": k, "is_null": b}, st.sampled_from(KEYS), st.booleans()))
trees = st.recursive(leaf, lambda c: st.dictionaries(st.sampled_from(["must", "should", "must_not"]), st.lists(c, max_size=3)), max_leaves=6)


@settings(max_examples=25, deadline=None)
@given(batch=st.lists(trees, min_size=4, max_size=4))
def test_trees_equal_plain_python(spark, batch):
    df = spark.createDataFrame(ROWS, "id long, n int, s string")
    got = df.select("id", *[flt.compiled(t, KEYS).alias(f"t{i}") for i, t in enumerate(batch)]).collect()
    for r in got:
        assert [r[f"t{i}"] for i in range(len(batch))] == [holds(t, ROWS[r.id]) for t in batch]


@pytest.mark.parametrize("tree", [{"key": "nope", "match": 1}, {"key": "n"}, {"key": "n", "match": 1, "any": [1]}, {"key": "n", "range": {}},
                                  {"key": "n", "range": {"over": 1}}, {"all": []}, {"must": [{"key": "n", "like": 1}]}])
def test_wrong_trees_are_refused(tree):
    with pytest.raises(ValueError):
        flt.compiled(tree, KEYS)


def test_the_condition_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame(ROWS, "id long, n int, s string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.where(flt.compiled({"must": [{"key": "n", "match": 3}, {"key": "id", "range": {"lt": 50}}]}, df.columns))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters" in text and "n#" in text.split("DataFilters")[1]
    assert sorted(r.id for r in plan.collect()) == [i for i, n, _ in ROWS if n == 3 and i < 50]


@pytest.mark.parametrize("tree_of_pivots", [False, True])
def test_never_fewer_than_k_where_k_exist(spark, tree_of_pivots):
    import numpy as np
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.normal(size=8)], 1 if i % 25 == 0 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label int")
    vc = srch.VecCol("v", dim=8)
    piv = srch.pivot_matrix(srch.hash_pivots(df, "id", "v", 20), vc)
    for label, k in ((1, 5), (1, 40), (2, 3)):
        cfg = SearchConfig(k=k, threshold=-1.0, nprobe=2)
        got = srch.filtered_search(spark, df, df, flt.compiled({"must": [{"key": "label", "match": label}]}, df.columns), q_id="id", q_vec=vc, c_id="id",
                                   c_vec=vc, cfg=cfg, pivots=srch.pivot_tree(piv, 1) if tree_of_pivots else piv, dim_hint=8)
        counts = {x.qid: x.n for x in got.groupBy("qid").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()}
        there = sum(x[2] == label for x in rows)
        assert counts == ({i: min(k, there) for i in range(400)} if there else {})
