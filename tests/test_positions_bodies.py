"""Dense positions, pages with many equal order values, and both ways of reading a request body."""

import json

from hypothesis import given, settings, strategies as st

from grounded.functions.positions import with_positions
from grounded.operators import answer as ans
from grounded.operators import packing


def test_positions(spark):
    rows = [("hot" if i % 3 else None if i % 2 else f"g{i % 50}", i * 7 % 11, f"t{i % 13}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, t string, id long").repartition(6)
    got = with_positions(df, "g", ["o", "t"], "pos").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.g, []).append(r)
    assert sorted(r.id for r in got) == list(range(3000))
    for g, rs in groups.items():
        rs.sort(key=lambda r: r.pos)
        assert [r.pos for r in rs] == list(range(len(rs)))
        assert [(r.o, r.t) for r in rs] == sorted((r.o, r.t) for r in rs)
    assert with_positions(df.limit(0), "g", ["o"], "pos").collect() == []


def test_pages_that_share_large_order_values(spark):
    """Microseconds as order and thousands of pages at one of them."""
    first = 1_700_000_000_000_000
    rows = [(1, first, f"{i:05d}," + "x" * (i % 90)) for i in range(6000)] + [(1, first + 1, "end"), (2, first, "b"), (2, first, "a")]
    got = sorted((r.conv_id, r.block_no, r.blk) for r in packing.pack_blocks(spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5)).collect())
    want = []
    for key in (1, 2):
        buf, no = "", 0
        for _, _, t in sorted(r for r in rows if r[0] == key):
            buf += t
            if len(buf.encode()) >= 3000:
                want.append((key, no, buf))
                buf, no = "", no + 1
        if buf:
            want.append((key, no, buf))
    assert got == want


text = st.text(alphabet=st.sampled_from(list('aQé"\\\n\t {}:, \x01')), max_size=12)
bodies = st.one_of(
    st.builds(lambda k, v: json.dumps({k: v}, ensure_ascii=False), st.sampled_from(["query", "Query", "QUERY", "other", "", "quéry"]), text),
    st.builds(lambda k, v, end: f'{{"{k}" : "{v}"}}{end}', st.sampled_from(["query", "QuerY", "q"]), text, st.sampled_from(["", " x", "}", ' {"query": "2"}'])),
    st.sampled_from(["null", "[]", "", "  ", '{"query": 1}', '{"query": "a", "Query": "b"}', '{"query": null}', "{", '{"query": "a"', ' \n{ "query":"a" }', None]))


@settings(max_examples=30, deadline=None)
@given(batch=st.lists(bodies, min_size=5, max_size=20))
def test_bodies_are_read_as_the_decoder_does(spark, batch):
    df = spark.createDataFrame(list(enumerate(batch)), "id long, body string")
    got = {r.id: (r.status, r.query) for r in ans.decode_request(df).collect()}
    assert got == {i: ans._decoded(b) for i, b in enumerate(batch)}
