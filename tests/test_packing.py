"""Block packing against a direct sequential fold (brute force) on edge fixtures."""

import random

import pytest

from grounded.operators import packing
from grounded.operators.packing import pack_blocks


@pytest.fixture(params=[0, 3, 10_000], ids=["all-long", "mixed", "all-short"], autouse=True)
def route(request, monkeypatch):
    """Run every packing test through the distributed path, a mix, and the in-group fold."""
    monkeypatch.setattr(packing, "SHORT_PAGES", request.param)
    return request.param


def fold(pages, T=3000):
    out, buf = [], b""
    for p in pages:
        if p is None:
            continue
        buf += p.encode("utf-8")
        if len(buf) >= T:
            out.append(buf.decode("utf-8"))
            buf = b""
    if buf:
        out.append(buf.decode("utf-8"))
    return out


def run(spark, docs, T=3000):
    rows = [(d, t, p) for d, pages in docs.items() for t, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {}
    for r in pack_blocks(df, block_bytes=T).collect():
        got.setdefault(r.conv_id, []).append((r.block_no, r.blk, r.n_bytes))
    return {k: [b for _, b, _ in sorted(v)] for k, v in got.items()}


def test_boundaries(spark):
    docs = {
        1: ["a" * 2999, "b"],                      # reaches 3000 exactly on the second page
        2: ["a" * 3000, "b"],                      # first page flushes alone
        3: ["a" * 3001],                           # single oversized page
        4: ["é" * 1500, "x"],                      # multi-byte: 3000 bytes in 1500 chars
        5: ["", None, "x" * 10, None, ""],         # empty and failed pages
        6: ["y" * 10],                             # single small page
        7: ["z" * 1000] * 7,                       # several blocks plus a remainder
        8: ["q" * 9000, "r" * 10, "s" * 2990, "t"],
    }
    got = run(spark, docs)
    for d, pages in docs.items():
        assert got.get(d, []) == fold(pages), d


def test_no_empty_blocks(spark):
    docs = {1: ["", None, ""], 2: ["a" * 3000, "", None]}
    got = run(spark, docs)
    assert 1 not in got and got[2] == ["a" * 3000]


def test_random_against_fold(spark):
    rng = random.Random(3)
    docs = {}
    for d in range(30):
        n = rng.randint(1, 60)
        docs[d] = [None if rng.random() < 0.05 else "w" * rng.choice([0, 1, 7, 300, 1200, 2999, 3000, 5000])
                   for _ in range(n)]
    got = run(spark, docs, T=1000)
    for d, pages in docs.items():
        assert got.get(d, []) == fold(pages, 1000), d


def test_concatenation_preserved(spark):
    pages = [f"p{i}-" * (i * 37 % 400) for i in range(80)]
    got = run(spark, {9: pages}, T=500)
    assert "".join(got[9]) == "".join(pages)


def test_recursive_prefix_sum(spark, monkeypatch):
    from grounded.operators import packing
    monkeypatch.setattr(packing, "SEGMENT_PAGES", 4)      # force three levels on a 70-page document
    pages = [("ab" * (i % 7)) for i in range(70)]
    got = run(spark, {5: pages, 6: ["x" * 5] * 9}, T=9)
    assert got[5] == fold(pages, 9) and got[6] == fold(["x" * 5] * 9, 9)


def test_null_and_repeated_order_values(spark, monkeypatch):
    from grounded.operators import packing
    rows = [(1, 0, "aa"), (1, 0, "bb"), (1, 1, "c"), (1, None, "lost"), (None, 0, "lost"), (2, 5, "z"), (2, 5, "z"), (2, 5, None), (3, 0, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    for short in (1024, 0):
        monkeypatch.setattr(packing, "SHORT_PAGES", short)
        got = sorted((r.conv_id, r.block_no, r.blk, r.n_bytes) for r in packing.pack_blocks(df).collect())
        assert got == [(1, 0, "aabbc", 5), (2, 0, "zz", 2)]
    rejects = sorted(map(str, ((r.key, r.position, r.reason) for r in packing.reject_pages(df).collect())))
    assert rejects == sorted(map(str, [("1", None, "no order value"), (None, "0", "no document key"), ("2", "5", "no text")]))


def test_string_document_keys(spark):
    from grounded.operators import packing
    df = spark.createDataFrame([("a/b.pdf", 0, "x" * 10), ("a/b.pdf", 1, "y")], "path string, page_no int, text string")
    got = packing.pack_blocks(df, key="path", order="page_no", block_bytes=5).collect()
    assert sorted((r.path, r.block_no, r.blk) for r in got) == [("a/b.pdf", 0, "x" * 10), ("a/b.pdf", 1, "y")]
