"""Postings in blocks: the hits of the full search, from fewer blocks."""

import random

from grounded.operators import blockmax, lexical
from grounded.session import scratch_dir


def corpus(n, rng):
    words = [f"w{i}" for i in range(300)]
    docs = []
    for i in range(n):
        text = rng.choices(words, weights=[1 / (1 + j) for j in range(300)], k=rng.randint(5, 60))
        if i % 97 == 0:
            text += ["needle", "haystack"] * (1 + i % 5)
        docs.append((i, " ".join(text)))
    return docs


def test_equals_the_full_search_and_reads_less(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame(corpus(3000, rng) + [(5000, None), (5001, ""), (None, "needle haystack")], "doc_id long, text string").repartition(4)
    qs = spark.createDataFrame([(1, "needle in a haystack"), (2, "w0 w1 needle"), (3, "w150 w299 w0"), (4, "zzz none"), (5, ""), (6, "haystack w0 w0 w2")],
                               "item_id long, text string")
    path = blockmax.build_block_index(docs, scratch_dir(spark, "t-blocks"))
    assert spark.read.parquet(f"{path}/blocks").agg({"n": "max"}).first()[0] <= blockmax.BLOCK
    for k in (1, 5, 10):
        hits, report = blockmax.block_topk(qs, path, k=k)
        want = lexical.bm25(qs, docs.where("doc_id is not null"), k=k)
        key = lambda df: sorted((r.item_id, r.rk, r.doc_id, r.score) for r in df.collect())
        assert key(hits) == key(want) and len(key(hits)) == 4 * k
        rows = {r.item_id: (r.n_blocks, r.n_read) for r in report.collect()}
        assert set(rows) == {1, 2, 3, 6} and all(read <= n for n, read in rows.values())
        assert sum(read for _, read in rows.values()) < 0.8 * sum(n for n, _ in rows.values())


def test_fewer_documents_than_k_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (2, "b c c")], "doc_id long, text string")
    qs = spark.createDataFrame([(1, "b"), (2, "c")], "item_id long, text string")
    path = blockmax.build_block_index(docs, scratch_dir(spark, "t-blocks"))
    assert blockmax.block_topk(qs, path)[0].count() == 5
    path = blockmax.build_block_index(docs.limit(0), scratch_dir(spark, "t-blocks"))
    assert blockmax.block_topk(qs, path)[0].count() == 0


def test_blocks_are_whole_and_the_join_of_many_terms_agrees(spark, monkeypatch):
    """Batches that cut a block in two, postings that are a number each, and more question terms than a task gets."""
    docs = spark.createDataFrame(corpus(700, random.Random(3)) + [(9000, None), (None, "w0")], "doc_id long, text string").repartition(2)
    qs = spark.createDataFrame([(1, "needle w3"), (2, "w0 w1 w9")], "item_id long, text string")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    path = blockmax.build_block_index(docs, scratch_dir(spark, "t-blocks"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    stored = spark.read.parquet(f"{path}/blocks")
    held = [d for r in stored.where("term is null").collect() for d in r.docs]
    assert sorted(held) == sorted([*range(700), 9000])
    terms = stored.where("term is not null")
    assert terms.count() == terms.select("term", "block").distinct().count()
    assert dict(terms.dtypes)["postings"] == "array<bigint>"
    key = lambda df: sorted((r.item_id, r.rk, r.doc_id, r.score) for r in df.collect())
    scanned = key(blockmax.block_topk(qs, path)[0])
    monkeypatch.setattr(blockmax, "MAX_QUERY_TERMS", 0)
    assert scanned == key(blockmax.block_topk(qs, path)[0]) and len(scanned) == 20


def test_repeated_rows_stay_in_one_block(spark):
    """Every row twice: a document's score is that of both its rows, wherever a block of 64 would have ended."""
    rows = corpus(150, random.Random(5))
    once, odd = (spark.createDataFrame(r, "doc_id long, text string").repartition(1) for r in (rows, [(-1, "odd one"), *rows, *rows]))
    path = blockmax.build_block_index(odd, scratch_dir(spark, "t-blocks"))
    ids = [d for r in spark.read.parquet(f"{path}/blocks").where("term is null").collect() for d in r.docs]
    assert sorted(ids) == [-1, *range(150)]
    st = spark.read.parquet(f"{path}/stats").first()
    assert st["n"] == 301 and abs(st["avgdl"] - (2 + 2 * sum(len(t.split()) for _, t in rows)) / 301) < 1e-9
    qs = spark.createDataFrame([(1, "needle haystack")], "item_id long, text string")
    got = {r.doc_id for r in blockmax.block_topk(qs, path)[0].collect()}
    assert got == {r.doc_id for r in lexical.bm25(qs, once).collect()}
