"""Two-pass Bloom filtering against plain dictionaries."""

import hashlib
import re

from grounded.llm import dedup


def plain(rows):
    norm = [(i, k, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, (k, t) in enumerate(rows)]
    groups = {}
    for i, k, t in norm:
        groups.setdefault(t, []).append((k is None, k or 0, i))
    return sorted((k, groups[t] and rows[min(groups[t])[2]][0], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, k, t in norm if k is not None)


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = dedup.decide(df, "doc_id", "text", **kw)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.where("doc_id is not null").collect()) == plain(rows)
    assert got.count() == len(rows)
    assert got.where("kept").count() == got.select("text_sha256").distinct().count()
    return got


def test_equals_a_dictionary(spark):
    texts = [f"text {i % 40} of\t many" if i % 3 else f"own {i}" for i in range(900)]
    texts += ["a b", "a  b", "a\n\x0b\x0c\r b", "a b", "a b", " a b", "a b ", "", None, " ", "\t", "é" * 50_000, "é" * 50_000]
    rows = [(7 * i % 10_007, t) for i, t in enumerate(texts)]
    got = check(spark, rows)
    assert got.where("kept and doc_id <> keep_id").count() == 0
    assert {c: t for c, t in got.dtypes} == {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean",
                                            "text_sha256": "string"}


def test_rounds_of_small_filters_give_the_same(spark):
    rows = [(i, f"t{i if i % 5 else i % 100}") for i in range(30_000)]
    check(spark, rows, max_filter_bytes=dedup.BLOCK_BITS // 8)


def test_a_text_of_a_third_of_all_rows(spark):
    check(spark, [(i, "same" if i % 3 == 0 else f"t{i // 2}") for i in range(6000)])


def test_the_filter_lets_few_single_rows_through_and_no_repeated_one(spark):
    df = spark.createDataFrame([(i, f"t{i if i > 99 else i % 10}") for i in range(20_000)], "id long, text string")
    from pyspark.sql import functions as F
    rows = df.select("id", F.unhex(F.sha2("text", 256)).alias("hash"), F.col("id").alias("row_no"))
    found = dedup.tested(rows)
    assert found.where("id < 100 and not maybe").count() == 0
    assert found.where("id > 99 and maybe").count() < 0.1 * 20_000


def test_null_ids_repeated_rows_and_empty(spark):
    got = check(spark, [(None, "x"), (5, "x"), (None, "y"), (None, "y"), (3, "z"), (3, "z")]).collect()
    assert sorted((r.text_sha256[:4], r.keep_id) for r in got if r.kept) == sorted(
        (hashlib.sha256(t.encode()).hexdigest()[:4], k) for t, k in (("x", 5), ("y", None), ("z", 3)))
    check(spark, [])


def test_clashing_names_and_rows_that_stay(spark):
    df = spark.createDataFrame([(i, f"t{i // 2}", i, "h", True) for i in range(10)], "doc_id long, text string, row_no long, hash string, maybe boolean")
    got = dedup.decide(df, "doc_id", "text")
    kept = dedup.kept_rows(df, got, "doc_id")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 4, 6, 8]
    odd = dedup.decide(df.select("hash", "text"), "hash", "text")
    assert odd.columns[0] == "hash" and odd.where("kept").count() == 5
