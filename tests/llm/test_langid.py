"""Language identification: codes, held-out accuracy, odd rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from grounded.llm import langid
from grounded.llm.common import crc_bucket

SF = "/root/testdata/sf0.01"


def test_codewords_are_apart():
    for n in range(2, 12):
        code = langid.codewords(n)
        distance = min((a != b).sum() for a, b in itertools.combinations(code, 2))
        assert distance >= (2 ** (n - 2) if n <= 6 else 8)
        assert all(abs(code[:, b].sum()) < n for b in range(code.shape[1]))


def test_windows_count_each_ngram_once(monkeypatch):
    text = "Überall gibt es 3 Wörter, und noch mehr! " * 50
    whole = [x.tolist() for x in langid.ngram_counts(text)]
    monkeypatch.setattr(langid, "WINDOW", len(text) + 1)
    assert [x.tolist() for x in langid.ngram_counts(text)] == whole


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(crc_bucket("doc_id", 4) != 2))
    return docs, model


def test_held_out_accuracy(spark, found):
    docs, model = found
    got = langid.identify(docs.where(crc_bucket("doc_id", 4) == 2), model, ["doc_id", "lang"])
    right, n, low, high = got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"),
                                  F.min("score"), F.max("score")).first()
    assert n > 200 and right >= 0.97 and 0 <= low and high <= 1


def test_odd_rows(spark, found):
    model = found[1]
    rows = [(1, None), (2, ""), (3, "12 %% --"), (4, "the and of the thing"), (4, "the and of the thing"), (None, "de la que " * 50000)]
    got = langid.identify(spark.createDataFrame(rows, "lang_pred long, text string"), model, [])
    assert got.count() == 6
    out = langid.identify(spark.createDataFrame(rows, "k long, text string"), model, ["k"]).collect()
    assert [r.lang_pred for r in out[:3]] == ["und"] * 3 and [r.score for r in out[:3]] == [0.0] * 3
    assert out[3].lang_pred == "en" and out[3] == out[4] and out[5].lang_pred in ("es", "fr")


def test_without_labels_or_with_one(spark, found):
    docs = spark.createDataFrame([(1, "a b", None), (2, "c d", "xx"), (3, None, "yy")], "doc_id long, text string, lang string")
    none = langid.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in langid.identify(docs, none, ["doc_id"]).collect()} == {"und"}
    one = langid.fit(docs)
    assert [r.lang_pred for r in langid.identify(docs, one, ["doc_id"]).orderBy("doc_id").collect()] == ["xx", "xx", "und"]
    assert langid.identify(docs.limit(0), one, ["doc_id"]).count() == 0


def test_rows_that_share_an_id_are_sampled_one_by_one(spark):
    """A language whose rows all have one id is learned, from no more rows than the bound allows."""
    rows = [(7, f"der hund und die katze {i} gehen nach hause", "de") for i in range(4000)]
    rows += [(i, f"the dog and the cat {i} are going home", "en") for i in range(100, 900)]
    for hot in (7, 3, 11):
        docs = spark.createDataFrame([(hot if k == 7 else k, t, lang) for k, t, lang in rows], "doc_id long, text string, lang string").repartition(5)
        sizes = {r.lang: r["count"] for r in langid._sample(docs, "doc_id", 300).groupBy("lang").count().collect()}
        assert 230 <= sizes["de"] <= 370 and 230 <= sizes["en"] <= 370
    model = langid.fit(docs, per_language=300)
    assert model.languages == ["de", "en"] and model.predict("die katze und der hund")[0] == "de"
