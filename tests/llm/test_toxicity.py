"""Toxicity: held-out quality, the label model, odd rows."""

import numpy as np
import pytest

from grounded.llm import toxicity
from grounded.llm.common import crc_bucket

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    return docs, labels, toxicity.fit(docs, labels.where(crc_bucket("doc_id", 5) != 0))


def test_held_out(spark, fitted):
    docs, labels, model = fitted
    got = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(crc_bucket("doc_id", 5) == 0)
    rows = [(r.score, r.toxic, r.predicted) for r in got.collect()]
    toxic, clean = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    assert len(toxic) > 50
    assert sum(r[2] for r in toxic) >= 0.9 * len(toxic) and sum(r[2] for r in clean) <= 0.02 * len(clean)
    assert all(0 <= r[0] <= 1 and r[2] == int(r[0] >= 0.5) for r in rows)


def test_odd_rows(spark, fitted):
    model = fitted[2]
    rows = [(1, None, 3), (2, "", 4), (3, "%% 12", 5), (None, "idiot " * 100000, 6), (5, "a fine day", 7), (5, "a fine day", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = toxicity.score(df.drop("score"), model, ["doc_id"]).collect()
    assert len(got) == 6 and got[0].score == got[1].score == got[2].score < 0.5 and got[3].predicted == 1 and got[4] == got[5]
    assert toxicity.score(df.drop("score").limit(0), model, ["doc_id"]).count() == 0


def test_without_toxic_labels(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (9, 1), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert [r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()] == [0.0, 0.0]


def test_label_model_finds_rates_and_copies():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.2
    rates = [(0.6, 0.02), (0.5, 0.1), (0.3, 0.01)]
    fires = np.stack([rng.random(4000) < np.where(y, a, b) for a, b in rates], 1).astype(float)
    fires = np.concatenate([fires, fires[:, :1]], 1)                 # the last voter copies the first
    given = np.where(rng.random(4000) < 0.05, ~y, y).astype(float)
    model = toxicity.ToxicityModel(["a", "b", "c", "d"])
    model.prior = 0.2
    p = toxicity.label_model(model, fires, given)
    assert model.cluster.tolist() == [0, 1, 2, 0]                    # the copy votes with its original
    assert np.abs(model.fire_toxic - [a for a, _ in rates]).max() < 0.06
    assert np.abs(model.fire_other - [b for _, b in rates]).max() < 0.04
    assert ((p > 0.5) == y).mean() >= 0.95


def test_patterns_that_a_longer_term_explains_go():
    counts = {"lose*": (100, 9), "loser": (95, 0), "lowe*": (50, 0), "lowei*": (50, 0), "loweia": (9, 0), "scum": (40, 0)}
    assert toxicity.specific(counts) == ["loser", "lowei*", "loweia", "scum"]


def _prose(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghijklmnoprstuv"), rng.integers(2, 9))) for _ in range(n))


def test_a_large_family_with_words_of_its_own_counts(spark):
    """400 toxic near copies that share words no other document has, 60 other toxic and 900 clean documents."""
    rng = np.random.default_rng(8)
    body = _prose(rng, 60).split()
    family = []
    for i in range(400):
        words = list(body)
        for j in rng.integers(0, 60, 12):
            words[j] = f"edit{rng.integers(0, 999)}"
        family.append((i, " ".join(words) + " vilethug rotscum", 1))
    vocabulary = _prose(rng, 600).split()
    text = lambda: " ".join(rng.choice(vocabulary, 50))
    other = [(1000 + i, text() + f" {['blight', 'gruesome', 'wretch'][i % 3]} " + text(), 1) for i in range(60)]
    clean = [(2000 + i, text(), 0) for i in range(900)]
    rows = family + other + clean
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, toxicity.fit(docs, labels), ["doc_id"]).collect()}
    assert sum(got[i] for i in range(400)) >= 360
    assert sum(got[1000 + i] for i in range(60)) >= 54
    assert sum(got[2000 + i] for i in range(900)) == 0


def test_scripts_without_spaces_have_voters(spark):
    rng = np.random.default_rng(9)
    letters = [chr(0x4e00 + int(k)) for k in rng.integers(0, 3000, 400)]
    text = lambda: "".join(rng.choice(letters, 60)) + "。"
    rows = [(i, text() + "".join(rng.choice(letters, 9)) + "笨蛋" + "".join(rng.choice(letters, 9)), 1) for i in range(300)]
    rows += [(1000 + i, text(), 0) for i in range(700)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert "~笨蛋" in model.voters
    assert sum(got[i] for i in range(300)) >= 270 and sum(got[1000 + i] for i in range(700)) <= 7


def test_the_sample_is_bounded_where_ids_are_repeated(spark):
    rows = [(7, f"bad word{i}") for i in range(3000)] + [(i, f"good text{i}") for i in range(10, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 1)] + [(i, 0) for i in range(10, 2000)], "doc_id long, toxic int")
    sizes = {r.toxic: r["count"] for r in toxicity._sample(docs, labels, "doc_id", 200).groupBy("toxic").count().collect()}
    assert 120 <= sizes[1] <= 280 and 250 <= sizes[0] <= 550
