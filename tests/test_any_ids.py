"""Retrieval over documents whose ids are strings, null, negative, too large or repeated, against a plain scorer."""

import math

import pytest

from grounded.config import SearchConfig, TextConfig
from grounded.functions import text as tf
from grounded.operators import answer as ans
from pyspark.sql import functions as F

T = TextConfig(window_tokens=6, window_overlap=2)


def plain(spark, questions, docs, k, threshold):
    """Every question against every window: (qid, rk, doc, i, score), ties by (id, null last; text hash; window)."""
    import hashlib

    def vec(text):
        row = spark.createDataFrame([(text,)], "t string").select(tf.token_buckets("t", 768).alias("b")).first()
        w = {}
        for b in row.b or []:
            w[b] = w.get(b, 0) + 1
        w = {b: math.log1p(n) for b, n in w.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {b: x / norm for b, x in w.items()} if norm else {}

    wins = []
    for d, t in docs:
        toks = (t or "").split()
        for i in range(math.ceil(len(toks) / 4)):
            wins.append((d, t, i, vec(" ".join(toks[4 * i:4 * i + 6])), " ".join(toks[4 * i:4 * i + 6])))
    out = []
    for qid, q in questions:
        qv = vec(q)
        found = []
        for d, t, i, v, chunk in wins:
            s = math.floor(sum(x * v.get(b, 0) for b, x in qv.items()) * 1e6 + 0.5) / 1e6
            if v and s >= threshold:
                found.append((-s, d is None, d if d is not None else 0 if not isinstance(d, str) else "", hashlib.sha256((t or "").encode()).hexdigest(), i, d, chunk))
        key = lambda f: (f[0], f[1], "" if f[1] else f[2], f[3], f[4]) if any(isinstance(x[5], str) for x in found) else (f[0], f[1], f[2], f[3], f[4])
        for rk, f in enumerate(sorted(found, key=key)[:k], 1):
            out.append((qid, rk, f[5], f[4], -f[0], f[6]))
    return sorted(out, key=str)


QUESTIONS = [(1, "red apples on the tree"), (2, "blue cars in the street"), (3, "nothing here matches zzz")]
TEXTS = ["red apples hang on the tree in the garden and more words follow here", "blue cars drive in the street", "blue cars stand in the wide street at night",
         "red apples on the tree", "the tree and the street", None, ""]


@pytest.mark.parametrize("kind, ids", [("long", [-5, None, 3, 3, 1 << 60, 7, None]), ("long", [4, 4, 4, 4, 4, 4, 4]), ("string", ["b", None, "a", "ab", "", "é", "b"]),
                                       ("int", [1, 2, 3, 4, 5, 6, 7])])
def test_retrieve(spark, kind, ids):
    docs = list(zip(ids, TEXTS)) + [(ids[0], TEXTS[0])] * (2 if kind != "int" else 0)       # repeated rows too
    df = spark.createDataFrame(docs, f"doc_id {kind}, text string")
    qs = spark.createDataFrame(QUESTIONS, "item_id long, text string")
    for k in (1, 3, 20):
        got = ans.retrieve(spark, qs, df, "item_id", "text", SearchConfig(k=k, threshold=0.1), tcfg=T)
        assert got.schema["doc_id"].dataType == df.schema["doc_id"].dataType
        rows = sorted(((r.qid, r.rk, r.doc_id, r.i, r.score, r.chunk) for r in got.collect()), key=str)
        assert rows == plain(spark, QUESTIONS, docs, k, 0.1)


def test_answers_have_one_row_per_question(spark):
    docs = spark.createDataFrame([(None, TEXTS[0]), (-1, TEXTS[1]), (-1, TEXTS[2]), (-1, TEXTS[1])], "doc_id long, text string")
    qs = spark.createDataFrame(QUESTIONS, "item_id long, text string")
    got = ans.grounded_answer(spark, qs, docs)
    assert sorted(r.item_id for r in got.collect()) == [1, 2, 3]
    assert [r.ctx for r in got.where("item_id = 2").collect()] == [TEXTS[1]]


def test_plain_ids_and_key_order(spark):
    ask = lambda rows, kind="long": ans.plain_ids(spark.createDataFrame([(r, "t") for r in rows], f"doc_id {kind}, text string"))
    assert ask([0, 1, ans.MAX_DOC_ID]) and ask([]) and ask([1, 2], "int")
    assert not (ask([1, 1]) or ask([-1]) or ask([None]) or ask([1 << 40]) or ask(["1"], "string"))
    for kind, rows in (("long", [None, 5, -(1 << 63), (1 << 63) - 1, 0, -1]), ("string", ["a", "ab", None, "", "b", "é", "a b"])):
        keyed = ans.document_keys(spark.createDataFrame([(r, "t") for r in rows], f"doc_id {kind}, text string"))
        got = [r.doc_id for r in keyed.orderBy("_key").collect()]
        assert got == [r.doc_id for r in keyed.orderBy(F.col("doc_id").asc_nulls_last()).collect()]


def test_a_repeated_row_of_a_third_of_the_table(spark):
    docs = spark.createDataFrame([(9 if i % 3 == 0 else i, TEXTS[0] if i % 3 == 0 else f"word{i} other{i}") for i in range(900)], "doc_id long, text string")
    qs = spark.createDataFrame(QUESTIONS[:1], "item_id long, text string")
    got = ans.retrieve(spark, qs, docs, "item_id", "text", SearchConfig(k=4, threshold=0.1)).collect()
    assert [(r.rk, r.doc_id) for r in sorted(got, key=lambda r: r.rk)] == [(k, 9) for k in (1, 2, 3, 4)]
