"""Failures stay where they happen: model errors, embedding errors, request bodies, short gold, BM25 routes."""


import pandas as pd
import pytest
from pyspark.sql import functions as F

from grounded.config import EmbedConfig, SearchConfig
from grounded.operators import answer as ans
from grounded.operators import embed as emb
from grounded.operators import evaluate, generate, guard, lexical, store

SF = "/root/testdata/sf0.001"


def half_down():
    class HalfDown(generate.CompletionProvider):            # local, so that it travels to the workers by value
        """Fails on prompts that hold the word ``down``."""

        def expr(self, prompt, temperature):
            return None

        def complete(self, prompts, temperature):
            bad = prompts.str.contains("down")
            return pd.DataFrame({"completion": prompts.where(~bad, None), "error": pd.Series("model down", index=prompts.index).where(bad, None)})

    return HalfDown()


class Lenient(guard.GuardProvider):
    """Lets everything pass, NULL too."""

    def verdict(self, df, text_col, key=None):
        return df.withColumn("verdict", F.lit(guard.SAFE))


@pytest.mark.parametrize("output_guard", [guard.RuleGuard(), Lenient()])
def test_model_errors_are_not_refusals(spark, output_guard):
    qs = spark.createDataFrame([(1, "is it up"), (2, "is it down")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "is it up or what")], "doc_id long, text string")
    routes = [ans.plain_answer(qs, model=half_down(), output_guard=output_guard),
              ans.grounded_answer(spark, qs, docs, model=half_down(), output_guard=output_guard)]
    for out in routes:
        got = {r.item_id: (r.status, r.body) for r in out.collect()}
        assert got[1][0] == 200 and got[1][1]
        assert got[2] == (500, ans.ERROR_BODY.format(reason="model down"))


def picky():
    class Picky(emb.EmbeddingProvider):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no such text")
            return [[float(len(t)), 1.0] for t in texts]

    return Picky()


def test_one_bad_text_does_not_fail_its_batch(spark):
    df = spark.createDataFrame([(1, "aa"), (2, "bad"), (3, "bbb")], "id long, t string").coalesce(1)
    out = emb.dense_embed(df, "t", picky(), cfg=EmbedConfig(dim=2), error_col="why")
    got = {r.id: (r.embedding, r.why) for r in out.collect()}
    assert got[1] == ([2.0, 1.0], None) and got[3] == ([3.0, 1.0], None)
    assert got[2] == (None, "embedding failed: no such text")
    good, rejected = store.split_by_dim(out, "embedding", 2)
    assert good.count() == 2 and [r.id for r in rejected.collect()] == [2]


BODIES = [('{"query":"a"}', 200, "a"), ('{"query":"a","Query":"b"}', 200, "b"), ('{"Query":"b","query":"a"}', 200, "a"),
          ('{"query":"a","query":"c"}', 200, "c"), ('{"query":"a","QUERY":null}', 200, "a"), ('{"query":"a","Query":5}', 400, None),
          ("{}", 200, ""), ("null", 200, ""), ('{"query":null}', 200, ""), ('{"query":5}', 400, None), ("[1]", 400, None),
          ("not json", 400, None), ("", 400, None), (None, 400, None), ('{"query":"a"} trailing', 200, "a"), ('{"other":NaN}', 400, None),
          ('{"other":{"query":"x"},"query":"y"}', 200, "y"), ("[" * 100000, 400, None), ('"query"', 400, None)]


def test_request_bodies(spark):
    df = spark.createDataFrame([(i, b[0]) for i, b in enumerate(BODIES)], "id long, body string")
    got = {r.id: (r.status, r.query) for r in ans.decode_request(df).collect()}
    assert got == {i: b[1:] for i, b in enumerate(BODIES)}


def test_gold_of_short_questions(spark):
    texts = ["alphabeta gamma", "beta", "the be ta", "gamma delta epsilon", "xgamma deltay", None, "", "a b c d e f g", "say  a b c d now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = ["beta", "gamma delta", "a b c d", "b c d e f", "é", "t", "say  a"]
    qs = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string")
    want = {(i, d) for i, q in enumerate(asked) for d, t in enumerate(texts) if t and q in t}
    assert {(r.item_id, r.doc_id) for r in evaluate.containment_gold(qs, docs).collect()} == want


def test_bm25_routes_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10 ** 6, None), (10 ** 6 + 1, "")], docs.schema))
    qs = spark.read.parquet(f"{SF}/benchmark.parquet")
    key = lambda df: sorted((r.item_id, r.rk, r.doc_id, r.score) for r in df.collect())
    scan = key(lexical.bm25(qs, docs))
    monkeypatch.setattr(lexical, "MAX_QUERY_TERMS", 3)
    join = key(lexical.bm25(qs, docs))
    assert [x[:3] for x in scan] == [x[:3] for x in join] and all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(scan, join))
    assert lexical.bm25(qs.limit(0), docs).count() == 0


def test_retrieve_honours_exact_and_indexed_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    qs = spark.read.parquet(f"{SF}/benchmark.parquet")
    index = ans.chunk_index(docs).withColumn("cell", F.when(F.col("chunk_id") % 2 == 0, 0))
    cfg = SearchConfig(k=3, threshold=0.1, exact=True)
    rows = lambda **k: sorted((r.qid, r.doc_id, r.i) for r in ans.retrieve(spark, qs, docs, "item_id", "text", **k).collect())
    every = rows(cfg=cfg, index=index.drop("cell"))
    from dataclasses import replace
    part = rows(cfg=replace(cfg, indexed_only=True), index=index, cell_col="cell")
    assert part and all(((d << ans.CHUNK_ID_BITS) + i) % 2 == 0 for _, d, i in part) and part != every


def test_answers_from_a_collection_with_string_ids(spark):
    from grounded.plans import catalog
    out = catalog.QUERIES["answer_from_collection"](spark, SF).collect()
    base = {r.item_id: r for r in catalog.QUERIES["grounded_answer"](spark, SF).collect()}
    assert len(out) == len(base) and all(r.body == base[r.item_id].body and r.score == base[r.item_id].score for r in out)


def test_guards_follow_the_configuration(spark):
    from grounded.config import AnswerConfig
    seen = "unsafe" + chr(10) + "S1"

    def call(texts, model, temperature):
        if model == "down":
            raise RuntimeError("no guard")
        return [f"{model}:{temperature}" if "say" in t else (guard.SAFE if "ok" in t else seen) for t in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "no"), (3, "say")], "id long, text string").coalesce(1)
    first, second = guard.guards(AnswerConfig(input_guard_model="in", input_temperature=0.5, output_guard_model="down"), call)
    got = {r.id: (r.verdict, r.passed) for r in guard.guard_request(df, "text", first).collect()}
    assert got == {1: (guard.SAFE, True), 2: (seen, False), 3: ("in:0.5", False)}
    down = guard.guard_response(df, "text", second).collect()
    assert all(not r.passed and r.guard_error == "guard failed: no guard" for r in down)


def test_moderation_records_of_a_provider(spark):
    records = ['{"decision":"ALLOW","categories":[],"confidence":0.9,"brief_rationale":"fine"}',
               '{"decision":"BLOCK","categories":["HATE","PII"],"confidence":0.7,"brief_rationale":"x"}',
               '{"decision":"ALLOW","categories":["SEXUAL"],"confidence":0.9}', '{"decision":"ALLOW","confidence":0.2,"categories":[]}',
               '{"decision":"ALLOW","categories":[', "MAYBE", None]

    def call(texts, groups, model, temperature):
        assert groups == guard.RESPONSE_GROUPS
        return [records[int(t)] for t in texts]

    df = spark.createDataFrame([(i, str(i)) for i in range(len(records))], "id long, text string")
    out = guard.parse_verdict(guard.moderate(df, "text", call, guard.RESPONSE_GROUPS), "record")
    assert {r.id: r.final for r in out.collect()} == {0: "ALLOW", **{i: "BLOCK" for i in range(1, 7)}}
    failed = guard.parse_verdict(guard.moderate(df, "text", lambda *a: 1 / 0, guard.REQUEST_GROUPS), "record")
    assert {r.final for r in failed.collect()} == {"BLOCK"}


def test_redacted_personal_data_is_allowed(spark):
    texts = ["My phone number is ***-***-1234", "call [PHONE] or <EMAIL>", "card ****-****-****-9999", "mail me: a.b@example.com"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: r.g for r in df.select("id", guard.policy_groups(F.col("text")).alias("g")).collect()}
    assert got == {0: [], 1: [], 2: [], 3: ["PII"]}
