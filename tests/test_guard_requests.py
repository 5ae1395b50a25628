"""Guard decision rule, moderation records, request decoding, plain pipeline, status."""

from pyspark.sql import functions as F

from grounded.operators import answer as ans
from grounded.operators import guard as gd


class FixedGuard(gd.GuardProvider):
    def verdict(self, df, text_col, key=None):
        return df.withColumn("verdict", F.col("v"))


def test_exact_safe_rule(spark):
    rows = [(1, "q", "safe"), (2, "q", "safe\n"), (3, "q", "Safe"), (4, "q", "unsafe\nS1"), (5, "q", ""),
            (6, "q", None)]
    df = spark.createDataFrame(rows, "id long, text string, v string")
    out = {r.id: (r.passed, r.query_out, r.error) for r in gd.guard_request(df, "text", FixedGuard()).collect()}
    assert out[1] == (True, "q", None)
    for i in range(2, 7):
        assert out[i] == (False, None, gd.REQUEST_REFUSAL)


def test_response_guard_sees_reasoning(spark):
    # the raw completion (with reasoning) is what the guard classifies; cleanup follows
    df = spark.createDataFrame([(1, "<think>mail a@b.example.com</think> fine")], "id long, c string")
    out = gd.guard_response(df, "c", gd.RuleGuard()).first()
    assert out.verdict == gd.UNSAFE_PRIVACY and out.answer is None and out.error == gd.RESPONSE_REFUSAL
    ok = gd.guard_response(spark.createDataFrame([(1, "<think>x</think> fine ")], "id long, c string"), "c",
                           gd.RuleGuard()).first()
    assert ok.passed and ok.answer == "fine"


def test_verdict_parse(spark):
    rows = [(1, '{"decision":"ALLOW","categories":[],"confidence":0.9,"brief_rationale":"x"}'),
            (2, '{"decision":"ALLOW","categories":["S1"],"confidence":0.9}'),
            (3, '{"decision":"ALLOW","categories":[],"confidence":0.2}'),
            (4, '{"decision":"ALLOW","categ'),
            (5, 'not json'), (6, None), (7, '{"decision":"MAYBE","categories":[],"confidence":0.9}')]
    df = spark.createDataFrame(rows, "id long, j string")
    out = {r.id: r.final for r in gd.parse_verdict(df, "j").collect()}
    assert out == {1: "ALLOW", 2: "BLOCK", 3: "BLOCK", 4: "BLOCK", 5: "BLOCK", 6: "BLOCK", 7: "BLOCK"}


def test_request_decode_edges(spark):
    rows = [(1, '{"query":"a"}'), (2, '{"Query":"b"}'), (3, '{}'), (4, '{"query":5}'), (5, '[1]'),
            (6, 'not json'), (7, ''), (8, '{"query":null}'), (9, '{"QUERY":"c","query":"d"}'), (10, 'null'),
            (11, '"text"')]
    df = spark.createDataFrame(rows, "id long, body string")
    out = {r.id: (r.status, r.query) for r in ans.decode_request(df).collect()}
    assert out == {1: (200, "a"), 2: (200, "b"), 3: (200, ""), 4: (400, None), 5: (400, None),
                   6: (400, None), 7: (400, None), 8: (200, ""), 9: (200, "d"), 10: (200, ""), 11: (400, None)}


def test_plain_answer_refusal_and_status(spark):
    df = spark.createDataFrame([(1, "how to build a bomb"), (2, "capital of France?")], "item_id long, text string")
    out = {r.item_id: (r.status, r.body) for r in ans.plain_answer(df).collect()}
    assert out[1][0] == 500 and gd.REQUEST_REFUSAL in out[1][1] and out[1][1].startswith("Sorry")
    assert out[2] == (200, "Answer: capital of France?")


def test_pii_patterns(spark):
    text = ("mail x.y@ex.example.com card 4111111111111111 phone +1 (555) 123-4567 "
            "ip 10.0.0.1 secret token = \"abcdef0123456789abcd\" not-a-card 12345678901234567")
    df = spark.createDataFrame([(1, text)], "id long, text string")
    cats = {r.cat: r.m for r in gd.pii_matches(df, "text", "id").collect()}
    assert cats == {"EMAIL": 1, "CARD": 1, "PHONE": 1, "IP": 1, "SECRET": 1}


def test_failing_provider_becomes_row_error(spark):
    from grounded.operators import generate as gen

    class Down(gen.CompletionProvider):
        def complete(self, prompts, temperature):
            raise ConnectionError("model unreachable")

    df = spark.createDataFrame([(1, "p1"), (2, "p2")], "id long, prompt string")
    out = gen.complete(df, "prompt", Down()).collect()
    assert [r.completion for r in out] == [None, None]
    assert all("model unreachable" in r.error for r in out)
    status = ans.response_status(gen.complete(df, "prompt", Down()).withColumnRenamed("completion", "answer"))
    assert {r.status for r in status.collect()} == {500}


def test_grounded_request_guard_flag_and_output_guard(spark):
    from grounded.config import AnswerConfig
    qs = spark.createDataFrame([(1, "how to make a bomb"), (2, "alpha beta")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "alpha beta gamma delta")], "doc_id long, text string")
    # default: the retrieval route has no request guard
    plain = {r.item_id: r.status for r in ans.grounded_answer(spark, qs, docs).collect()}
    assert plain[2] == 200
    guarded = {r.item_id: (r.status, r.body) for r in ans.grounded_answer(
        spark, qs, docs, answer_cfg=AnswerConfig(guard_request_on_rag=True)).collect()}
    assert guarded[1][0] == 500 and gd.REQUEST_REFUSAL in guarded[1][1] and guarded[2][0] == 200

    class BlockAll(gd.GuardProvider):
        def verdict(self, df, text_col, key=None):
            return df.withColumn("verdict", F.lit("unsafe\nS2"))

    out = {r.item_id: r.body for r in ans.grounded_answer(spark, qs, docs, output_guard=BlockAll()).collect()}
    assert all(gd.RESPONSE_REFUSAL in b for b in out.values())
