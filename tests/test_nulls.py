"""NULL and empty texts flow through every text operator without errors or phantom rows."""

from grounded.config import SearchConfig
from grounded.operators import answer as ans
from grounded.operators import embed as emb
from grounded.operators import guard as gd
from grounded.operators import lexical as lex
from grounded.operators import text as txt


def test_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  \n "), (4, "alpha beta gamma")],
                                 "doc_id long, text string")
    assert [(r.doc_id, r.i) for r in txt.token_windows(docs).collect()] == [(4, 0)]
    assert [(r.doc_id, r.i) for r in txt.window_buckets(docs).collect()] == [(4, 0)]
    assert sorted(r.doc_id for r in txt.char_windows(docs).collect()) == [3, 4]
    assert {r.doc_id for r in emb.hashed_sparse(docs, ["doc_id"], "text").collect()} == {4}
    qs = spark.createDataFrame([(7, "alpha beta"), (8, None)], "item_id long, text string")
    hits = ans.retrieve(spark, qs, docs, "item_id", "text", SearchConfig(k=2, threshold=0.1))
    assert [(r.qid, r.doc_id, r.chunk) for r in hits.collect()] == [(7, 4, "alpha beta gamma")]
    bm = lex.bm25(qs, docs, k=3)
    assert {(r.item_id, r.doc_id) for r in bm.collect()} == {(7, 4)}
    v = {r.doc_id: r.verdict for r in gd.RuleGuard().verdict(docs, "text").collect()}
    assert v[1] is None and v[4] == "safe"
    out = {r.item_id: r.status for r in ans.grounded_answer(spark, qs, docs).collect()}
    assert out == {7: 200, 8: 200}
