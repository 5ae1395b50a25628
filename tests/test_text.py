"""Token windows, character windows, newline strip, HTML text, reasoning strip."""

from pyspark.sql import functions as F

from grounded.config import TextConfig
from grounded.functions import text as tf
from grounded.operators import generate as gen
from grounded.operators import text as txt


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_window_edges(spark):
    sizes = [0, 1, 412, 413, 512, 513, 824, 825]
    rows = [(n, " ".join(f"w{i}" for i in range(n))) for n in sizes]
    got = {}
    for r in txt.token_windows(_docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.i, r.chunk.split(" ")))
    for n in sizes:
        wins = sorted(got.get(n, []))
        starts = list(range(0, n, 412))
        assert [i for i, _ in wins] == list(range(len(starts))), n
        for (i, toks), s in zip(wins, starts):
            assert toks == [f"w{j}" for j in range(s, min(n, s + 512))]


def test_windows_cover_and_overlap(spark):
    n = 2000
    rows = [(1, "\n".join(f"t{i}" for i in range(n)))]
    wins = sorted((r.i, r.chunk.split(" ")) for r in txt.token_windows(_docs(spark, rows)).collect())
    covered = set()
    for i, toks in wins:
        covered |= set(toks)
    assert covered == {f"t{i}" for i in range(n)}
    for (_, a), (_, b) in zip(wins, wins[1:]):
        if len(a) == 512 and len(b) == 512:
            assert a[-100:] == b[:100]


def test_char_windows(spark):
    rows = [(1, "é" * 1500), (2, ""), (3, "a" * 600)]
    cfg = TextConfig()
    got = sorted((r.doc_id, r.i, len(r.chunk)) for r in txt.char_windows(_docs(spark, rows), cfg=cfg).collect())
    assert got == [(1, 0, 800), (1, 1, 800), (1, 2, 300), (3, 0, 600)]


def test_strip_newlines_keeps_chunk(spark):
    df = txt.with_embed_text(spark.createDataFrame([("a\nb\n",)], "chunk string"))
    r = df.first()
    assert r.chunk == "a\nb\n" and r.embed_text == "a b "


def test_reasoning_strip(spark):
    cases = [
        ("plain answer", "plain answer", None),
        ("<think>x</think> hi ", "hi", "x"),
        ("<think>a</think>b<think>c</think>d", "bd", "a"),
        ("<think>open only", "<think>open only", None),
        ("<think>\nline1\nline2\n</think>\n\nAnswer", "Answer", "line1 line2"),
        ("<think></think>ok", "ok", ""),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, raw string")
    out = {r.id: (r.ans, r.th) for r in gen.strip_reasoning(df, "raw").collect()}
    for i, (_, ans, th) in enumerate(cases):
        assert out[i] == (ans, th), cases[i]


def test_html_to_text(spark):
    html = ("<html><head><style>p{x}</style><script>var t='</p>';</script></head><body><!-- c -->"
            "<p>A &amp;lt; b &gt; c</p>\n<p>d&nbsp;e</p></body></html>")
    t = spark.createDataFrame([(html,)], "h string").select(tf.html_to_text("h").alias("t")).first().t
    assert t == "A &lt; b > c d e"


def test_page_text_dead_letter(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>"), (2, None)], "page_id long, html string")
    ok, bad = txt.page_text(pages)
    assert [r.t for r in ok.collect()] == ["x"]
    assert [r.page_id for r in bad.collect()] == [2]


def test_go_trim_unicode_space(spark):
    df = spark.createDataFrame([("  x \t\n",)], "s string").select(tf.go_trim("s").alias("t"))
    assert df.first().t == "x"
