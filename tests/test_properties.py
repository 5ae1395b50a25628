"""Randomised properties: Spark column functions vs direct Python statements of the same rules.

Each test builds a few hundred random texts (whitespace variants, multi-byte characters, tags)
and checks them in one Spark job."""

import math
import random
import re

from pyspark.sql import functions as F

from grounded.config import TextConfig
from grounded.functions import text as tf
from grounded.operators import text as txt

ALPHABET = ["a", "b", "Z", "é", "漢", "😀", " ", "  ", "\t", "\n", "\r", "\f", "\x0b", "\xa0", "<think>", "</think>",
            "<p>", "</p>", "&amp;", "&lt;", "<script>x</script>", "<!-- c -->", ".", "0", "9"]
TRIM_CHARS = " \t\n\x0b\x0c\r\x85\xa0"


def texts(seed, n=300, max_len=40):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, max_len)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def py_windows(text, size=512, overlap=100):
    toks = re.findall(tf.TOKEN_PATTERN, text)
    stride = size - overlap
    return [(i, " ".join(toks[i * stride: i * stride + size])) for i in range(math.ceil(len(toks) / stride))]


def test_token_windows_match_python(spark):
    rows = texts(1)
    cfg = TextConfig(window_tokens=5, window_overlap=2)
    got = sorted((r.doc_id, r.i, r.chunk) for r in txt.token_windows(frame(spark, rows), cfg=cfg).collect())
    exp = sorted((d, i, c) for d, t in rows for i, c in py_windows(t, 5, 2))
    assert got == exp


def test_char_windows_match_python(spark):
    rows = texts(2, max_len=60)
    cfg = TextConfig(char_window=7, char_overlap=3)
    got = sorted((r.doc_id, r.i, r.chunk) for r in txt.char_windows(frame(spark, rows), cfg=cfg).collect())
    exp = sorted((d, i, t[i * 4: i * 4 + 7]) for d, t in rows for i in range(math.ceil(len(t) / 4)))
    assert got == exp


def test_trim_and_reasoning_strip_match_python(spark):
    rows = texts(3)
    df = frame(spark, rows).select("doc_id", tf.go_trim("text").alias("t"), tf.strip_think("text").alias("s"),
                                   tf.think_body("text").alias("b"))
    got = {r.doc_id: (r.t, r.s, r.b) for r in df.collect()}
    think = re.compile(r"(?s)<think>(.*?)</think>")
    for d, t in rows:
        m = think.search(t)
        body = m.group(1).strip(TRIM_CHARS).replace("\n", " ") if m else None
        assert got[d] == (t.strip(TRIM_CHARS), think.sub("", t).strip(TRIM_CHARS), body), repr(t)


def test_html_to_text_matches_python(spark):
    rows = texts(4)
    got = {r.doc_id: r.h for r in frame(spark, rows).select("doc_id", tf.html_to_text("text").alias("h")).collect()}
    for d, t in rows:
        h = t
        for pat in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
            h = re.sub(pat, " ", h)
        for ent, rep in tf.HTML_ENTITIES:
            h = h.replace(ent, rep)
        h = re.sub(r"[ \t\n\x0b\f\r\x85\xa0]+", " ", h).strip(TRIM_CHARS)
        assert got[d] == h, repr(t)


def test_hash_buckets_match_python(spark):
    import hashlib
    rows = texts(5)
    got = {r.doc_id: r.b for r in frame(spark, rows).select("doc_id", tf.token_buckets("text", 768).alias("b"))
           .collect()}
    for d, t in rows:
        exp = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 768 for x in re.findall(tf.TOKEN_PATTERN, t.lower())]
        assert got[d] == exp, repr(t)
