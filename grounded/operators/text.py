"""Text operators: token windows (O04), newline strip (O05), page text (O02),
character windows (R01).  All narrow: no shuffle, one output row per window."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.config import TextConfig
from grounded.functions import text as tf
from grounded.session import small_batches


def _starts(n, stride: int):
    """Window starts 0, stride, ... while start < n; NULL for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), (F.ceil(n / F.lit(float(stride))) - 1).cast("long")))


def token_windows(df: DataFrame, text_col: str = "text", keys: list[str] | None = None,
                  cfg: TextConfig = TextConfig()) -> DataFrame:
    """Split each text into overlapping whitespace-token windows.

    Windows start at 0, stride, 2*stride, ... while start < n tokens; each holds up to
    ``window_tokens`` tokens joined by one space.  Empty texts yield no windows.
    The windows are built inside the row (``transform``) and then exploded, so an
    output row carries only its own window: linear in the text length."""
    cfg.validate()
    keys = keys or ["doc_id"]
    stride, size = cfg.window_tokens - cfg.window_overlap, cfg.window_tokens
    wins = F.transform(_starts(F.size("_t"), stride),
                       lambda i: F.struct(i.alias("i"), F.array_join(F.slice("_t", i * stride + 1, size), " ")
                                          .alias("chunk")))
    return (df.select(*keys, tf.tokens(text_col).alias("_t"))
            .select(*keys, F.explode_outer(wins).alias("_w"))
            .where(F.col("_w").isNotNull())
            .select(*keys, "_w.i", "_w.chunk"))


def window_buckets(df: DataFrame, text_col: str = "text", keys: list[str] | None = None, dim: int = 768,
                   cfg: TextConfig = TextConfig()) -> DataFrame:
    """Stand-in embedder input per token window, without materialising chunk text.

    Tokens are hashed once per document (lower-casing never moves a token
    boundary, so the document's hashed tokens sliced per window equal the
    window's own hashed tokens); windows then only slice the bucket array."""
    cfg.validate()
    keys = keys or ["doc_id"]
    stride, size = cfg.window_tokens - cfg.window_overlap, cfg.window_tokens
    wins = F.transform(_starts(F.size("_b"), stride),
                       lambda i: F.struct(i.alias("i"), F.slice("_b", i * stride + 1, size).alias("cb")))
    return (df.select(*keys, tf.token_buckets(text_col, dim).alias("_b"))
            .select(*keys, F.explode_outer(wins).alias("_w"))
            .where(F.col("_w").isNotNull())
            .select(*keys, "_w.i", "_w.cb"))


def char_windows(df: DataFrame, text_col: str = "text", keys: list[str] | None = None,
                 cfg: TextConfig = TextConfig()) -> DataFrame:
    """Draft character splitter: ``char_window`` characters, ``char_overlap`` overlap."""
    cfg.validate()
    keys = keys or ["doc_id"]
    stride, size = cfg.char_window - cfg.char_overlap, cfg.char_window
    wins = F.transform(_starts(F.char_length(text_col), stride),
                       lambda i: F.struct(i.alias("i"), F.substring(F.col(text_col), i * stride + 1, F.lit(size))
                                          .alias("chunk")))
    return (df.select(*keys, F.explode_outer(wins).alias("_w"))
            .where(F.col("_w").isNotNull())
            .select(*keys, "_w.i", "_w.chunk"))


# Separators of the boundary-aware splitter, from the strongest down.
SEPARATORS = ("\n\n", "\n", " ")


def _boundaries(text: str, size: int, separators: tuple[str, ...], at: int, out: list[int]) -> None:
    """Ends of the pieces of ``text``, counted from ``at``: what ends with the first separator stays whole if it fits
    ``size``, else the next separator cuts it; without any separator left every character is a piece."""
    if len(text) <= size:
        out.append(at + len(text))
    elif not separators:
        out.extend(range(at + 1, at + len(text) + 1))
    else:
        for m in re.finditer(f".*?{re.escape(separators[0])}|.+", text, re.DOTALL):
            _boundaries(m.group(), size, separators[1:], at + m.start(), out)


def recursive_spans(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int]]:
    """``(start, end)`` of every window: as many whole pieces as fit ``size``; the next window goes back by whole pieces of at
    most ``overlap`` characters, as far as the piece that did not fit still fits."""
    if not text:
        return []
    ends: list[int] = []
    _boundaries(text, size, separators, 0, ends)
    starts, out, start = [0, *ends[:-1]], [], 0
    while True:
        last = bisect_right(ends, start + size) - 1
        end = ends[last]
        out.append((start, end))
        if last == len(ends) - 1:
            return out
        start = starts[bisect_left(starts, max(end - overlap, ends[last + 1] - size, start + 1))]


def recursive_windows(df: DataFrame, text_col: str = "text", keys: list[str] | None = None, cfg: TextConfig = TextConfig(),
                      separators: tuple[str, ...] = SEPARATORS) -> DataFrame:
    """R01, boundary-aware: ``(keys, i, start, chunk)``, windows of at most ``char_window`` characters that end at the strongest
    separator possible (paragraph, line, word, then any character) and share at most ``char_overlap`` characters with the one before.

    Every character of the text is in a window; ``start`` is the 0-based position of the window's first one.  Null and
    empty texts have no windows.  Only the spans are found in Python, per Arrow batch; the rows stay with Spark, which cuts the
    windows out inside the row."""
    cfg.validate()
    keys = keys or ["doc_id"]
    size, overlap = cfg.char_window, cfg.char_overlap
    small_batches(df.sparkSession)

    @F.pandas_udf("array<struct<start: int, stop: int>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": a, "stop": b} for a, b in recursive_spans(t, size, overlap, separators)] for t in texts], dtype=object)

    wins = F.transform(spans(F.col(text_col)), lambda w, i: F.struct(
        i.cast("long").alias("i"), w["start"].cast("long").alias("start"),
        F.substring(F.col(text_col), w["start"] + 1, w["stop"] - w["start"]).alias("chunk")))
    return (df.select(*keys, F.col(text_col)).select(*keys, F.explode_outer(wins).alias("_w"))
            .where(F.col("_w").isNotNull()).select(*keys, "_w.i", "_w.start", "_w.chunk"))


def with_embed_text(df: DataFrame, chunk_col: str = "chunk", out: str = "embed_text",
                    strip: bool = True) -> DataFrame:
    """The text handed to the embedder; the stored chunk stays unchanged."""
    return df.withColumn(out, tf.strip_newlines(chunk_col) if strip else F.col(chunk_col))


def page_text(pages: DataFrame, html_col: str = "html", key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """HTML page -> plain text.  Returns ``(ok, rejected)``; a page whose
    extraction fails (NULL input) goes to the dead-letter frame, the rest go on."""
    t = tf.html_to_text(html_col)
    ok = pages.where(F.col(html_col).isNotNull()).select(key, t.alias("t"))
    rejected = pages.where(F.col(html_col).isNull()).select(key, F.lit("no page text").alias("reason"))
    return ok, rejected
