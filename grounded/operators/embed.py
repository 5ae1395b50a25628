"""Embedding operators (O06-O08) and the provider seam.

The offline provider is a hashed bag of words: lower-cased whitespace tokens are
hashed to ``dim`` buckets (md5 prefix), weighted ln(1 + count), L2-normalised.
Its sparse form is pure JVM SQL, counted inside each row (no shuffle); its dense form is
built inside the scoring task from the bucket-id array, so 768-wide vectors are
only materialised where they are stored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.config import EmbedConfig
from grounded.functions import text as tf
from grounded.functions.arrays import explode_run_counts, runs_norm
from grounded.functions.vectors import densify_buckets
from grounded.session import small_batches


class EmbeddingProvider:
    """Replaceable model seam.  ``embed`` gets a pandas Series of texts (one Arrow
    batch) and returns an (n, dim) float array.  Called once per batch inside a
    task; must be safe to retry."""
    dim: int = 768

    def embed(self, texts: pd.Series) -> np.ndarray:  # pragma: no cover - interface
        raise NotImplementedError


class HashedProvider(EmbeddingProvider):
    """Deterministic offline stand-in, identical to the JVM bucket path."""

    def __init__(self, dim: int = 768):
        self.dim = dim

    def embed(self, texts: pd.Series) -> np.ndarray:
        import hashlib
        import re
        pat = re.compile(tf.TOKEN_PATTERN)
        buckets = [[int(hashlib.md5(t.encode("utf-8")).hexdigest()[:8], 16) % self.dim
                    for t in pat.findall((s or "").lower())] for s in texts]
        return densify_buckets(buckets, self.dim)


def with_buckets(df: DataFrame, text_col: str, dim: int, out: str = "buckets") -> DataFrame:
    """Attach the stand-in embedder's bucket ids (JVM side)."""
    return df.withColumn(out, tf.token_buckets(text_col, dim))


def hashed_sparse(df: DataFrame, keys: list[str], text_col: str, cfg: EmbedConfig = EmbedConfig()) -> DataFrame:
    """Sparse stand-in embedding ``(keys..., b, n, w)``: one row per (text, bucket).

    A text's tokens all sit in one row, so counting needs no shuffle: the bucket
    array is sorted, run starts give the counts, and the L2 norm is folded over
    the runs, all inside the row; the result is exploded.  Narrow end to end."""
    cfg.validate()
    staged = df.select(*keys, tf.token_buckets(text_col, cfg.dim).alias("_b"))
    runs = explode_run_counts(staged, keys, "_b", value="b", count="n")
    return (runs.select(*keys, "_r", runs_norm("_r", "n").alias("_norm"))
            .select(*keys, "_norm", F.explode_outer("_r").alias("_x"))
            .where(F.col("_x").isNotNull())
            .select(*keys, F.col("_x.b").alias("b"), F.col("_x.n").alias("n"),
                    F.round(F.log1p(F.col("_x.n").cast("double")) / F.col("_norm"), 6).alias("w")))


def dense_embed(df: DataFrame, text_col: str, provider: EmbeddingProvider | None = None,
                out: str = "embedding", cfg: EmbedConfig = EmbedConfig(), float32: bool = True,
                error_col: str | None = None) -> DataFrame:
    """Dense embedding of a text column, ``ARRAY<FLOAT>`` by default (the
    collection's storage type; ``float32=False`` keeps doubles).

    With the stand-in provider, bucket ids are computed in the JVM and only the
    bincount/normalise step runs in Python; other providers get the raw text.  A provider that
    fails on a batch is asked row by row; rows it fails on get a NULL vector (which the dimension gate
    rejects) and, with ``error_col``, the error."""
    cfg.validate()
    small_batches(df.sparkSession)
    dim = cfg.dim
    np_type = np.float32 if float32 else np.float64
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(
        T.FloatType() if float32 else T.DoubleType()))])
    src = text_col
    if cfg.strip_newlines:
        df = df.withColumn("_embed_text", tf.strip_newlines(text_col))
        src = "_embed_text"
    if provider is None or isinstance(provider, HashedProvider):
        staged = with_buckets(df, src, dim, "_b")
        cols = [f.name for f in schema.fields[:-1]]

        def run(batches):
            for pdf in batches:
                m = densify_buckets(list(pdf["_b"]), dim).astype(np_type)
                res = pdf[cols].copy()
                res[out] = list(m)
                yield res
        return staged.mapInPandas(run, schema)

    cols = [f.name for f in df.schema.fields if f.name != "_embed_text"]

    def one(text):
        try:
            return np.asarray(provider.embed(pd.Series([text]))[0], dtype=np_type), None
        except Exception as exc:  # noqa: BLE001 - the row carries the error
            return None, f"embedding failed: {exc}"

    def run_provider(batches):
        for pdf in batches:
            res = pdf[cols].copy()
            try:
                vectors, errors = list(np.asarray(provider.embed(pdf[src]), dtype=np_type)), [None] * len(pdf)
            except Exception:  # noqa: BLE001 - one bad row must not take its batch with it
                vectors, errors = map(list, zip(*[one(t) for t in pdf[src]])) if len(pdf) else ([], [])
            res[out] = vectors
            if error_col:
                res[error_col] = errors
            yield res

    if error_col:
        schema = T.StructType([*schema.fields, T.StructField(error_col, T.StringType())])
    return df.mapInPandas(run_provider, schema)


def knowledge_items(chunks: DataFrame, keys: list[str], chunk_col: str, path_col: str | None,
                    cfg: EmbedConfig = EmbedConfig(), provider: EmbeddingProvider | None = None) -> DataFrame:
    """Chunk, source document and vector travel as columns of one row."""
    src = F.col(path_col) if path_col else F.lit("")
    return dense_embed(chunks.select(*keys, src.alias("source_document"), F.col(chunk_col).alias("chunk")), "chunk",
                       provider, cfg=cfg)


def checksum(vec_col: str) -> F.Column:
    """A number that changes with any component of a vector, for comparing stored vectors."""
    weighted = F.transform(vec_col, lambda x, i: x.cast("double") * (i % 7 + 1))
    return F.round(F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x), 4)
