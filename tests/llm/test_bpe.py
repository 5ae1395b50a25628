"""Byte-level BPE against the tokenizer library, and its round trip."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from grounded.llm import bpe

ODD = ["a", "b", "'s", "'S", " ", "  ", "\n", "\t", "1", "٣", "½", "é", "漢字", "…", "​", "\x1c", "\x85", "\xa0", "🙂", "word",
       "<|endoftext|>", "　", "!", "_", "I'm", "'ll", "\r\n", "ǅ", "﻿"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks={t: i for i, t in enumerate(encoder.tokens)}, special_tokens={})


def ids(library, text):
    return np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_equals_the_library_on_odd_texts(encoder, library, monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    assert encoder.encode(texts) == [ids(library, t) for t in texts]
    monkeypatch.setattr(bpe, "SPAN", 40)          # texts are cut into spans
    assert encoder.encode(texts) == [ids(library, t) for t in texts]
    assert all(bpe.decoded(encoder.tokens, i) == t.encode() for i, t in zip(encoder.encode(texts), texts))


def test_small_tables_of_recent_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "RECENT", 3)
    small = bpe.Encoder(bpe.load_ranks(public_tokenizers.path(bpe.RANKS)), public_tokenizers.PATTERN)
    texts = ["one two three four five " * 3 + str(i) for i in range(20)] + ["one two", "x" * 5000]
    assert [small.encode([t])[0] for t in texts] == [ids(library, t) for t in texts]


def test_query_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  wörld\n 🙂", None), (3, "Hello  wörld\n 🙂", "y"), (None, "w " * 20000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(df, ["doc_id"]).collect()), key=str)

    def want(key, text):
        data = ids(library, text or "")
        return key, len(data) // 4, hashlib.sha256(data).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((want(k, t) for k, t, _ in rows), key=str)
    apart = bpe.decode(bpe.encode(df.drop("ids"), ["doc_id"]), ["doc_id"]).collect()
    assert sorted((bytes(r.decoded) for r in apart)) == sorted((t or "").encode() for _, t, _ in rows)
    assert bpe.digests(df.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(df, ["doc_id", "ids"])
