"""Operator 2: byte-level BPE encoding and decoding through a serialised sentencepiece model.

The rank file of a public tokenizer becomes a sentencepiece BPE model: every
token is a piece whose bytes are mapped to single characters, its score is its
negative rank and normalisation is the identity.  BPE then merges the adjacent
pair of the lowest rank first, leftmost first among equals, which is the rule
of the rank file.  Text is split into pre-tokens by the tokenizer's pattern;
each pre-token is encoded by itself and ids are decoded by the inverse mapping.

Results for odd rows: a null text counts as empty and has no ids; an empty text
has no ids and decodes to no bytes; repeated rows give repeated results; texts
are encoded whole, piece by piece, so a long text needs little more memory than
its ids; an empty table gives an empty table.  Input columns that are not named
in ``keys`` are left out, and a key named like an output column is refused."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded.llm.common import as_text, map_batches

RANKS = "byte_bpe_multi_50k.tiktoken"

# Entries, and characters in their keys, that a table of recent words or pre-tokens takes before it becomes the
# older table and a new one starts.
RECENT, RECENT_CHARS = 100_000, 3_000_000
# Characters that are split into pre-tokens at a time.
SPAN = 1 << 20


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; the ranks of the file must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must be contiguous from 0")
    return [tokens[i] for i in range(len(tokens))]


_CHARS = [chr(0x100 + b) for b in range(256)]


def mapped(data: bytes) -> str:
    """Bytes as characters U+0100 to U+01FF, one each, none of them white space."""
    return "".join(map(_CHARS.__getitem__, data))


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece model of the vocabulary: ids are ranks, the unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece=mapped(token), score=-float(rank))
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    model.trainer_spec.model_type = pb.TrainerSpec.BPE
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


class Recent:
    """Values of recently used keys in two generations; the older one is dropped when the newer is full."""

    def __init__(self):
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def lacking(self, keys: set[str]) -> list[str]:
        """The keys that neither generation has; those of the older move to the newer."""
        if len(self.new) >= RECENT or self.chars >= RECENT_CHARS:
            self.old, self.new, self.chars = self.new, {}, 0
        added = keys.difference(self.new)
        self.chars += sum(map(len, added))
        moved = {k: self.old[k] for k in added.intersection(self.old)}
        self.new.update(moved)
        return list(added.difference(moved))


class Encoder:
    """Text to ids (little-endian unsigned 32-bit integers) and back."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex
        import sentencepiece
        self.tokens = tokens
        self.whole = {token: rank for rank, token in enumerate(tokens)}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(tokens))
        self.pattern = regex.compile(pattern)
        self.pretokens, self.words = Recent(), Recent()

    def _learn_pretokens(self, tokens: set[str]) -> None:
        """Ids of pre-tokens: a token of the vocabulary is itself, all others are merged by the model."""
        lacking = [(t, t.encode()) for t in self.pretokens.lacking(tokens)]
        known, whole = self.pretokens.new, self.whole
        merge = [x for x in lacking if x[1] not in whole]
        known.update((t, struct.pack("<I", whole[data])) for t, data in lacking if data in whole)
        if merge:
            # 0xFF occurs in no UTF-8 text, so its character parts the mapped pre-tokens.
            joined = np.frombuffer(b"\xff".join([data for _, data in merge]), np.uint8).astype("<u4") + 0x100
            pieces = joined.tobytes().decode("utf-32-le").split(chr(0x1FF))
            ids = self.pieces.encode(pieces, out_type=int, num_threads=1)
            known.update(zip([t for t, _ in merge], [struct.pack(f"<{len(x)}I", *x) for x in ids]))

    def _learn_words(self, words: set[str]) -> None:
        """Ids of words that follow a blank each."""
        find = self.pattern.findall
        split = {w: find(" " + w) for w in self.words.lacking(words)}
        self._learn_pretokens(set().union(*split.values()))
        ids, known = self.pretokens.new.__getitem__, self.words.new
        for w, tokens in split.items():
            known[w] = b"".join(map(ids, tokens))

    @staticmethod
    def plain_spaces(text: str) -> bool:
        """Whether each piece of white space is one blank or line feed, with none at either end.

        Only then is every blank between two other characters, where a pre-token always starts.  Every other
        white space is unprintable, so a text of printable characters has as many blanks as gaps between words."""
        flat = text.replace("\n", " ")
        return flat.isprintable() and flat.count(" ") == len(flat.split()) - 1

    def spans(self, text: str) -> Iterator[str]:
        """The text in parts that end before a blank between two letters, where no pre-token crosses."""
        at = 0
        while len(text) - at > SPAN:
            cut = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])").search(text, at + SPAN)
            if not cut:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; words and pre-tokens that are new are encoded together for all texts."""
        out, group, size = [], [], 0
        for text in texts:
            parts = list(self.spans(text))
            group.append(parts)
            size += len(text)
            if size >= SPAN:
                out += self._encode(group)
                group, size = [], 0
        return out + self._encode(group)

    def _encode(self, texts: list[list[str]]) -> list[bytes]:
        split = []
        for parts in texts:
            for k, part in enumerate(parts):
                lead = " " if k else ""
                if self.plain_spaces(part[len(lead):]):
                    first, *rest = part[len(lead):].split(" ")
                    split.append((self.pattern.findall(lead + first), rest))
                else:
                    split.append((self.pattern.findall(part), []))
        self._learn_words(set().union(*(words for _, words in split)))
        self._learn_pretokens(set().union(*(tokens for tokens, _ in split)))
        token, word = self.pretokens.new.__getitem__, self.words.new.__getitem__
        ids = iter([b"".join(map(token, tokens)) + b"".join(map(word, words)) for tokens, words in split])
        return [b"".join([next(ids) for _ in parts]) for parts in texts]


def decoded(tokens: list[bytes], ids: bytes) -> bytes:
    """The bytes of ids (little-endian unsigned 32-bit integers)."""
    return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(ranks: str, pattern: str) -> Encoder:
    """The encoder of a rank file, made once per Python process."""
    if (ranks, pattern) not in _LOADED:
        _LOADED[ranks, pattern] = Encoder(load_ranks(ranks), pattern)
    return _LOADED[ranks, pattern]


def _apply(df: DataFrame, keys: list[str], source: str, targets: list[str], make: Callable) -> DataFrame:
    if set(targets) & set(keys):
        raise ValueError(f"a key column is named like a result: {targets}")
    rows = df.select(*keys, F.col(source).alias("__in"))
    schema = T.StructType([*(f for f in rows.schema if f.name != "__in"), *(T.StructField(t, T.BinaryType()) for t in targets)])

    def start():
        fn = make()
        return lambda b: [*b.columns[:-1], *fn(b.columns[-1].to_pylist())]

    return map_batches(rows, start, schema)


def encode(df: DataFrame, keys: list[str], text: str = "text", ids: str = "ids", ranks: str | None = None,
           pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``keys`` and ``ids``: the ids of the whole text as little-endian unsigned 32-bit integers."""
    path = ranks or public_tokenizers.path(RANKS)

    def make():
        e = encoder(path, pattern)
        return lambda texts: [e.encode([as_text(x) for x in texts])]

    return _apply(df, keys, text, [ids], make)


def decode(df: DataFrame, keys: list[str], ids: str = "ids", data: str = "decoded", ranks: str | None = None) -> DataFrame:
    """``keys`` and ``data``: the bytes that the ids stand for (null ids: no bytes)."""
    path = ranks or public_tokenizers.path(RANKS)

    def make():
        tokens = load_ranks(path)
        return lambda column: [[decoded(tokens, x or b"") for x in column]]

    return _apply(df, keys, ids, [data], make)


def round_trip(df: DataFrame, keys: list[str], text: str = "text", ids: str = "ids", data: str = "decoded",
               ranks: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``keys``, ``ids`` and the bytes decoded from these ids, by one Python worker a task instead of two."""
    path = ranks or public_tokenizers.path(RANKS)

    def make():
        e = encoder(path, pattern)

        def fn(texts):
            found = e.encode([as_text(x) for x in texts])
            return found, [decoded(e.tokens, x) for x in found]
        return fn

    return _apply(df, keys, text, [ids, data], make)


def digests(documents: DataFrame, keys: list[str]) -> DataFrame:
    """Encodes, decodes the ids and reports both sides' SHA-256 with the number of tokens."""
    return round_trip(documents, keys).select(
        *keys, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
