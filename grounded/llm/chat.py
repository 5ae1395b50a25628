"""Operator 6: chat formatting with loss masks aligned by offsets.

A conversation is rendered as one string.  Control strings mark the turns:

    <s>[SYS]system text[/SYS][INST]user text[/INST]assistant text</s><s>[ROLE]other[/ROLE]text</s>

The rendered string is encoded once, with offsets; the control strings are
special tokens, so no token crosses the edge of a turn.  The spans of assistant
texts and the spans of tokens are both sorted, and binary search finds the
tokens inside each span: these are under the loss mask.

A control string inside a text or role is escaped by a backslash after its first
character; one that already has backslashes there gets one more, so unescaping
gives every text back exactly.

A conversation of any length is handled in parts of at most ``TURNS`` rows and
about ``CHARS`` characters (a longer text is a part of its own).  Rows are dealt
to the tasks by ranges of their order, so one conversation, however many rows
it has and whatever their turns, is shared by several tasks.  Parts are rendered, encoded and masked independently (no token crosses
turns, so the parts' ids are those of the whole); only the digests of a whole
conversation are taken in order, from a sorted stream of its parts, one part in
memory at a time.

Results for odd rows: null texts and roles are empty; an empty assistant text
has no token under the mask; rows are in the order of turn (null first), then
role, then text, so repeated turns stay, each as a turn; rows with a null
conv_id form one conversation of their own; other columns are not read; an
empty table has no conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import as_text, batch_of, map_partitions

# The template: control strings, and the pair around each role's text.
CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
BEFORE = {"system": "<s>[SYS]", "user": "<s>[INST]", "assistant": "<s>"}
AFTER = {"system": "[/SYS]</s>", "user": "[/INST]</s>", "assistant": "</s>"}
TRAINED = "assistant"

VOCABULARY = "byte_bpe_50k.json"
# Rows and characters of one part of a conversation.
TURNS, CHARS = 64, 1 << 20

_ESCAPE = re.compile(r"(<|\[)(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\])")
_UNESCAPE = re.compile(r"(<|\[)\\(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\])")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROLS))

FORMATTED = ("conv_id long, part long, formatted string, input_ids array<int>, loss_starts array<int>, "
             "loss_ends array<int>, n_loss_tokens int")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendered turns and the sorted spans of the texts that are trained on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        before = BEFORE.get(role, f"<s>[ROLE]{escape(role)}[/ROLE]")
        after = AFTER.get(role, "</s>")
        if role == TRAINED:
            spans.append((at + len(before), at + len(before) + len(body)))
        out += [before, body, after]
        at += len(before) + len(body) + len(after)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from a rendered string."""
    turns = []
    at = 0
    while at < len(formatted):
        marks, texts = [], []
        while True:
            m = _CONTROL.search(formatted, at)
            if m is None:
                raise ValueError("a turn without an end")
            texts.append(formatted[at:m.start()])
            marks.append(m.group())
            at = m.end()
            if m.group() == "</s>":
                break
        if marks[1] == "[ROLE]":
            turns.append((unescape(texts[2]), unescape(texts[3])))
        else:
            role = {"[SYS]": "system", "[INST]": "user", "</s>": "assistant"}[marks[1]]
            turns.append((role, unescape(texts[1] if role == "assistant" else texts[2])))
    return turns


def load_tokenizer(path: str):
    from tokenizers import AddedToken, Tokenizer, processors
    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROLS])
    t.post_processor = processors.ByteLevel(trim_offsets=False)      # offsets keep leading blanks
    t.no_truncation()
    return t


def loss_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Per span, the range of tokens inside it; all three inputs are sorted."""
    found = []
    for start, end in spans:
        first = int(np.searchsorted(starts, start, "left"))
        last = int(np.searchsorted(ends, end, "right"))
        if start < end and first < last:
            found.append((first, last))
    return found


def format_part(tokenizer, turns: list[tuple[str, str]]) -> tuple:
    """Rendered text, ids, and the character spans that the masked tokens cover, one per trained turn."""
    text, spans = render(turns)
    encoding = tokenizer.encode(text, add_special_tokens=False)
    offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
    ranges = loss_tokens(offsets[:, 0], offsets[:, 1], spans)
    return (text, encoding.ids, [int(offsets[a:b, 0].min()) for a, b in ranges],
            [int(offsets[a:b, 1].max()) for a, b in ranges], sum(b - a for a, b in ranges))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text", vocabulary: str | None = None, turns: int = TURNS) -> DataFrame:
    """One row per part of a conversation: rendered text, ids and the spans under the loss mask.

    ``part`` numbers ascend in the order of the rows: the range of the row, then the part inside the range."""
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "tie"]
    # Equal rows are interchangeable: the tie only deals them to several tasks.
    ordered = (rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                           F.coalesce(F.col(role), F.lit("")).alias("role"),
                           F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
               .repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text"))

    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(path)

        def rows_of(done):
            return batch_of([(*key, *format_part(tokenizer, part)) for key, part in done], out)

        first = TaskContext.get().partitionId() << 40
        done, conv, part, chars, size, n = [], None, [], 0, 0, 0
        for batch in batches:
            for own, who, said in zip(*(c.to_pylist() for c in batch.columns)):
                length = len(who) + len(said) + 16
                if part and (own != conv or len(part) >= turns or chars + length > CHARS):
                    done.append(((conv, first + n), part))
                    part, size, chars, n = [], size + chars, 0, n + 1
                    if size > 1 << 20:
                        yield rows_of(done)
                        done, size = [], 0
                conv = own
                part.append((who, said))
                chars += length
        if part:
            done.append(((conv, first + n), part))
        if done:
            yield rows_of(done)

    return map_partitions(ordered, run, FORMATTED)


DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


class _Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.formatted = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        self.formatted += len(formatted)
        for role, text in parse(formatted):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for a, b in zip(starts, ends):
            text = unescape(formatted[a:b])
            self.chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv_id) -> tuple:
        return conv_id, self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.formatted


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, what is read back from its parts, in order, one part in memory at a time."""
    ordered = (formatted.select("conv_id", "part", "formatted", "loss_starts", "loss_ends")
               .repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").asc_nulls_first()))

    def run(batches, out):
        key, running = None, None
        for batch in batches:
            found = []
            for conv, _, text, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if running is None or conv != key:
                    if running is not None:
                        found.append(running.row(key))
                    key, running = conv, _Digest()
                running.add(as_text(text), starts, ends)
            yield batch_of(found, out)
        if running is not None:
            yield batch_of([running.row(key)], out)

    return map_partitions(ordered, run, DIGESTS)
