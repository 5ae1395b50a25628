"""Operator 7: benchmark decontamination by rare n-gram seeds and local alignment.

Test items are cut into word trigrams, with and without a word left out.  One
pass over all documents splits each into words once and writes, for those that hold a trigram of any item, the
words' numbers and the trigrams' places; an aggregate of these rows counts in how many documents
each trigram stands.  An item's seeds are its rare trigrams, where what counts as rare follows the item's own
trigrams, so that an item that leaked everywhere, or one of common words, keeps
seeds too.  Every run of ``RUN`` words of an item is a seed as well, however
common.  A written document that holds a seed is then aligned with the
seed's item by Smith-Waterman on words (match +1, mismatch and gap -1) around
the seed; documents whose best alignment reaches ``THRESHOLD`` of the item's
length, or ``RUN`` words net of edits, hold a copy of it or of a part, edited or
not.  Words of a run that more than ``SHARED`` items have in common (an instruction that stands in many) are
evidence for none of them and not counted, unless an item has hardly any others.

Items of equal text are one item, whose ids are joined to the result.  Items are taken in blocks of bounded size, one
at a time, each of which goes to every task; documents are never shuffled.

Results for odd rows: words are runs of letters, digits and underscores in
lower case; null or empty documents and items match nothing; an item shorter
than ``LEAST`` words must be found whole, and either stand in at most ``RARE``
documents or, from three words on, make up a sentence or line of the document (a
common word or phrase inside running text is no copy); repeated rows are reported each; equal scores end at the
first place; an empty table on either side gives an empty result.  Columns are
taken by name, so others cannot clash."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import as_schema, as_text, checkpointed, map_batches
from grounded.session import broadcast_if_bounded, ship_package

GRAM = 3
# Offsets of the words of a trigram; the second outlives an edit of every third word.
SHAPES = ((0, 1, 2), (0, 1, 3))
# N-grams in at most so many documents are rare; so are those not far above this quantile of their item's n-grams.
RARE, USUAL = 16, 0.85
# Share of an item that a copy holds, net of edits: clean documents of check_s and items of 28 words or more stay below
# 0.2, a copy with a third of its words replaced has about 0.33.  No clean document has ``LEAST`` words of any item.
THRESHOLD = 0.25
LEAST = 7
# So many words net of edits are a copy of a part of an item of any length.
RUN = 13
# Runs that stand in more items than this are evidence for none of them; items keep theirs if fewer than LEAST other words remain.
SHARED = 16
# Characters of items in one block.
BLOCK_CHARS = 8 << 20

_WORD = re.compile(r"\w+")
_HASH = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(as_text(text).lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score and the window position after its end (the first of equals)."""
    row, steps = np.zeros(len(window) + 1, np.int32), np.arange(len(window) + 1, dtype=np.int32)
    best, end = 0, 0
    for gain in np.where(item[:, None] == window[None, :], 1, -1).astype(np.int32):
        new = row - 1
        np.maximum(new[1:], row[:-1] + gain, out=new[1:])
        np.maximum(new, 0, out=new)
        # Gaps along the window: the best of all earlier cells less their distance.
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.max())
        if top > best:
            best, end = top, int(row.argmax())
    return best, end


def needed(length: int, threshold: float) -> float:
    return max(min(threshold * length, RUN), min(length, LEAST))


@dataclass
class Items:
    """A block of test items: word numbers from 1, items as arrays of these, and their sorted n-grams."""
    ids: list
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    grams: np.ndarray
    places: list[list[tuple[int, int]]]          # per n-gram: items it stands in, and where
    runs: dict[int, tuple]                       # per length: sorted hashes of runs, their items, and where
    alone: dict[int, re.Pattern | None]          # short items: what they look like on their own
    common: frozenset[int] = frozenset()         # short items of too many documents

    @classmethod
    def of(cls, rows: list[tuple]) -> "Items":
        vocabulary: dict[str, int] = {}
        ids, items = [], []
        for item_id, text in rows:
            words = words_of(text)
            if words:
                ids.append(item_id)
                items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
        # -1 for words that are no evidence: they match no word of a document and start no n-gram.
        items = _without_shared(items)
        found = defaultdict(list)
        base = len(vocabulary) + 1
        for i, item in enumerate(items):
            if len(item) >= LEAST:
                for shape in SHAPES:
                    own = np.flatnonzero(np.logical_and.reduce([item[k:len(item) - shape[-1] + k] > 0 for k in shape]))
                    for at, gram in zip(own.tolist(), _grams(item, shape, base)[own].tolist()):
                        found[gram].append((i, at))
        order = sorted(found)
        # Short items whole, the others in runs.
        lengths = defaultdict(list)
        for i, item in enumerate(items):
            if len(item) < LEAST or len(item) >= RUN:
                lengths[len(item) if len(item) < LEAST else RUN].append(i)
        runs = {}
        for n, own in lengths.items():
            runs[n] = _sorted_runs(items, own, n)
        words = {n: w for w, n in vocabulary.items()}
        alone = {i: _alone([words[n] for n in item.tolist()]) for i, item in enumerate(items) if len(item) < LEAST}
        return cls(ids, vocabulary, items, np.array(order, np.int64), [sorted(set(found[g])) for g in order], runs, alone)

    def numbers(self, text: str | None) -> np.ndarray:
        """A document's words as numbers; 0 for words of no item."""
        words = words_of(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def hits(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the document where an n-gram of an item starts, and the n-grams' indexes."""
        base = len(self.vocabulary) + 1
        at, index = [], []
        for shape in SHAPES:
            n = len(doc) - shape[-1]
            if n < 1 or not len(self.grams):
                continue
            full = np.flatnonzero(np.logical_and.reduce([doc[k:n + k] > 0 for k in shape]))
            gram = _grams(doc, shape, base)[full]
            k = np.searchsorted(self.grams, gram)
            right = (k < len(self.grams)) & (self.grams[np.minimum(k, len(self.grams) - 1)] == gram)
            at.append(full[right])
            index.append(k[right])
        return (np.concatenate(at), np.concatenate(index)) if at else (np.zeros(0, int), np.zeros(0, int))

    def found_runs(self, doc: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        """Where ``n`` words of the document are a run of an item: position in the document, item, position in it."""
        hashed, of, at = self.runs[n]
        known = np.concatenate(([0], np.cumsum(doc > 0)))
        full = np.flatnonzero(known[n:] - known[:-n] == n) if len(doc) >= n else np.zeros(0, int)
        if not len(full):
            return []
        own = _hashes(doc, full, n)
        low, high = np.searchsorted(hashed, own, "left"), np.searchsorted(hashed, own, "right")
        found = []
        for j in np.flatnonzero(high > low).tolist():
            p = int(full[j])
            for i, q in zip(of[low[j]:high[j]].tolist(), at[low[j]:high[j]].tolist()):
                if np.array_equal(doc[p:p + n], self.items[i][q:q + n]):
                    found.append((p, i, q))
        return found

    def wholes(self, doc: np.ndarray) -> dict[int, int]:
        """Short items that the document holds whole, and where they start first."""
        first: dict[int, int] = {}
        for n in self.runs:
            if n < LEAST:
                for p, i, _ in self.found_runs(doc, n):
                    first.setdefault(i, p)
        return first

    def held(self, text: str | None) -> tuple | None:
        """What a document holds of the items, or None: its words' numbers, the places and indexes of n-grams, and the short
        items with their places, each with whether it stands there on its own."""
        doc = self.numbers(text)
        at, grams = self.hits(doc)
        short = sorted(self.wholes(doc).items())
        if not len(at) and not short:
            return None
        low = as_text(text).lower() if short else ""
        own = [bool(self.alone[i] and self.alone[i].search(low)) for i, _ in short]
        return doc.astype(np.int32).tobytes(), at, grams, [i for i, _ in short], [p for _, p in short], own

    def with_seeds(self, documents_with: np.ndarray) -> "Items":
        """Only n-grams that are rare for their item: in at most ``RARE`` documents, or in no more than four times as
        many as the item's n-gram at the ``USUAL`` quantile.

        So a copy that leaked everywhere keeps its seeds, whichever part of the item it holds, as long as that is
        more than the rest above the quantile; what goes are the few n-grams that are common by themselves, and parts
        below the quantile are found by their runs.  N-grams keep their indexes; those that are no seeds have no places."""
        counts = defaultdict(list)
        for gram, places in enumerate(self.places):
            for i, _ in places:
                counts[i].append(int(documents_with[gram]))
        bound = {i: max(RARE, 4 * np.quantile(n, USUAL)) for i, n in counts.items()}
        kept = [[(i, at) for i, at in places if documents_with[gram] <= bound[i]] for gram, places in enumerate(self.places)]
        common = frozenset(i for i in self.alone if documents_with[len(self.grams) + i] > RARE)
        return replace(self, places=kept, common=common)

    def matches(self, held: tuple, threshold: float) -> list[tuple]:
        """Items of which a document holds a copy: item id, score from 0 to 1, matched length, last word's position."""
        doc, at, grams, short, short_at, own = held
        doc = np.frombuffer(doc, np.int32).astype(np.int64)
        starts = defaultdict(list)
        for p, g in zip(at, grams):
            for i, q in self.places[g]:
                starts[i].append(p - q)
        for p, i, q in self.found_runs(doc, RUN) if RUN in self.runs else ():
            starts[i].append(p - q)
        found = []
        for i, p, alone in zip(short, short_at, own):
            n = len(self.items[i])
            if i not in self.common or alone:
                found.append((self.ids[i], 1.0, n, p + n))
        for i, begins in sorted(starts.items()):
            item, best, end = self.items[i], 0, 0
            length = int(np.count_nonzero(item > 0))
            slack = len(item) // 2 + 4
            begins.sort()
            group = [begins[0], begins[0]]
            windows = [group]
            for b in begins[1:]:
                if b - group[1] <= 2 * slack + len(item):
                    group[1] = b
                else:
                    group = [b, b]
                    windows.append(group)
            for low, high in windows:
                a = max(0, low - slack)
                window = doc[a:high + len(item) + slack]
                if np.count_nonzero(window) >= needed(length, threshold):
                    score, last = align(item, window)
                    if score > best:
                        best, end = score, a + last
            if best >= needed(length, threshold):
                found.append((self.ids[i], best / length, best, end))
        return found


def _sorted_runs(items: list[np.ndarray], own: list[int], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words that are evidence, sorted, with their items and places."""
    hashed, of, at = [], [], []
    for i in own:
        known = np.concatenate(([0], np.cumsum(items[i] > 0)))
        full = np.flatnonzero(known[n:] - known[:-n] == n)
        hashed.append(_hashes(items[i], full, n))
        of.append(np.full(len(full), i))
        at.append(full)
    hashed, of, at = np.concatenate(hashed), np.concatenate(of), np.concatenate(at)
    by = np.argsort(hashed, kind="stable")
    return hashed[by], of[by], at[by]


def _without_shared(items: list[np.ndarray]) -> list[np.ndarray]:
    """The items with -1 for the words of runs that stand in more than ``SHARED`` of them."""
    long = [i for i, item in enumerate(items) if len(item) >= RUN]
    if len(long) <= SHARED:
        return items
    hashed, of, at = _sorted_runs(items, long, RUN)
    first = np.flatnonzero(np.concatenate(([True], hashed[1:] != hashed[:-1])))
    out = list(items)
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(hashed)]):
        if high - low > SHARED and len(np.unique(of[low:high])) > SHARED:
            for i, q in zip(of[low:high].tolist(), at[low:high].tolist()):
                out[i] = out[i].copy() if out[i] is items[i] else out[i]
                out[i][q:q + RUN] = -1
    return [new if np.count_nonzero(new > 0) >= LEAST else old for new, old in zip(out, items)]


def _grams(numbers: np.ndarray, shape: tuple[int, ...], base: int) -> np.ndarray:
    n = len(numbers) - shape[-1]
    out = numbers[:n].copy()
    for k in shape[1:]:
        out = out * base + numbers[k:n + k]
    return out


def _hashes(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` numbers that start at these positions."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * _HASH + numbers[at + k].astype(np.uint64)
    return out


def _alone(words: list[str]) -> re.Pattern | None:
    """What a short item looks like as a sentence or line; no context tells of fewer words than ``GRAM``."""
    if len(words) < GRAM:
        return None
    return re.compile(r"(?:\A|[.!?:;\n\r])\W{0,8}" + r"\W+".join(map(re.escape, words)) + r"[^\w.!?:;\n\r]{0,8}(?:\Z|[.!?:;\n\r])")


def _texts(benchmark: DataFrame, text: str) -> DataFrame:
    """``(item, text)``: every different text once, named by its hash."""
    rows = benchmark.where(F.length(text) > 0).select(F.sha2(F.col(text).cast("binary"), 256).alias("item"), F.col(text).alias("text"))
    return rows.groupBy("item").agg(F.first("text").alias("text"))


def blocks(benchmark: DataFrame, text: str = "text") -> list[Callable[[], Items]]:
    """What loads the items in blocks of about ``BLOCK_CHARS`` characters: different texts, dealt by their hash."""
    rows = _texts(benchmark, text)
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-size // BLOCK_CHARS))
    if n > 1:
        rows = checkpointed(rows, "decontaminate-items")
    number = F.pmod(F.xxhash64("item"), F.lit(n))

    def load(i: int) -> Items:
        return Items.of(sorted((r["item"], r["text"]) for r in rows.where(number == i).collect()))      # one block

    return [partial(load, i) for i in range(n)]


_HELD = "numbers binary, at array<int>, grams array<int>, short array<int>, short_at array<int>, own array<boolean>"


def copies(documents: DataFrame, benchmark: DataFrame, item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``id``, ``item`` (the hash of an item's text), ``score``, ``matched``, ``end`` for documents ``(id, text)``.

    Per block of items one pass over the texts; what it writes, and not the texts, is counted and aligned."""
    spark = documents.sparkSession
    ship_package(spark)
    kind = documents.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item string, score double, matched int, `end` int"
    found = spark.createDataFrame([], as_schema(schema))
    for load in blocks(benchmark, item_text):
        items = load()
        if not items.items:
            continue
        shared = spark.sparkContext.broadcast(items)

        def hold(shared=shared):
            def fn(batch):
                rows = [(d, *h) for d, t in zip(*(c.to_pylist() for c in batch.columns)) if (h := shared.value.held(t))]
                return list(zip(*rows)) if rows else [[]] * 7
            return fn

        held = checkpointed(map_batches(documents.select("id", "text"), hold, f"id {kind}, {_HELD}"), "decontaminate-held")
        of_short = F.transform("short", lambda i: i + len(items.grams))
        counts = (held.select(F.explode(F.concat(F.array_distinct("grams"), of_short)).alias("gram"))
                  .groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect())         # at most the block's n-grams
        documents_with = np.zeros(len(items.grams) + len(items.items), np.int64)
        for r in counts:
            documents_with[r["gram"]] = r["n"]
        shared.unpersist()
        seeds = spark.sparkContext.broadcast(items.with_seeds(documents_with))

        def start(seeds=seeds):
            def fn(batch):
                rows = [(d, *m) for d, *h in zip(*(c.to_pylist() for c in batch.columns)) for m in seeds.value.matches(tuple(h), threshold)]
                return list(zip(*rows)) if rows else [[]] * 5
            return fn

        found = found.unionByName(checkpointed(map_batches(held, start, schema), "decontaminate-copies"))
        seeds.unpersist()
    return found


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item of which it holds a copy: ``doc_id``, ``item_id``, ``score``, ``matched``, ``end``."""
    found = copies(documents.select(F.col(key).alias("id"), F.col(text).alias("text")), benchmark, threshold=threshold)
    named = benchmark.select("item_id", F.sha2(F.col("text").cast("binary"), 256).alias("item"))
    return found.join(named, "item").select(F.col("id").alias("doc_id"), "item_id", "score", "matched", "end")


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``documents`` that hold no copy of an item, all columns: what is found is the texts, by their hash."""
    hashed = F.sha2(F.col(text).cast("binary"), 256)
    rows = documents.select(hashed.alias("id"), F.col(text).alias("text"))
    gone = checkpointed(copies(rows, benchmark, threshold=threshold).select(F.col("id").alias("__leak")).distinct(), "decontaminate-leaks")
    return documents.join(broadcast_if_bounded(gone, gone.count()), hashed == F.col("__leak"), "left_anti")
