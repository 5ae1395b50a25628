"""Operator 4: language identification with error-correcting output codes.

Each language has a codeword of +1 and -1; for every bit a binary classifier
over character n-grams tells the languages of its +1 side from the others.
Decoding takes the codeword with the least loss over all bits, bits weighted by
how well their classifier does on the training sample.  Codes are exhaustive
for few languages and random with wide distances for many.

Learning takes about ``per_language`` rows of each language, chosen by a hash
of the id (the documented bound); n-gram counts are summed in the cluster, and
only a table of ``BINS`` counts per language and the margins of the sample
reach the driver.  Prediction reads every whole text in windows of ``WINDOW``
characters.

Results for odd rows: a null text, an empty one, or one without any letter gets
``und`` with score 0; so does every text if no labelled row exists; rows with a
null language are not learned from; repeated rows count as often as they stand;
with a single learned language that is the prediction for every text with a
letter.  Only the named columns are read, so others cannot clash."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import as_text, has_letter, hashed_share, map_batches, with_fields

UNKNOWN = "und"
# Hashed n-grams: bigrams in the lower half of the bins, trigrams in the upper half.
HALF = 1 << 15
BINS = 2 * HALF
WINDOW = 1 << 18
# Rows learned from, per language.
PER_LANGUAGE = 1500
# A prediction is ambiguous if the second codeword comes closer than this share of the two nearest scores.
AMBIGUOUS = 0.6


def _letter_table() -> np.ndarray:
    """Code point to the code point of its lower-case letter; 0 for all that is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in itertools.chain(range(0xD800), range(0xE000, 0x30000)):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Bins of all bigrams and trigrams of letters, window by window over the whole text."""
    if not _TABLE:
        _TABLE.append(_letter_table())
    table = _TABLE[0]
    for at in range(0, max(1, len(text)), WINDOW):
        part = text[max(0, at - 2):at + WINDOW]          # a window repeats two characters of the one before
        c = table[np.frombuffer((" " + part + " ").encode("utf-32-le", "surrogatepass"), "<u4")]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 0) | (c[:-1] != 0)          # runs of other characters become one gap
        c = c[keep]
        two = (c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B))
        three = (two[:-1] * np.uint32(0xC2B2AE35) ^ c[2:] * np.uint32(0x27D4EB2F))[c[1:-1] != 0]
        yield np.concatenate([two >> np.uint32(17), (three >> np.uint32(17)) + np.uint32(HALF)])


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Occupied bins and their counts."""
    total = sum(np.bincount(bins, minlength=BINS) for bins in ngrams(text))
    bins = np.flatnonzero(total)
    return bins, total[bins]


def codewords(n: int) -> np.ndarray:
    """``n`` rows of +1 and -1: all splits for up to six languages, else the best of several random codes."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 6:
        columns = range(1, 1 << (n - 1))       # the first language is always on the +1 side
        return np.array([[1 if i == 0 or not (b >> (i - 1)) & 1 else -1 for b in columns] for i in range(n)], np.int8)
    bits, rng, best, found = int(np.ceil(10 * np.log2(n))), np.random.default_rng(5), -1, None
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]           # a bit that tells nothing apart is left out
        distance = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        if distance > best:
            best, found = distance, code
    return found


@dataclass
class LanguageModel:
    """Linear n-gram classifiers (bins x bits), their scale and offset, bit weights and the code."""
    languages: list[str]
    code: np.ndarray
    table: np.ndarray
    scale: np.ndarray
    offset: np.ndarray
    weight: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.table.shape[1]), 0
        for bins in ngrams(text):
            total += self.table[bins].sum(0)
            n += len(bins)
        return total / max(1, n)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, score from 0 to 1 and whether the runner-up is near."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        z = self.margins(text) * self.scale + self.offset
        loss = (np.logaddexp(0.0, -self.code * z) * self.weight).sum(1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.languages[first], float(p[first]), bool(p[first] < AMBIGUOUS * (p[first] + p[second]))


def _sample(labelled: DataFrame, key: str, per_language: int) -> DataFrame:
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & hashed_share(min(1.0, per_language / n), key, "lang", "_row"))
    # Rows are chosen one by one, by their place too: an id or a text that many rows share is neither all in nor all out.
    return labelled.withColumn("_row", F.monotonically_increasing_id()).where(chosen).drop("_row")


def fit(labelled: DataFrame, key: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learns from rows ``key``, ``text``, ``lang``; rows with a null language are left out."""
    labelled = labelled.select(key, "text", "lang").where(F.col("lang").isNotNull())
    sample = _sample(labelled, key, per_language).where(F.col("text").isNotNull())

    def count():
        def fn(batch):
            found = [ngram_counts(as_text(t)) for t in batch.column(0).to_pylist()]
            langs = batch.column(1).to_pylist()
            return [langs, [b.astype("<i4").tobytes() for b, _ in found],
                    [c.astype("<i4").tobytes() for _, c in found]]
        return fn

    # One row of n-gram counts per sampled text: about per_language x languages rows, the documented bound.
    rows = map_batches(sample.select("text", "lang"), count, "lang string, bins binary, counts binary").collect()
    rows = [(r["lang"], np.frombuffer(r["bins"], "<i4"), np.frombuffer(r["counts"], "<i4"))
            for r in sorted(rows, key=lambda r: (r["lang"], bytes(r["bins"]), bytes(r["counts"])))]
    languages = sorted({r[0] for r in rows})
    code = codewords(len(languages))
    bits = code.shape[1]
    if not bits:
        return LanguageModel(languages, code, np.zeros((BINS, 0)), *(np.zeros(0),) * 3)
    totals = {lang: np.zeros(BINS) for lang in languages}
    for lang, bins, counts in rows:
        totals[lang][bins] += counts
    share = np.stack([(totals[lang] + 0.5) / (totals[lang].sum() + 0.5 * BINS) for lang in languages])
    table = np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0))
                      for b in range(bits)], axis=1)
    margins = np.stack([counts @ table[bins] / max(1, counts.sum()) for _, bins, counts in rows])
    index = {lang: i for i, lang in enumerate(languages)}
    sides = code[[index[lang] for lang, _, _ in rows]]
    scale, offset, weight = np.ones(bits), np.zeros(bits), np.ones(bits)
    for b in range(bits):
        scale[b], offset[b] = _calibrate(margins[:, b], sides[:, b] > 0)
        right = ((margins[:, b] * scale[b] + offset[b] > 0) == (sides[:, b] > 0)).mean()
        weight[b] = max(0.05, 2 * right - 1)
    return LanguageModel(languages, code, table, scale, offset, weight / weight.mean())


def _calibrate(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Scale and offset of a logistic curve through the margins (Newton steps, lightly held back)."""
    x = np.stack([margin, np.ones_like(margin)], 1)
    y, w, hold = positive.astype(float), np.array([4.0, 0.0]), np.diag([1e-2, 1e-2])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
        w = w + np.clip(step, -5, 5)
    return float(max(w[0], 0.1)), float(w[1])


def identify(documents: DataFrame, model: LanguageModel, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``lang_pred``, ``score`` and ``ambiguous`` for every row, from the whole text alone."""
    rows = documents.select(*keys, F.col(text).alias("__in"))
    shared = documents.sparkSession.sparkContext.broadcast(model)      # BINS x bits numbers

    def start():
        m = shared.value

        def fn(batch):
            found = [m.predict(as_text(t)) for t in batch.columns[-1].to_pylist()]
            return [*batch.columns[:-1], *([f[i] for f in found] for i in range(3))]
        return fn

    return map_batches(rows, start, with_fields(rows.drop("__in"), "lang_pred string, score double, ambiguous boolean"))

