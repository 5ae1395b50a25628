"""NumPy helpers that run inside Spark tasks (``mapInPandas``), never on whole tables.

Scores are cosine similarities in float64, rounded to ``digits`` decimals
before thresholding and ranking, ties broken by ascending id: the same total
order the SQL oracle uses.
"""

from __future__ import annotations

import numpy as np


def densify_buckets(bucket_lists, dim: int) -> np.ndarray:
    """Hashed stand-in embedding: counts per bucket, weight ln(1 + count), L2-normalised."""
    n = len(bucket_lists)
    out = np.zeros((n, dim), dtype=np.float64)
    if n == 0:
        return out
    lens = np.fromiter((0 if b is None else len(b) for b in bucket_lists), dtype=np.int64, count=n)
    if lens.sum() == 0:
        return out
    flat = np.concatenate([np.asarray(b, dtype=np.int64) for b in bucket_lists if b is not None and len(b)])
    rows = np.repeat(np.arange(n, dtype=np.int64), lens)
    counts = np.bincount(rows * dim + flat, minlength=n * dim).reshape(n, dim).astype(np.float64)
    w = np.log1p(counts)
    norm = np.sqrt((w * w).sum(axis=1, keepdims=True))
    np.divide(w, norm, out=w, where=norm > 0)
    return w


def common_width(vec_list) -> int:
    """The commonest vector length, the smaller of equally common ones (0 without vectors)."""
    lens = [len(v) for v in vec_list if v is not None and len(v)]
    if not lens:
        return 0
    widths, counts = np.unique(lens, return_counts=True)
    return int(widths[np.argmax(counts)])


def stack_vectors(vec_list, dim: int) -> np.ndarray:
    """List of array-likes -> (n, dim) float64; only rows of another width (or NULL) become NaN rows."""
    n = len(vec_list)
    out = np.full((n, dim), np.nan)
    lens = np.fromiter((-1 if v is None else len(v) for v in vec_list), dtype=np.int64, count=n)
    right = np.flatnonzero(lens == dim) if dim else np.zeros(0, dtype=np.int64)
    if len(right):
        out[right] = np.stack([vec_list[i] for i in right]).astype(np.float64)
    return out


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Row-normalise; zero or invalid rows become NaN so they never score."""
    norm = np.sqrt(np.einsum("ij,ij->i", m, m))
    with np.errstate(invalid="ignore", divide="ignore"):
        out = m / norm[:, None]
    out[~(norm > 0)] = np.nan
    return out


def round_scores(s: np.ndarray, digits: int) -> np.ndarray:
    f = 10.0 ** digits
    return np.floor(s * f + 0.5) / f


def single_margin(dim: int) -> float:
    """How far the single-precision product of two unit vectors can be from the exact one."""
    return (dim + 8) * 2.0 ** -23


class TopK:
    """Running per-question top-k over a stream of candidate batches (bounded memory).

    Ids may be integers or strings; equal scores go to the smaller id.  Candidates below a question's k-th score so far are
    left out at once; the others wait until there are enough of them for a merge."""

    def __init__(self, n_questions: int, k: int):
        self.k = k
        self.scores = np.full((n_questions, k), -np.inf)
        self.ids = None
        self.low = np.full(n_questions, -np.inf)          # no score below it can be among the k best
        self._new, self._n, self._enough = [], 0, max(1 << 15, min(n_questions, 256) * k)

    def push(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates one by one: question, id and score."""
        if len(rows):
            self._new.append((rows, ids, scores))
            self._n += len(rows)
            if self._n >= self._enough:
                self.merge()

    def merge(self) -> None:
        if not self._n:
            return
        rows, ids, scores = (np.concatenate(x) for x in zip(*self._new))
        self._new, self._n = [], 0
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, dtype=ids.dtype)
        elif np.result_type(self.ids, ids) != self.ids.dtype:                     # longer strings
            self.ids = self.ids.astype(np.result_type(self.ids, ids))
        at, own = np.unique(rows, return_inverse=True)
        old = self.scores[at]
        r, slot = np.nonzero(old > -np.inf)
        own = np.concatenate([r, own])
        scores, ids = np.concatenate([old[r, slot], scores]), np.concatenate([self.ids[at[r], slot], ids])
        order = np.lexsort((ids, -scores, own))
        own, scores, ids = own[order], scores[order], ids[order]
        slot = np.arange(len(own)) - np.searchsorted(own, np.arange(len(at)))[own]
        best = slot < self.k
        own, slot = own[best], slot[best]
        self.scores[at[own], slot], self.ids[at[own], slot] = scores[best], ids[best]
        self.low[at] = np.maximum(self.low[at], self.scores[at, -1])

    def add(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Scores of (questions x candidates); ``rows`` names the questions if they are not all of them."""
        if scores.size == 0:
            return
        at = np.arange(len(self.low)) if rows is None else rows
        low = self.low[at]
        if scores.shape[1] > self.k:
            low = np.maximum(low, np.partition(scores, -self.k, axis=1)[:, -self.k])
        r, c = np.nonzero((scores >= low[:, None]) & (scores > -np.inf))          # ties at the k-th score stay
        self.push(at[r], ids[c], scores[r, c])

    def items(self):
        self.merge()
        qi, slot = np.nonzero(np.isfinite(self.scores))
        ids = self.ids[qi, slot] if self.ids is not None else np.zeros(0, dtype=np.int64)
        return qi, ids, self.scores[qi, slot]


def kth_best(rows: np.ndarray, scores: np.ndarray, k: int, n_rows: int) -> np.ndarray:
    """The k-th highest score of every row (``rows`` are from 0 to ``n_rows``); -inf where there are fewer."""
    if scores.dtype == np.float32:           # row and score in one whole number that sorts as both do
        bits = np.ascontiguousarray(scores).view(np.int32).astype(np.int64)
        both = np.sort((rows.astype(np.int64) << 32) + np.where(bits < 0, bits ^ 0x7FFFFFFF, bits) + (1 << 31))
        rows, bits = both >> 32, (both & 0xFFFFFFFF) - (1 << 31)
        scores = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits).astype(np.int32).view(np.float32)
    else:
        order = np.lexsort((scores, rows))
        rows, scores = rows[order], scores[order]
    ends = np.searchsorted(rows, np.arange(n_rows + 1))
    at, out = ends[1:] - k, np.full(n_rows, -np.inf)
    there = at >= ends[:-1]
    out[there] = scores[at[there]]
    return out


# Pairs that are held back before the k best of them bound the others.
_HELD = 1 << 20


def reaching(Q: np.ndarray, V: np.ndarray, margin: float, chunk: int, top: TopK | None = None, rows: np.ndarray | None = None,
             least: float | None = None, own: tuple[np.ndarray, np.ndarray] | None = None):
    """Pairs (row of ``Q``, row of ``V``, their product) whose exact score can be ``least`` or more and, with ``top``, among
    the k best of the question ``rows[row]``.

    The products are those of ``Q @ V.T`` in the arrays' precision; ``margin`` bounds twice their distance from the exact
    scores.  ``own`` lists pairs that are left out.  With ``top`` pairs are held back until all of ``V`` was seen (or there are
    too many of them), so of each question about k are left."""
    lowest, n = np.finfo(Q.dtype).min, len(Q)
    low = np.full(n, lowest if least is None else least - margin)
    held, waiting, enough = [], 0, 0
    for lo in range(0, len(V), chunk):
        S = Q @ V[lo:lo + chunk].T
        width = S.shape[1]
        if own is not None:
            here = (own[1] >= lo) & (own[1] < lo + width)
            S[own[0][here], own[1][here] - lo] = -np.inf
        if top is not None:
            low = np.maximum(low, top.low[rows] - margin)
        hits = S >= low.astype(Q.dtype)[:, None]
        if top is not None and width > top.k and np.count_nonzero(hits) > 8 * top.k * n:
            # the k-th product of a chunk bounds the k-th score
            low = np.maximum(low, np.partition(S, -top.k, axis=1)[:, -top.k].astype(np.float64) - margin)
            hits = S >= low.astype(Q.dtype)[:, None]
        r, c = np.divmod(np.flatnonzero(hits), width)
        if not len(r):
            continue
        if top is None:
            yield r, c + lo, S[r, c]
            continue
        held.append((r, c + lo, S[r, c]))
        waiting += len(r)
        if waiting >= max(enough, 2 * top.k * n):
            r, c, s = (np.concatenate(x) for x in zip(*held))
            low = np.maximum(low, kth_best(r, s, top.k, n) - margin)
            left = s >= low[r]
            held, waiting = [(r[left], c[left], s[left])], int(left.sum())
            enough = 2 * waiting
            if waiting > _HELD:
                yield held[0]
                held, waiting, enough = [], 0, 0
    if held:
        r, c, s = (np.concatenate(x) for x in zip(*held))
        left = s >= np.maximum(low, kth_best(r, s, top.k, n) - margin)[r]
        yield r[left], c[left], s[left]


def same_ids(wanted: np.ndarray, ids: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions with equal ids; ``order`` sorts ``ids``.  A number and a text are never equal."""
    if wanted.dtype.kind != ids.dtype.kind:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    there = ids[order]
    first, last = np.searchsorted(there, wanted, "left"), np.searchsorted(there, wanted, "right")
    n = last - first
    r = np.repeat(np.arange(len(wanted)), n)
    return r, order[np.repeat(first, n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)]
