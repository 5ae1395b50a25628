"""Eigenvalues and eigenvectors of a scatter matrix, kept current under rank-one updates (NumPy, inside tasks)."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
ROUNDS = 60


def _roots(poles: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The roots of 1 + sum z2 / (poles - t), each between neighbouring poles (the last beyond them), all at once.

    Returned as the index of the nearest pole and the distance from it, which keeps the differences to all poles exact.
    Each step takes the zero of a rational function with the two neighbouring poles that has the equation's value and
    slopes; a step that leaves its bracket is replaced by a bisection."""
    k, at = len(poles), np.arange(len(poles))
    width = np.append(np.diff(poles), z2.sum())
    middle = poles + width / 2
    value = 1 + (z2 / (poles - middle[:, None])).sum(axis=1)
    near = np.where((value < 0) & (at < k - 1), at + 1, at)
    gap = poles - poles[near][:, None]
    right = near > at
    low = np.where(right, -width / 2, np.where(value < 0, width / 2, 0.0))
    high = np.where(right, 0.0, np.where(value < 0, width, width / 2))
    t, below = (low + high) / 2, at <= at[:, None]
    last = np.minimum(at + 1, k - 1)
    for _ in range(ROUNDS):
        d = gap - t[:, None]
        part = z2 / d
        slope = part / d
        left_slope = np.where(below, slope, 0).sum(axis=1)
        right_slope = slope.sum(axis=1) - left_slope
        f = 1 + part.sum(axis=1)
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        done = (np.abs(f) <= 4 * EPS * k * (1 + np.abs(part).sum(axis=1))) | (high - low <= 2 * EPS * np.abs(t))
        if done.all():
            break
        a, b = d[at, at], d[at, last]
        c = f - a * left_slope - b * right_slope
        p, q = (a + b) * f - a * b * (left_slope + right_slope), a * b * f
        root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
        step = np.where(p <= 0, (p - root) / np.where(c == 0, 1, 2 * c), 2 * q / np.where(p + root == 0, 1, p + root))
        c = f[-1] - a[-1] * left_slope[-1]
        step[-1] = a[-1] + left_slope[-1] * a[-1] ** 2 / c if c else 0.0
        new = t + step
        inside = np.isfinite(new) & (new > low) & (new < high)
        t = np.where(done, t, np.where(inside, new, (low + high) / 2))
    return near, t


def update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending eigenvalues and their vectors (columns) of ``vectors diag(values) vectors' + v v'``.

    Deflation: a direction that ``v`` does not touch keeps its pair; of directions with one eigenvalue, a rotation
    leaves ``v`` in a single one.  The rest solve the secular equation; the vectors come from the weights that have
    the computed roots as exact ones, so they are orthogonal however close these lie."""
    z = v @ vectors
    size = max(np.abs(values).max(), z @ z)
    if size == 0:
        return values, vectors
    tiny = 8 * EPS * size
    active = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > tiny)
    if len(active) > 1 and np.diff(values[active]).min() <= tiny:
        values, vectors, z = values.copy(), vectors.copy(), z.copy()
        kept = [active[0]]
        for j in active[1:]:
            i = kept[-1]
            if values[j] - values[i] > tiny:
                kept.append(j)
                continue
            norm = np.hypot(z[i], z[j])
            c, s = z[j] / norm, z[i] / norm
            vectors[:, [i, j]] = vectors[:, [i, j]] @ np.array([[c, s], [-s, c]])
            z[i], z[j] = 0.0, norm
            kept[-1] = j
        active = np.array(kept)
    if not len(active):
        return values, vectors
    poles, own = values[active], z[active]
    near, t = _roots(poles, own * own)
    # roots[i] - poles[j]
    beyond = poles[near][:, None] - poles + t[:, None]
    apart = poles[:, None] - poles
    np.fill_diagonal(apart, 1.0)
    weight = np.sqrt(np.abs(np.prod(beyond / apart, axis=0))) * np.where(own < 0, -1, 1)
    turned = weight[:, None] / -beyond.T
    turned /= np.sqrt((turned * turned).sum(axis=0))
    values, vectors = values.copy(), vectors.copy()
    values[active], vectors[:, active] = poles[near] + t, vectors[:, active] @ turned
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, exact sums, mean and eigenpairs of the scatter matrix (not divided by the count) of the rows seen."""

    def __init__(self, size: int):
        self.n, self.total, self.mean = 0, np.zeros(size, np.int64), np.zeros(size)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def add(self, x: np.ndarray) -> None:
        """One more row of integers: a centred rank-one update."""
        off = x - self.mean
        self.values, self.vectors = update(self.values, self.vectors, off * np.sqrt(self.n / (self.n + 1)))
        self.n, self.total = self.n + 1, self.total + x
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        """The rows of another spectrum too: a rank-one update for each of its pairs, and one for the distance of the means."""
        if not other.n:
            return
        off, n = other.mean - self.mean, self.n + other.n
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = update(self.values, self.vectors, vector * np.sqrt(value))
        self.values, self.vectors = update(self.values, self.vectors, off * np.sqrt(self.n * other.n / n))
        self.mean, self.total, self.n = self.mean + off * (other.n / n), self.total + other.total, n
