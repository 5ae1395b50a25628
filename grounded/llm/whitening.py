"""Operator 13: whitening of embeddings by incremental eigendecomposition.

Entries become integers, ``floor(256 * c)``.  The model is fitted on every distinct vector once.  Each partition of
them keeps the eigenpairs of its scatter matrix under centred rank-one updates; the partitions' spectra are combined
``FAN_IN`` at a time, in rounds of tasks, by successive rank-one updates.  The combined eigenvectors are the basis of
one distributed Rayleigh-Ritz step: all vectors are projected on the basis, the tasks' products are summed and the small
matrix's eigenpairs give the components to double precision.  A last pass measures how far the
covariance of the whitened vectors is from the identity.

A task holds one spectrum, the driver one of at most ``dimension ** 2`` numbers; neither grows with the rows.  A rank-one
update costs ``dimension ** 3`` operations.

Results for odd rows: vectors that are null or hold a null or non-finite entry have no row in the result; integers are
limited to 2^31 in size (entries of eight million); vectors shorter than the longest count as ending in zeros; repeated rows
count once in the fit and are all in the result; a component without variance (fewer distinct vectors than components, say) has a null
``whitened`` and takes no part in ``identity_error``, which is null without any; ``explained`` is null where no component has
variance; a deviation beyond the range of long is null; an empty table gives no row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import checkpointed, map_partitions
from grounded.llm.eigen import EPS, Spectrum
from grounded.sources.tables import spread

SCALE, LARGEST = 256, 2 ** 31
COMPONENTS = 4
# Spectra that one task combines.
FAN_IN = 8

_SPECTRUM = "part long, n long, total array<long>, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"


@dataclass(frozen=True)
class Model:
    n: int
    total: tuple[int, ...]
    components: np.ndarray          # dimension x at most COMPONENTS
    eigenvalues: np.ndarray         # of the components, falling
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.total])

    @property
    def varied(self) -> np.ndarray:
        """Which components have variance beyond rounding."""
        return self.eigenvalues > 64 * EPS * len(self.total) * self.trace

    def whiten(self, x: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.where(self.varied, self.eigenvalues, np.nan))
        return (x - self.mean) @ self.components / scale


def quantised(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``(id, x)`` of the rows whose vector has only finite entries."""
    v = F.col(vector)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    limited = lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
    return (rows.where(v.isNotNull() & ~F.exists(v, bad))
            .select(F.col(key).alias("id"), F.transform(v, lambda c: F.floor(limited(c)).cast("long")).alias("x")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    """Integer rows of an Arrow list column; short ones end in zeros."""
    if len(column) and pa.compute.all(pa.compute.equal(pa.compute.list_value_length(column), size)).as_py():
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
    out = np.zeros((len(column), size), np.int64)
    for row, x in zip(out, column.to_pylist()):
        row[:len(x)] = x
    return out


def _row(part: int, s: Spectrum) -> list:
    return [part, s.n, s.total, s.mean, s.values, s.vectors.ravel()]


def _spectra(vectors: DataFrame, size: int) -> DataFrame:
    """One spectrum per partition of the distinct vectors."""
    def run(batches, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        own = Spectrum(size)
        for batch in batches:
            for x in _matrix(batch.column(0), size):
                own.add(x)
        if own.n:
            row = _row(TaskContext.get().partitionId(), own)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, out)], schema=out)

    return map_partitions(vectors, run, _SPECTRUM)


def _combined(spectra: DataFrame, size: int) -> Spectrum | None:
    """Rounds of tasks that merge ``FAN_IN`` spectra each, until one is left."""
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for r in rows.sort_values("part").itertuples():
            s = _read(r, size)
            if whole is None:
                whole = s
            else:
                whole.merge(s)
        return pd.DataFrame([_row(int(rows["part"].min()) // FAN_IN, whole)], columns=list(rows.columns))

    while True:
        spectra = checkpointed(spectra, "whitening-spectra")
        most = spectra.agg(F.max("part")).first()[0]
        if most is None:
            return None
        if most == 0:
            return _read(spectra.first(), size)
        spectra = spectra.groupBy(F.expr(f"part div {FAN_IN}").alias("of")).applyInPandas(merge, _SPECTRUM)


def _read(r, size: int) -> Spectrum:
    s = Spectrum(size)
    s.n, s.total = int(r.n), np.array(r.total, np.int64)
    s.mean, s.values = np.array(r.mean), np.array(r.eigenvalues)
    s.vectors = np.array(r.eigenvectors).reshape(size, size)
    return s


def _products(vectors: DataFrame, project, size: int, width: int) -> np.ndarray:
    """The sum of y' y over all vectors, where ``project`` gives y: products of tasks, summed cell by cell."""
    def run(batches, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            y = project(_matrix(batch.column(0), size))
            total += y.T @ y
        at = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(at[0] * width + at[1], pa.int32()), pa.array(total[at])], schema=out)

    out = np.zeros((width, width))
    for cell, value in map_partitions(vectors, run, "cell int, value double").groupBy("cell").agg(F.sum("value")).collect():
        out[cell // width, cell % width] = out[cell % width, cell // width] = value
    return out


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The components of the distinct ``x`` of rows ``(id, x)``; None without any."""
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if not size:
        return None
    ended = F.concat("x", F.array_repeat(F.lit(0).cast("long"), size - F.size("x")))
    vectors = spread(checkpointed(rows.select(ended.alias("x")).distinct(), "whitening-vectors"))
    whole = _combined(_spectra(vectors, size), size)
    n, total = whole.n, tuple(int(s) for s in whole.total)
    mean = np.array([s / n for s in total])
    basis = np.linalg.qr(whole.vectors)[0]
    values, turned = np.linalg.eigh(_products(vectors, lambda x: (x - mean) @ basis, size, size) / n)
    best = np.argsort(-values, kind="stable")[:components]
    model = Model(n, total, basis @ turned[:, best], np.maximum(values[best], 0.0), float(np.maximum(values, 0).sum()))
    known = np.flatnonzero(model.varied)
    if not len(known):
        return model
    found = _products(vectors, lambda x: model.whiten(x)[:, known], size, len(known)) / n
    return Model(model.n, model.total, model.components, model.eigenvalues, model.trace, float(np.abs(found - np.eye(len(known))).max()))


def deviations(x: np.ndarray, n: int, total: tuple[int, ...]) -> list[int | None]:
    """The sum of (n x - total)^2 of each row, exactly; None beyond the range of long."""
    most = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, total))
    if len(total) * most ** 2 < 2 ** 63:
        return list(((n * x - np.array(total, np.int64)) ** 2).sum(axis=1))
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, total)) for row in x]
    return [v if v < 2 ** 63 else None for v in exact]


def whiten(rows: DataFrame, model: Model | None) -> DataFrame:
    """A row for each of the rows ``(id, x)`` and each component of the model."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    size, k = len(model.total), len(model.eigenvalues)
    explained = [e / model.trace if model.trace > 0 else None for e in model.eigenvalues]

    def run(batches, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column(1), size), batch.num_rows
            white = model.whiten(x).ravel()
            columns = [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                       pa.array([model.n] * (m * k), pa.int64()), pa.array([v for v in deviations(x, model.n, model.total) for _ in range(k)], pa.int64()),
                       pa.array(white, mask=np.isnan(white)), pa.array(explained * m, pa.float64()), pa.array([model.identity_error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_partitions(rows, run, schema)
