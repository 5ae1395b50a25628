"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grounded import session
from grounded.session import scratch_dir, ship_package
from grounded.sources.tables import read_table

# Rows that a Python function sees at once; Spark hands a Python worker ``session.ROWS_A_BATCH`` at once.
ROWS_AT_ONCE = 256


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, table, list(columns) or None)


def as_schema(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)


def with_fields(df: DataFrame, schema: str) -> T.StructType:
    """The columns of ``df`` and those of ``schema``."""
    return T.StructType([*df.schema.fields, *as_schema(schema).fields])


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str | T.StructType,
                rows: int = ROWS_AT_ONCE) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows.

    ``make()`` runs once per task (it loads models) and returns a function from
    a record batch to the columns of ``schema``, as lists or Arrow arrays."""
    def run(batches: Iterable[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                cols = fn(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, out)], schema=out)

    return map_partitions(df, run, schema)


def map_partitions(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` of ``run(batches, out)``, where ``out`` is the Arrow schema of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    small_batches(df.sparkSession)
    struct = as_schema(schema)
    out = to_arrow_schema(struct)
    return df.mapInArrow(lambda batches: run(batches, out), struct)


def small_batches(spark: SparkSession) -> None:
    """Executors can import the package, and Arrow batches hold few rows: texts may be long."""
    ship_package(spark)
    session.small_batches(spark)


def batch_of(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(out)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)


def keep_rows(df: DataFrame, text: str, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows, all columns, whose text passes the test that ``make()`` returns in each task."""
    small_batches(df.sparkSession)
    at = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(k, ROWS_AT_ONCE)
                yield part.filter(pa.array([test(t) for t in part.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of equal leading ``keys`` columns from batches sorted by them.

    Only for groups that are small by construction: one group is in memory."""
    key, group = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if group:
                    yield key, group
                key, group = row[:keys], []
            group.append(row[keys:])
    if group:
        yield key, group


def checkpointed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder (``spark.checkpoint.dir``) and read again."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_text(value: str | None) -> str:
    return value or ""


_WORDISH = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether any character is a letter (Unicode category L)."""
    return any(m.group().isalpha() for m in _WORDISH.finditer(text))


def crc_bucket(column: str, buckets: int) -> Column:
    """``crc32`` of the column as text, modulo ``buckets``: the fold of a row (null ids: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(buckets))


def hashed_share(share: float, *columns: str) -> Column:
    """Keeps about ``share`` of the rows, always the same ones, by a hash of ``columns``."""
    return F.pmod(F.xxhash64(*columns, F.lit(17)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000))
