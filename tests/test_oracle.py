"""Every registered query with oracle SQL equals DuckDB at sf0.01 (the driver's gate)."""

import hashlib
import math

import pytest

import __spark_entry__ as E

from conftest import SF_ORACLE

SKIP_SLOW: set[str] = set()      # every query with oracle SQL is checked


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], len(lines), hashlib.md5("\n".join(lines).encode()).hexdigest()


def test_registry_complete():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert "grounded_answer" in qs and len(qs) >= 40


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if n not in SKIP_SLOW))
def test_query_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_ORACLE)
    got = _digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(E.oracle_sql()[name])
    exp = _digest([d[0] for d in cur.description], cur.fetchall())
    assert got == exp


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 40 and "status" in df.columns
