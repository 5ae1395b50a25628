"""Payload filters (O19): trees of conditions compiled to one Column, which Catalyst pushes to the scan.

A clause is a dictionary with any of ``must`` (all hold), ``should`` (at least one holds) and ``must_not`` (none
holds), each a list of clauses or conditions; all given parts have to hold, and an empty clause holds for every row.  A condition
names a payload column by ``key`` and tests it with one of

* ``match``: equal to the value,
* ``any`` / ``except``: one of the values, or none of them,
* ``range``: bounds ``gt``, ``gte``, ``lt``, ``lte``, all given ones,
* ``is_null``: true or false.

A condition on a null value is false (``is_null`` apart), so ``must_not`` of it holds: the result is never null."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDS = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_PARTS, _TESTS = ("must", "should", "must_not"), ("match", "any", "except", "range", "is_null")


def _all(columns: list[Column]) -> Column:
    return functools.reduce(operator.and_, columns, F.lit(True))


def _any(columns: list[Column]) -> Column:
    return functools.reduce(operator.or_, columns, F.lit(False))


def _condition(c: dict, columns: list[str]) -> Column:
    tests = [t for t in _TESTS if t in c]
    if len(tests) != 1 or set(c) - {"key", tests[0]}:
        raise ValueError(f"a condition has a key and one of {', '.join(_TESTS)}: {c!r}")
    if c["key"] not in columns:
        raise ValueError(f"no payload column {c['key']!r}")
    value, test = F.col(c["key"]), c[tests[0]]
    if tests[0] == "is_null":
        return value.isNull() if test else value.isNotNull()
    if tests[0] == "match":
        found = value == F.lit(test)
    elif tests[0] == "range":
        if not test or set(test) - set(_BOUNDS):
            raise ValueError(f"a range has bounds of {', '.join(_BOUNDS)}: {test!r}")
        found = _all([_BOUNDS[b](value, F.lit(v)) for b, v in test.items()])
    else:
        found = value.isin(list(test)) if test else F.lit(False)
        if tests[0] == "except":
            found = value.isNotNull() & ~found
    return F.coalesce(found, F.lit(False))


def compiled(tree: dict, columns: list[str]) -> Column:
    """The Column of a filter tree over a table with these ``columns``; wrong keys and tests raise before any job runs."""
    if "key" in tree:
        return _condition(tree, columns)
    if set(tree) - set(_PARTS):
        raise ValueError(f"a clause has {', '.join(_PARTS)}: {tree!r}")
    of = {p: [compiled(c, columns) for c in tree[p]] for p in _PARTS if tree.get(p)}
    return _all([*of.get("must", []), *([_any(of["should"])] if "should" in of else []), *[~c for c in of.get("must_not", [])]])
