"""The manifest against a tree in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from grounded.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root, and the siblings of every leaf as (left, right) per level."""
    paths, nodes, of = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        ups, ofs = [], []
        for a in range(0, len(nodes), 8):
            run = nodes[a:a + 8]
            for j in range(len(run)):
                for i in of[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            ups.append(h(*run))
            ofs.append([i for x in of[a:a + 8] for i in x])
        nodes, of = ups, ofs
    return nodes[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[g] = tree([leaf(r) for r in groups[g]])
    root, tops = tree([subs[g][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for r, path in zip(groups[g], subs[g][1]):
            path, node = path + tops[k], leaf(r)
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            fold = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))) if bad else node
            for left, right in path:
                fold = h(left, fold, right)
            out.append((r[0], node, subs[g][0], root, h(*(x + y for x, y in path)), fold, fold == root))
    return sorted(out, key=str)


def found(df):
    bad = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.proofs(merkle.manifest(df, "doc_id", "lang", FIELDS, bad, ("text", merkle.lower_ascii(F.col("text")))))
    assert rows.columns == ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("sizes", [[1], [8, 9, 64, 65], [4096, 4097, 1], [5000, 513, 3, 1, 1, 1, 1, 1, 1, 1]])
def test_equals_a_plain_tree(spark, sizes):
    rows, k = [], 0
    for g, n in enumerate(sizes):
        for _ in range(n):
            rows.append(((k * 7919) % 100_003, f"s{k % 3}", None if g == 2 else f"l{g}", k if k % 5 else None, f"Text É {k} Äb" if k % 4 else None))
            k += 1
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_more_groups_than_a_block_and_odd_rows(spark):
    rows = [(i, "a", f"g{i:05d}é" if i % 2 else f"G{i}", 1, "") for i in range(4200)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    rows = [(None, None, None, None, None), (None, "A", "x", 1, "Q"), (3, "A", "x", 1, "Q"), (3, "A", "x", 1, "Q"), (3, "B", "x", 1, "Q"), (-4, "é", "", 2, "Z" * 200_000)]
    assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert found(spark.createDataFrame([], SCHEMA)) == []


def test_equal_ids_that_are_a_third_of_all_rows(spark):
    rows = [(9 if i % 3 == 0 else i, "s", "hot", i % 7, f"T{i % 11}") for i in range(3000)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_clashing_names_and_a_changed_field(spark):
    df = spark.createDataFrame([(i, "s", "l", i, f"Up{i}", i, "g", "p") for i in range(20)], SCHEMA + ", pos long, g string, path string")
    assert found(df) == plain([tuple(r)[:5] for r in df.collect()])
    odd = df.select(F.col("doc_id").alias("pos"), F.col("lang").alias("d"), F.col("text").alias("n"))
    rows = merkle.proofs(merkle.manifest(odd, "pos", "d", ["pos", "n"])).collect()
    assert len(rows) == 20 and all(r.verified for r in rows)
