"""Registered queries: SQL equality where there is SQL, columns, the pipeline stage by stage, the entry's guard."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grounded.llm import decontaminate, jaccard
from grounded.llm.common import as_text, crc_bucket, has_letter
from grounded.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(rel.columns)
    columns = sorted(got.columns)
    want = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(tuple, got.select(*columns).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name, rows", [("op4_language_id", "documents"), ("op9_toxicity", "documents"), ("op2_byte_bpe", "documents"),
                                        ("op3_jaccard_join", "documents"), ("op5_html_text", "pages"), ("op8_warc", "pages"),
                                        ("op11_merkle_manifest", "documents"), ("op12_bloom_dedup", "documents")])
def test_a_row_for_each_input_row(spark, name, rows):
    got = QUERIES[name](spark, SF)
    key = "doc_id" if rows == "documents" else "page_id"
    table = spark.read.parquet(f"{SF}/{rows}.parquet")
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in table.select(key).collect())


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10 ** 6, None, "en", "s", 0), (10 ** 6 + 1, "123 %%", None, None, 6)], docs.schema)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["language", "toxicity", "near_duplicates", "benchmark", "byte_bpe"]
    a = stage["language"](spark, docs.unionByName(odd), SF)
    assert a.columns == docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(a) == {r.doc_id for r in docs.collect() if has_letter(as_text(r.text))}
    b = stage["toxicity"](spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(crc_bucket("doc_id", 5) == 0)
    toxic, clean = ({r.doc_id for r in labels.where(F.col("toxic") == y).collect()} for y in (1, 0))
    assert b.columns == docs.columns and clean <= ids(b) and len(toxic & ids(b)) <= 0.5 * len(toxic)
    c = stage["near_duplicates"](spark, docs, SF)
    assert c.columns == docs.columns and ids(c) == {r.class_id for r in jaccard.join(docs).collect()}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    d = stage["benchmark"](spark, docs, SF)
    assert d.columns == docs.columns
    assert ids(d) == ids(docs) - {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}


def test_pipeline_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    want = {r.doc_id for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == want and len(got) == len(want)


def test_entry_without_the_subpackage(tmp_path):
    """The entry module still imports when this subpackage and the pipeline are gone."""
    for name in ("grounded", "__spark_entry__.py"):
        copy = shutil.copytree if os.path.isdir(f"{REPO}/{name}") else shutil.copy
        copy(f"{REPO}/{name}", tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if copy is shutil.copytree else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(n[:2] == 'op' and n[2].isdigit() for n in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
                          capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
