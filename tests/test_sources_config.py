"""Folder corpus scan, page extraction, configuration."""

import json
import os
import tempfile

import pytest

from grounded.config import EngineConfig, TextConfig
from grounded.operators.packing import pack_blocks
from grounded.sources import tables


def test_binary_scan_and_pages(spark):
    root = tempfile.mkdtemp(prefix="grounded-corpus-", dir="/tmp")
    os.makedirs(f"{root}/sub")
    files = {"a.pdf": "page one\fpage two", "sub/b.pdf": "x" * 10, "c.PDF": "skip", "d.txt": "skip",
             "sub/bad.pdf": None}
    for name, body in files.items():
        with open(f"{root}/{name}", "wb") as fh:
            fh.write(b"\xff\xfe\xfa" if body is None else body.encode())
    scan = tables.binary_corpus_scan(spark, root)
    names = sorted(os.path.relpath(r.path.replace("file:", ""), root) for r in scan.select("path").collect())
    assert names == ["a.pdf", "sub/b.pdf", "sub/bad.pdf"]
    ok, skipped = tables.corpus_listing(spark, root)
    assert sorted(os.path.basename(r.path) for r in skipped.collect()) == ["c.PDF", "d.txt"]
    assert ok.count() == 3
    pages, dead = tables.extract_pages(scan)
    got = sorted((os.path.basename(r.path), r.page_no, r.text) for r in pages.collect())
    assert got == [("a.pdf", 0, "page one"), ("a.pdf", 1, "page two"), ("b.pdf", 0, "x" * 10)]
    assert [os.path.basename(r.path) for r in dead.collect()] == ["bad.pdf"]
    blocks = pack_blocks(pages.withColumnRenamed("path", "doc"), key="doc", order="page_no", block_bytes=5)
    assert sorted(r.blk for r in blocks.collect()) == ["page one", "page two", "x" * 10]


def test_config_load_and_validate(tmp_path):
    raw = {"query": {"main_model_name": "m", "main_temperature": 0, "input_guardrail_model_name": "g",
                     "input_guardrail_temperature": 0, "output_guardrail_temperature": 0},
           "vector_store": {"host": "localhost", "port": 6334, "collection_name": "rag"}, "server_addr": ":8080"}
    p = tmp_path / "c.json"
    p.write_text(json.dumps(raw))
    cfg = EngineConfig.load(str(p))
    assert cfg.collection == "rag" and cfg.answer.effective_output_guard == "g"
    # Only the named section counts, whatever others hold.
    raw = {"other": {"collection_name": "wrong"}, "store": {"collection_name": "right"}, "embedding": {"model_name": "e5"}}
    assert EngineConfig.from_dict(raw, "store").collection == "right" and EngineConfig.from_dict(raw).collection == "rag"
    assert EngineConfig.from_dict(raw).embed.model == "e5"
    with pytest.raises(ValueError):
        TextConfig(window_tokens=10, window_overlap=10).validate()
    with pytest.raises(ValueError):
        EngineConfig.from_dict({"query": {"main_temperature": 9}})


def test_scratch_needs_a_shared_folder_off_local_mode(spark, monkeypatch):
    from types import SimpleNamespace

    from grounded import session
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError):
        session.scratch_dir(SimpleNamespace(sparkContext=sc, conf={}))
    path = session.scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.remove_scratch(spark, path)
    with pytest.raises(ValueError):
        session.remove_scratch(spark, "/tmp/elsewhere")


def test_scratch_uses_the_session_checkpoint_dir(spark):
    from grounded.session import scratch_dir
    base = spark.sparkContext.getCheckpointDir()
    assert base, "a checkpoint folder is configured (from the session, or created for tests)"
    p = scratch_dir(spark, "probe")
    assert p.startswith(base.rstrip("/") + "/probe-")
