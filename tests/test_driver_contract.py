"""The driver's situation: a bare SparkSession in another working directory, the
entry module loaded by path, Python work on executors (package shipping)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r'''
import importlib.util, json
spec = importlib.util.spec_from_file_location("entry_mod", %r)
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
q = m.queries()
out = {"entry": m.entry(spark).count()}
for name in ["search_knn_exact", "stream_pack_blocks", "embed_hash"]:
    out[name] = q[name](spark, "/root/testdata/sf0.001").count()
print("RESULT " + json.dumps(out))
spark.stop()
'''


def test_bare_session_from_other_directory():
    cwd = tempfile.mkdtemp(prefix="grounded-driver-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    proc = subprocess.run([sys.executable, "-c", SCRIPT % os.path.join(REPO, "__spark_entry__.py")], cwd=cwd,
                          env=env, capture_output=True, text=True, timeout=600)
    line = [x for x in proc.stdout.splitlines() if x.startswith("RESULT ")]
    assert line, proc.stderr[-3000:]
    import json
    res = json.loads(line[0][7:])
    assert res["entry"] == 40 and res["search_knn_exact"] > 0 and res["stream_pack_blocks"] > 0
    assert res["embed_hash"] > 0
