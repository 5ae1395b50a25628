"""Session construction and the shared scratch location.

Scratch data (checkpoints, snapshots, stream checkpoints) always lives under
the directory the cluster names in ``spark.checkpoint.dir``.  Only when that
setting is absent (local tests) do we create one.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "grounded",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)))
    if master:
        b = b.master(master)
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def scratch_dir(spark: SparkSession, name: str = "") -> str:
    """A fresh sub-directory of the shared checkpoint folder.

    Reads ``spark.checkpoint.dir`` from the session.  Only a ``local`` master may go without the
    setting (tests): on a cluster every executor would write to a disk of its own."""
    sc = spark.sparkContext
    base = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="grounded-ckpt-", dir="/tmp")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    base = base.rstrip("/")
    return f"{base}/{name or 'scratch'}-{uuid.uuid4().hex[:12]}"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder (``spark.checkpoint.dir``); created only when unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        scratch_dir(spark, "init")
    return sc.getCheckpointDir()


def remove_scratch(spark: SparkSession, path: str) -> bool:
    """Delete a folder that ``scratch_dir`` named; anything outside the shared scratch folder is refused."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    if not path.startswith(base + "/") or path.rstrip("/") == base:
        raise ValueError(f"{path} is not a scratch folder")
    return remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder of the caller's own through Hadoop's FileSystem API; False if there is none."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``grounded`` importable in executor Python workers (once per application).

    The package is zipped in memory and written through Hadoop's FileSystem API
    into the shared checkpoint folder, then distributed with ``addPyFile`` (the
    standard way to ship Python code to a cluster); workers started from any
    directory can then unpickle functions that reference it."""
    import io
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    parent = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, parent))
    target = scratch_dir(spark, "pkg") + "/grounded.zip"
    jvm = sc._jvm
    path = jvm.org.apache.hadoop.fs.Path(target)
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(target)
    _SHIPPED.add(key)


# Rows of an Arrow batch that hold a text or a wide vector each.
ROWS_A_BATCH = 512


def small_batches(spark: SparkSession) -> None:
    """Arrow batches hold at most ``ROWS_A_BATCH`` rows: a Python worker then holds so many texts or vectors at a time, however
    many rows its partition has."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= ROWS_A_BATCH:
        spark.conf.set(name, str(ROWS_A_BATCH))


def materialize(df, name: str = "materialized"):
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back.

    Used where a derived dataset is scanned several times (e.g. one scan per
    question batch): later scans read compact columnar files instead of
    recomputing the derivation, and the lineage is cut."""
    path = scratch_dir(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


# Rows a broadcast side may hold (checked by an exact count, never estimated).
MAX_BROADCAST_ROWS = 2_000_000


def broadcast_if_bounded(df, n_rows: int, max_rows: int = MAX_BROADCAST_ROWS):
    """Broadcast ``df`` only when its counted size is within the bound; larger
    sides stay shuffle-join inputs (AQE may still convert them at run time)."""
    from pyspark.sql import functions as F
    return F.broadcast(df) if n_rows <= max_rows else df
