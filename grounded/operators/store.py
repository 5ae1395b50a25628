"""Vector collection storage.

A collection is a directory of Parquet folders: ``delta-<version>`` holds the points
of one upsert, ``base-<version>`` all points merged up to a version.  An upsert writes
its own points only; readers merge the newest base with the deltas after it, and
``compact`` (called by itself after ``COMPACT_AFTER`` deltas) writes a new base.  A
folder counts only once its ``_SUCCESS`` marker exists, and a folder that readers may
hold is never rewritten.  File-system calls go through Hadoop's FileSystem API, so the
same code works on HDFS, object stores and local disks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grounded.functions import text as tf
from grounded.session import MAX_BROADCAST_ROWS, broadcast_if_bounded, materialize


def point_ids(df: DataFrame, path_col: str, block_col: str | None, chunk_no_col: str, chunk_col: str,
              out: str = "point_id") -> DataFrame:
    """Deterministic content id (re-ingest replaces instead of duplicating)."""
    parts = [F.coalesce(F.col(path_col).cast("string"), F.lit(""))]
    if block_col:
        parts.append(F.col(block_col).cast("string"))
    parts += [F.col(chunk_no_col).cast("string"), F.coalesce(F.col(chunk_col), F.lit(""))]
    return df.withColumn(out, F.md5(F.concat_ws(":", *parts)))


def latest_wins(df: DataFrame, key: str, version_col: str = "v") -> DataFrame:
    """O10 merge rule: per key keep the row with the highest version.

    ``max_by`` aggregates partially in every task, so a key with many versions
    collapses before the shuffle instead of landing in one window partition."""
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.col(version_col))
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def dim_report(df: DataFrame, vec_col: str, expected: int) -> DataFrame:
    """Vector sizes and whether they honour the collection contract."""
    d = F.size(vec_col)
    return (df.groupBy(d.cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("ok", F.col("dim") == F.lit(expected)))


def split_by_dim(df: DataFrame, vec_col: str, expected: int) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(F.size(vec_col) == F.lit(expected), F.lit(False))
    return df.where(ok), df.where(~ok).withColumn("reason", F.lit(f"vector size is not {expected}"))


# Deltas since the last base after which an upsert merges them.
COMPACT_AFTER = 8


class Collection:
    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}"
        self.name = name
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- lifecycle (O11) ------------------------------------------------------
    def exists(self) -> bool:
        return self._fs.exists(self._Path(self.path + "/_meta"))

    def ensure(self, truncate: bool, dim: int, distance: str = "cosine") -> str:
        """exists & !truncate -> no-op; exists & truncate -> drop and create; missing -> create."""
        if self.exists() and not truncate:
            return "kept"
        if self.exists():
            if not self._fs.delete(self._Path(self.path), True):
                raise IOError(f"could not drop collection {self.path}")
            action = "recreated"
        else:
            action = "created"
        meta = self.spark.createDataFrame([(self.name, dim, distance)], "name string, dim int, distance string")
        meta.coalesce(1).write.mode("errorifexists").parquet(self.path + "/_meta")
        return action

    def meta(self) -> DataFrame:
        return self.spark.read.parquet(self.path + "/_meta")

    def _folders(self, kind: str) -> list[int]:
        p = self._Path(self.path)
        if not self._fs.exists(p):
            return []
        names = [st.getPath().getName() for st in self._fs.listStatus(p)]
        return sorted(int(n.split("-")[1]) for n in names if n.startswith(kind + "-")
                      and self._fs.exists(self._Path(f"{self.path}/{n}/_SUCCESS")))

    def _folder(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}-{version:08d}"

    def versions(self) -> list[int]:
        """Committed versions, those merged into a base and removed included."""
        bases, deltas = self._folders("base"), self._folders("delta")
        return sorted({*bases, *deltas})

    def current(self) -> DataFrame | None:
        """The newest base merged with the deltas after it: per key the highest version."""
        bases, deltas = self._folders("base"), self._folders("delta")
        base = bases[-1] if bases else 0
        parts = ([self._folder("base", base)] if bases else []) + [self._folder("delta", v) for v in deltas if v > base]
        if not parts:
            return None
        frames = [self.spark.read.parquet(p) for p in parts]
        return self._merged(frames).drop("_key", "_batch")

    @staticmethod
    def _merged(frames: list[DataFrame]) -> DataFrame:
        """Per key the newest row of ``frames``, the oldest first; no key is twice in one of them.

        The oldest is the largest as a rule, and most of its keys have no later row: their hashes are not among those of the
        later keys, counted and broadcast, and they stay where they are.  The few others meet the later keys themselves."""
        if len(frames) == 1:
            return frames[0]
        rest = frames[1]
        for f in frames[2:]:
            rest = rest.unionByName(f, allowMissingColumns=True)
        if rest.count() > MAX_BROADCAST_ROWS:
            return latest_wins(frames[0].unionByName(rest, allowMissingColumns=True), "_key")
        h = F.xxhash64("_key")
        hashes = F.broadcast(rest.select(h.alias("_h")).distinct())
        old, later = frames[0].withColumn("_at", h), rest.select(F.col("_key").alias("_later"))
        at = F.col("_at") == F.col("_h")
        perhaps = old.join(hashes, at, "left_semi").join(later, F.col("_key").eqNullSafe(F.col("_later")), "left_anti")
        kept = old.join(hashes, at, "left_anti").unionByName(perhaps).drop("_at")
        return kept.unionByName(rest if len(frames) == 2 else latest_wins(rest, "_key"), allowMissingColumns=True)

    # -- upsert (O10) ---------------------------------------------------------
    def upsert(self, points: DataFrame, key: str = "point_id", batch: tuple[str, int] | None = None, stored: bool = False) -> int:
        """Latest wins by key; always a new version, written as a delta of these points alone.

        ``batch`` (a stream's name and its batch number) makes a replayed micro-batch a no-op: its
        name is stored with the delta, and a committed delta of that name is left as it is.  Points that
        share a key within one upsert leave one of them, always the same.  Points without a key are refused
        by the caller's gate (``split_by_dim``), not here: NULL is a key like any other.  ``stored``: the points lie in files, so
        reading them twice gives the same rows; then only keys are shuffled, and whole points only where a key is repeated."""
        name = f"{batch[0]}#{batch[1]}" if batch else ""
        if batch:
            for v in reversed(self.versions()):
                if self._batch_of(v) == name:
                    return v
        cols = [F.col(c) for c in points.columns]

        def single(rows: DataFrame) -> DataFrame:
            return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*cols), F.xxhash64(*cols)).alias("_r")).select("_key", "_r.*")

        if stored:
            twice = materialize(points.groupBy(F.col(key).alias("_twice")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("_twice"), "repeated-keys")
            n, same = twice.count(), F.col(key).eqNullSafe(F.col("_twice"))
            one, twice = points.select(F.col(key).alias("_key"), *cols), broadcast_if_bounded(twice, n)
            if n:
                one = one.join(twice, same, "left_anti").unionByName(single(points.join(twice, same, "left_semi")))
        else:
            one = single(points)
        version = self._claim()
        target = self._folder("delta", version)
        one = one.withColumn("v", F.lit(version))
        marker = self.spark.createDataFrame([(name,)], "batch string").coalesce(1)
        try:
            marker.write.mode("overwrite").parquet(f"{self.path}/_batches/{version:08d}")
            one.write.mode("errorifexists").parquet(target)
        finally:
            self._fs.delete(self._Path(self._claimed(version)), False)
        if len([v for v in self._folders("delta") if v > (self._folders("base") or [0])[-1]]) >= COMPACT_AFTER:
            self.compact()
        return version

    def _claimed(self, version: int) -> str:
        return f"{self.path}/_claims/{version:08d}"

    def _open_claims(self) -> list[int]:
        p = self._Path(f"{self.path}/_claims")
        return sorted(int(st.getPath().getName()) for st in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _claim(self) -> int:
        """A version of this writer's own: its marker file is created exclusively, so two writers never share one.

        The marker goes when the upsert ends, done or failed.  One left by a driver that died only keeps ``compact`` from
        merging the versions from it on, until it is deleted by hand."""
        version = max([0, *self.versions(), *self._open_claims()]) + 1
        while not (self._fs.createNewFile(self._Path(self._claimed(version))) and version not in self.versions()):
            version += 1
        return version

    def _batch_of(self, version: int) -> str | None:
        path = f"{self.path}/_batches/{version:08d}"
        if not self._fs.exists(self._Path(path)):
            return None
        return self.spark.read.schema("batch string").parquet(path).first()["batch"]

    def reject(self, rows: DataFrame) -> str:
        """Append rows that did not enter the collection to its reject table, and name its folder."""
        path = f"{self.path}/_rejects"
        rows.write.mode("append").parquet(path)
        return path

    def compact(self, keep: int = 2) -> int | None:
        """Merge all deltas before the oldest open claim into a new base; folders behind the last ``keep`` bases are removed."""
        first = min(self._open_claims(), default=None)
        versions = [v for v in self.versions() if first is None or v < first]
        if not versions:
            return None
        bases = self._folders("base")
        if not bases or bases[-1] < versions[-1]:
            base = bases[-1] if bases else 0
            parts = ([self._folder("base", base)] if bases else []) + [self._folder("delta", v) for v in self._folders("delta") if base < v <= versions[-1]]
            merged = self.spark.read.parquet(parts[0])
            for p in parts[1:]:
                merged = merged.unionByName(self.spark.read.parquet(p), allowMissingColumns=True)
            target = self._folder("base", versions[-1])
            if self._fs.exists(self._Path(target)):
                self._fs.delete(self._Path(target), True)
            latest_wins(merged, "_key").write.mode("errorifexists").parquet(target)
            bases = self._folders("base")
        if len(bases) > keep:
            oldest = bases[-keep]
            for kind in ("base", "delta"):
                for v in self._folders(kind):
                    if v < oldest or (kind == "delta" and v == oldest):
                        self._fs.delete(self._Path(self._folder(kind, v)), True)
        return bases[-1]


def chunk_points(chunks: DataFrame, path_col: str = "path") -> DataFrame:
    """Points from chunks: content id, payload columns kept top-level for pruning."""
    p = point_ids(chunks, path_col, None, "i", "chunk")
    return p.select("point_id", F.col(path_col).alias("path"), "doc_id", F.col("i").alias("chunk_no"),
                    "chunk", tf.strip_newlines("chunk").alias("embed_text"))
