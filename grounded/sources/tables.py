"""Table and file sources.

``read_table`` prunes columns at the scan so Parquet reads only what a query
uses; filters written after it are pushed into the scan by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Tables whose rows carry heavy per-row work (tokenising, hashing, scoring).
HEAVY = ("documents", "pages", "conversations", "embeddings")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Add parallelism only when a scan under-fills the cluster.

    A file stored as one row group is read by one task; CPU-heavy narrow work
    after it would then run serially.  Large inputs already arrive in many
    splits and are left alone (no shuffle).  Filters on stored columns written
    after this still reach the Parquet scan; operators avoid predicates on
    derived columns (they use ``explode_outer`` + a null filter), so tokenising
    work is not pushed back below the exchange."""
    try:
        n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - sessions without RDD access: leave the plan as it is
        return df
    return df if have >= n else df.repartition(n)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               parallel: bool | None = None) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    from grounded.session import ship_package
    ship_package(spark)
    df = spark.read.parquet(table_path(sf_dir, name))
    df = df.select(*columns) if columns else df
    if parallel if parallel is not None else name in HEAVY:
        df = spread(df)
    return df


def corpus_scan(documents: DataFrame) -> DataFrame:
    """O01 over a table corpus: one row per readable document.

    A document is "regular" when it has text; empty or NULL text is skipped the
    way non-regular files are skipped by the folder walk."""
    return (documents
            .where(F.col("text").isNotNull() & (F.length("text") > 0))
            .select("doc_id", F.col("source").alias("path"), "lang",
                    F.octet_length("text").cast("long").alias("n_bytes")))


def binary_corpus_scan(spark: SparkSession, root: str, suffix: str = ".pdf") -> DataFrame:
    """O01 over a folder: recursive walk, regular files only, case-sensitive suffix.

    ``binaryFile`` lists files on the executors' file system client; the glob is
    applied while listing, so skipped files are never opened."""
    return (spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", f"*{suffix}")
            .load(root)
            .where(F.col("path").endswith(suffix)))


def corpus_listing(spark: SparkSession, root: str, suffix: str = ".pdf") -> tuple[DataFrame, DataFrame]:
    """Folder walk split into accepted files and skipped ones (with the reason).

    Only paths and lengths are selected, so ``binaryFile`` never reads file
    contents for the listing."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    ok = F.col("path").endswith(suffix)
    return (files.where(ok),
            files.where(~ok).select("path", F.lit(f"not a {suffix} file").alias("reason")))


def _plain_pages(content: bytes) -> list[str]:
    """Default extractor: UTF-8 text, pages separated by form feeds."""
    return content.decode("utf-8").split("\f")


def extract_pages(files: DataFrame, extractor=_plain_pages) -> tuple[DataFrame, DataFrame]:
    """O02 for binary files: ``(path, content)`` -> pages ``(path, page_no, text)``.

    The extractor runs once per file inside ``mapInPandas`` (one file's bytes at a
    time).  A file that cannot be opened goes to the dead-letter frame; a page that
    fails yields a NULL text (skipped by packing) and the document continues."""
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("page_no", T.IntegerType()),
                           T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches):
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    pages = extractor(bytes(content))
                except Exception as exc:  # noqa: BLE001 - becomes a dead-letter row
                    out.append((path, None, None, f"{type(exc).__name__}: {exc}"))
                    continue
                for i, p in enumerate(pages):
                    out.append((path, i, p if isinstance(p, str) else None, None))
            yield pd.DataFrame(out, columns=["path", "page_no", "text", "error"])

    res = files.select("path", "content").mapInPandas(run, schema)
    return (res.where(F.col("error").isNull()).drop("error"),
            res.where(F.col("error").isNotNull()).select("path", F.col("error").alias("reason")))
