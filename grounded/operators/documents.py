"""Document versions over a collection (O10, S02): changed files are ingested again without leaving old chunks behind.

A point's id holds its chunk's text, so an edited chunk is a new point and the old one would stay.  A second
collection, the manifest, therefore keeps one row per path: the digest of its text and the collection version its
chunks start from.  ``sync`` compares a snapshot of the documents with the manifest by one outer join of (path,
digest) rows; only new and changed documents are split, embedded and stored, removed ones get a delete
marker.  ``live`` reads the points less those whose document has moved on, by an anti-join with the manifest.

Points are committed before the manifest: a run that dies in between is repeated by the next one, since the
manifest still holds the old digests, and until then both versions of a document are visible.  Of rows that share
a path the one with the largest digest counts, always the same; documents without a path are not
stored; a null text is an empty one and has no chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grounded.operators.store import Collection
from grounded.session import broadcast_if_bounded, materialize

MANIFEST_SCHEMA = "path string, digest string, since long, v int"
# Start version of a removed document: no version of its points is that high.
REMOVED = (1 << 62)


def digest_of(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def snapshot(docs: DataFrame, path: str = "path", text: str = "text", whole: bool = True) -> DataFrame:
    """``(path, digest, gone)``: one row per path; partially aggregated, so a path of many rows collapses before the shuffle."""
    gone = F.lit(False) if whole else ~F.max(F.col("has_text"))
    return (docs.where(F.col(path).isNotNull())
            .select(F.col(path).alias("path"), digest_of(text).alias("digest"), F.col(text).isNotNull().alias("has_text"))
            .groupBy("path").agg(F.max("digest").alias("digest"), gone.alias("gone")))


def changes(shot: DataFrame, known: DataFrame, whole: bool = True) -> DataFrame:
    """``(path, digest, state)`` of every path that is ``new``, ``changed`` or ``removed`` against the manifest's rows."""
    had = known.where(F.col("since") < REMOVED).select("path", F.col("digest").alias("had"))
    state = (F.when(F.col("digest").isNull(), F.lit("removed" if whole else None))
             .when(F.col("gone"), F.when(F.col("had").isNotNull(), "removed"))
             .when(F.col("had").isNull(), "new").when(F.col("digest") != F.col("had"), "changed"))
    return (shot.join(had, "path", "full").withColumn("state", state).where(F.col("state").isNotNull())
            .select("path", "digest", "state"))


def manifest_rows(manifest: Collection) -> DataFrame:
    rows = manifest.current()
    return manifest.spark.createDataFrame([], MANIFEST_SCHEMA) if rows is None else rows


def sync(docs: DataFrame, to_points: Callable[[DataFrame], DataFrame], collection: Collection, manifest: Collection,
         path: str = "path", text: str = "text", batch: tuple[str, int] | None = None, whole: bool = True, stored: bool = False) -> DataFrame:
    """Bring ``collection`` up to the state of ``docs``; returns what changed, ``(path, digest, state)``.

    ``to_points`` makes the points (with ``point_id`` and ``path``) of the documents it gets: rows of ``docs``, all
    columns.  ``whole``: ``docs`` is everything there is, so paths it lacks are removed; otherwise it holds some
    documents to add or replace, and a null text with ``whole=False`` removes its document.  ``batch`` names a
    stream's micro-batch, so that a replayed one changes nothing.  ``stored``: see ``Collection.upsert``, for the points."""
    todo = changes(snapshot(docs, path, text, whole), manifest_rows(manifest), whole)
    todo = materialize(todo, "changed-documents")       # read three times below, and the manifest moves on
    if not todo.limit(1).count():
        return todo
    kept = todo.where(F.col("state") != "removed").select(F.col("path").alias("_path"), F.col("digest").alias("_digest"))
    fresh, n = docs.where(F.col(path).isNotNull()), kept.count()
    if n < fresh.count():                               # as many rows as paths: every row is to be ingested, no text moves
        fresh = docs.join(broadcast_if_bounded(kept, n), (F.col(path) == F.col("_path")) & (digest_of(text) == F.col("_digest")), "left_semi")
    version = collection.upsert(to_points(fresh), batch=batch, stored=stored)
    since = F.when(F.col("state") == "removed", F.lit(REMOVED)).otherwise(F.lit(version)).cast("long")
    manifest.upsert(todo.select("path", "digest", since.alias("since")), key="path", batch=batch)
    return todo


def live(collection: Collection, manifest: Collection) -> DataFrame | None:
    """The collection's points less those of a document version that a later one replaced or removed."""
    points = collection.current()
    if points is None:
        return None
    # Versions begin with 1: a document that starts from it has no earlier points.  A row per path on the right; without a
    # broadcast the many points of one path are split by AQE's skew join.
    over = manifest_rows(manifest).where(F.col("since") > 1).select(F.col("path").alias("_path"), "since")
    return points.join(broadcast_if_bounded(over, over.count()), (F.col("path") == F.col("_path")) & (F.col("v") < F.col("since")), "left_anti")
