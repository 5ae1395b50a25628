"""Operator 3: documents joined by the Jaccard similarity of their word n-grams.

Documents are sets of five-word shingles; documents with the same set form a
text class, and one of them stands for it.  ``TREES`` MinHash keys of each text
find candidates.  The length of a key, at most ``LEVELS`` MinHash values, is the
longest at which a pair exactly at the threshold meets in some key with
probability ``RECALL`` by calculation; it is the same for all keys and is not
shortened on the data, so this is banding (32 keys of 6 values), not a forest of
sorted strings.  Texts that share a key, directly or through others, form a
candidate group, and every pair of texts inside a group is verified exactly:
intersections come from incidence matrices of a group's shingles.  A group of
any size is cut into blocks of bounded numbers of shingles and documents; each
pair of blocks is a task of its own and returns sums per document and a
spanning forest, never pairs.

Results for odd rows: texts are compared in lower case and split at white
space; a text of one to four words is one shingle of all its words; null, empty
and blank texts have no shingle, no link, and a class each by its own id;
repeated rows are members of the same class each and count as links of each
other; a null id is like any other; an empty table gives an empty result.
Results are built from the named columns, so others cannot clash."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import as_text, batch_of, checkpointed, map_batches, map_partitions, runs
from grounded.llm.components import components

WORDS, THRESHOLD = 5, 0.8
TREES, LEVELS, RECALL = 32, 8, 0.9999
# A block of a candidate group holds about so many shingles and documents; words that a task keeps hashes of.
BLOCK_SHINGLES, BLOCK_DOCS, KNOWN = 400_000, 768, 150_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


def prefix_length(threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold still meets in some tree with probability ``recall``."""
    for n in range(levels, 0, -1):
        if 1 - (1 - threshold ** n) ** trees >= recall:
            return n
    return 1


def expected_recall(similarity: float, length: int, trees: int = TREES) -> float:
    return 1 - (1 - similarity ** length) ** trees


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""

    def __init__(self, words: int = WORDS):
        self.n, self.known = words, {}

    def learn(self, words: set[str]) -> None:
        import xxhash
        if len(self.known) > KNOWN:
            self.known.clear()
        for w in words.difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))

    def shingles(self, text: str) -> np.ndarray:
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        self.learn(set(words))
        h = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(words))
        out = h[:len(h) - n + 1].copy()
        for i in range(1, n):
            out = out * _MIX + h[i:len(h) - n + 1 + i]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


class Forest:
    """MinHash keys: per tree ``length`` values, the prefix that is looked up, hashed to one key; ``levels`` only names the shape."""

    def __init__(self, trees: int, levels: int, length: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.shape, self.length = (trees, levels), length
        self.factor = rng.integers(1, 1 << 63, (trees * length, 1), dtype=np.uint64) | np.uint64(1)
        self.join = rng.integers(1, 1 << 63, (trees, length), dtype=np.uint64) | np.uint64(1)
        self.tree = rng.integers(1, 1 << 63, trees, dtype=np.uint64)

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        least = None
        for at in range(0, len(shingles), 2048):
            part = (shingles[at:at + 2048] * self.factor).min(1)
            least = part if least is None else np.minimum(least, part)
        least = (least >> np.uint64(16)).reshape(self.shape[0], self.length)
        key = (least * self.join).sum(1, dtype=np.uint64) + self.tree
        key ^= key >> np.uint64(31)
        return (key * _MIX).view(np.int64)


def signatures(documents: DataFrame, key: str, text: str, words: int, length: int, trees: int, levels: int) -> DataFrame:
    """Per row: ``id``, ``text_hash``, digest of the shingle set (null without words), its size and the tree keys."""
    def start():
        import xxhash
        shingler, forest = Shingler(words), Forest(trees, levels, length)

        def fn(batch):
            digests, sizes, keys = [], [], []
            for t in batch.column(2).to_pylist():
                s = shingler.shingles(as_text(t))
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(forest.keys(s) if len(s) else None)
            return [batch.column(0), batch.column(1), digests, sizes, keys]
        return fn

    rows = documents.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_hash"),
                            F.col(text).alias("text"))
    return map_batches(rows, start, "id long, text_hash long, digest binary, n long, keys array<long>")


def _candidate_groups(reps: DataFrame) -> DataFrame:
    """``digest``, ``root``: texts that share a prefix in some tree, directly or through others."""
    keyed = reps.select("digest", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("first")).where("n > 1")
    edges = keyed.join(shared, "key").select(F.col("digest").alias("u"), F.col("first").alias("v"))
    return components(edges).select(F.col("node").alias("digest"), "root")


def links_of(sets: list[np.ndarray], other: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which sets (rows) reach the threshold with which of ``other`` (columns; of the sets themselves if None)."""
    both = sets if other is None else sets + other
    sizes = np.array([len(s) for s in both])
    if other is None and len(sets) == 2:
        common = np.array([[0, 1], [1, 0]]) * len(np.intersect1d(*sets, assume_unique=True))
    else:
        _, column = np.unique(np.concatenate(both), return_inverse=True)
        row = np.repeat(np.arange(len(both)), sizes)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        alone = np.bincount(column)[column] == 1              # a shingle of one set meets nothing
        row, column = row[~alone], column[~alone]
        n = len(sets)
        common = np.zeros((n, n if other is None else len(other)), np.int64)
        width = 2048
        edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            if a < b:
                x = np.zeros((len(both), width), np.float32)
                x[row[a:b], column[a:b] - k * width] = 1
                common += np.rint(x[:n] @ (x if other is None else x[n:]).T).astype(np.int64)
    left = sizes[:len(sets), None]
    right = (sizes if other is None else sizes[len(sets):])[None, :]
    linked = common >= threshold * (left + right - common) - 1e-9
    if other is None:
        np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """Per member of a group, the smallest member that links reach from it."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] < 0:
            root[start], todo = start, [start]
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & (root < 0))
                root[new] = start
                todo += new.tolist()
    return root


LINKS = "digest binary, root binary, linked_docs long, linked_texts long"


def _verify(groups: DataFrame, threshold: float) -> DataFrame:
    """Links inside each pair of blocks: per text their number, and the smallest text they reach."""
    def run(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        out = []
        for (_, a, b), rows in runs(batches, 3):
            first = [r for r in rows if r[0] == a]
            second = [r for r in rows if r[0] == b] if a != b else []
            sets = [np.frombuffer(r[3], np.uint64) for r in first]
            if a == b:
                linked = links_of(sets, None, threshold) if len(sets) > 1 else np.zeros((1, 1), bool)
            elif first and second:
                part = links_of(sets, [np.frombuffer(r[3], np.uint64) for r in second], threshold)
                n = len(first)
                linked = np.zeros((len(rows),) * 2, bool)
                linked[:n, n:], linked[n:, :n] = part, part.T
            else:
                continue
            members = first + second
            copies = np.array([r[2] for r in members])
            root = _roots(linked)
            for i in np.flatnonzero(linked.any(1)):
                out.append((members[i][1], members[root[i]][1], int(copies[linked[i]].sum()), int(linked[i].sum())))
            if len(out) >= 5000:
                yield batch_of(out, schema)
                out = []
        if out:
            yield batch_of(out, schema)

    return map_partitions(groups, run, LINKS)


def join(documents: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
         threshold: float = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL) -> DataFrame:
    """One row per row of ``documents``:

    ``id``, ``text_hash`` (of the text, to tell rows of one id apart), ``class_id`` (smallest id of all documents
    that links reach from it), ``class_hash`` (the text hash beside that id), ``copy_of`` (smallest id with the
    same shingles), ``n_links`` (other documents at the threshold or above, copies included) and ``n_texts``
    (other texts among these)."""
    length = prefix_length(threshold, trees, levels, recall)
    rows = checkpointed(signatures(documents, key, text, words, length, trees, levels), "jaccard-rows")
    reps = checkpointed(
        rows.where("n > 0").groupBy("digest")
        .agg(F.min(F.struct("id", "text_hash")).alias("rep"), F.count(F.lit(1)).alias("copies"),
             F.first("n").alias("n"), F.first("keys").alias("keys")), "jaccard-reps")
    groups = checkpointed(_candidate_groups(reps), "jaccard-groups")
    blocks = (groups.join(reps.select("digest", "n"), "digest").groupBy("root")
              .agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_DOCS))
                   .cast("int").alias("blocks")))
    members = (groups.join(reps.select("digest", "rep", "copies"), "digest").join(blocks, "root")
               .select("root", "digest", "copies", "blocks", F.col("rep.id").alias("rep_id"),
                       F.col("rep.text_hash").alias("rep_hash")))

    # The sets of those texts that share a prefix with another: only these are shingled again and shuffled.
    def start():
        shingler = Shingler(words)

        def fn(batch):
            found = [shingler.shingles(as_text(t)).tobytes() for t in batch.columns[-1].to_pylist()]
            return [*batch.columns[:-1], found]
        return fn

    texts = documents.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("text_hash"),
                             F.col(text).alias("text"))
    chosen = (texts.join(members, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("text_hash") == F.col("rep_hash")))
              .select("root", "digest", "copies", "blocks", "text"))
    sets = map_batches(chosen, start, "root binary, digest binary, copies long, blocks int, shingles binary", 128)
    # Repeated rows of a representative leave one set.
    sets = sets.groupBy("root", "digest", "copies", "blocks").agg(F.first("shingles").alias("shingles"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    paired = (sets.withColumn("block", block)
              .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("root", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"),
                      "block", "digest", "copies", "shingles")
              .repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "digest"))
    links = checkpointed(_verify(paired, threshold), "jaccard-links")
    counts = links.groupBy("digest").agg(F.sum("linked_docs").alias("linked_docs"), F.sum("linked_texts").alias("n_texts"))
    found = components(links.select(F.col("digest").alias("u"), F.col("root").alias("v")))
    labelled = (reps.select("digest", "rep", "copies").join(counts, "digest", "left")
                .join(found.select(F.col("node").alias("digest"), "root"), "digest", "left")
                .withColumn("root", F.coalesce("root", "digest")))
    heads = labelled.groupBy("root").agg(F.min("rep").alias("head"))
    labelled = labelled.join(heads, "root").select("digest", "rep", "copies", "linked_docs", "n_texts", "head")
    return (rows.select("id", "text_hash", "digest").join(labelled, "digest", "left")
            .select("id", "text_hash",
                    F.when(F.col("head").isNull(), F.col("id")).otherwise(F.col("head.id")).alias("class_id"),
                    F.when(F.col("head").isNull(), F.col("text_hash")).otherwise(F.col("head.text_hash")).alias("class_hash"),
                    F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.col("rep.id")).alias("copy_of"),
                    (F.coalesce("linked_docs", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
                    F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts")))


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``documents``, all columns, that stand for their class: one row of each.

    A row without any word is the class of its id.  Of rows equal in id and text one stays, chosen by a hash of its
    columns of plain types.  Columns may have any names: rows travel as one struct."""
    from pyspark.sql import Window
    from pyspark.sql.types import AtomicType, VariantType
    found = join(documents, key, text, **options)
    heads = (found.where(F.col("id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash")))
             .select("id", "text_hash").distinct())
    plain = [F.col(f"`{f.name}`") for f in documents.schema
             if isinstance(f.dataType, AtomicType) and not isinstance(f.dataType, VariantType)]
    rows = documents.select(F.col(key).cast("long").alias("row_id"), F.xxhash64(F.col(text)).alias("row_hash"),
                            F.xxhash64(*plain).alias("at"),
                            F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    kept = rows.join(heads, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("text_hash")))
    again = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("at"))
    return kept.withColumn("n", again).where("n = 1").select("row.*")
