"""Extendible hashing against a splitting loop in plain Python."""

import hashlib

from grounded.llm import sharding


def plain(rows, limit):
    """Buckets split one bit at a time, each only while it is too large."""
    bits = lambda k: "".join(f"{b:08b}" for b in hashlib.md5(("" if k is None else str(k)).encode()).digest())
    done, todo = {}, {"": [(bits(k), n) for k, n in rows]}
    while todo:
        prefix, bucket = todo.popitem()
        if sum(n for _, n in bucket) <= limit or len(bucket) == 1 or len(prefix) == 128:
            if bucket:
                done[prefix] = (sum(n for _, n in bucket), len(bucket))
        else:
            for bit in "01":
                if part := [x for x in bucket if x[0][len(prefix)] == bit]:
                    todo[prefix + bit] = part
    return done


def shards(df, limit):
    rows, directory = sharding.assign(df, "doc_id", "text", limit)
    return rows.collect(), {r.shard: (r.shard_bytes, r.shard_rows) for r in directory.collect()}, directory


def test_equals_a_splitting_loop(spark):
    data = [(i, "é" * (i % 97)) for i in range(700)] + [(1000, "x" * 5000), (1001, None), (1002, ""), (None, "abc")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for limit in (1, 300, 4000, 10 ** 9):
        rows, directory, frame = shards(df, limit)
        assert directory == plain([(k, len((t or "").encode())) for k, t in data], limit)
        assert len(rows) == len(data)
        assert all(b <= limit or n == 1 for b, n in directory.values())
        assert frame.where("oversized").count() == sum(b > limit for b, _ in directory.values())
        assert len({r.doc_id for r in rows}) == len(data)
        assert all((r.shard_bytes, r.shard_rows) == directory[r.shard] and r.depth == len(r.shard) for r in rows)


def test_a_key_with_a_third_of_the_rows_splits(spark):
    data = [(7, "y" * 10)] * 300 + [(i, "z" * 10) for i in range(600)]
    rows, directory, _ = shards(spark.createDataFrame(data, "doc_id long, text string"), 200)
    assert len(rows) == 900 and all(b <= 200 for b, _ in directory.values())
    assert sum(n for _, n in directory.values()) == 900


def test_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", 5, "q")], "doc_id long, text string, depth long, shard string")
    rows, directory, _ = shards(df, 10)
    assert len(rows) == 1 and directory == {"": (1, 1)}
    rows, directory, _ = shards(df.limit(0), 10)
    assert rows == [] and directory == {}


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "w" * 50, "k") for i in range(100)], "doc_id long, text string, extra string")
    rows, _ = sharding.assign(df, "doc_id", "text", 500)
    sharding.write_shards(df, rows, "doc_id", str(tmp_path / "shards"))
    back = spark.read.option("basePath", str(tmp_path / "shards")).parquet(str(tmp_path / "shards"))
    assert back.count() == 100 and back.groupBy("shard").count().where("count > 10").count() == 0


def test_named_columns_that_clash_with_results(spark, tmp_path):
    df = spark.createDataFrame([(i, "w" * 50, i % 3, i, i) for i in range(40)],
                               "depth long, text string, n_bytes long, shard long, __row long")
    rows, directory = sharding.assign(df, "depth", "text", 500, keep=("n_bytes", "shard", "__row"))
    assert rows.columns == ["depth_in", "n_bytes_in", "shard_in", "__row", *sharding.RESULT]
    assert sorted((r.depth_in, r.n_bytes_in, r.shard_in, r["__row"]) for r in rows.collect()) == [(i, i % 3, i, i) for i in range(40)]
    assert {r.shard: r.shard_bytes for r in directory.collect()} == {r.shard: r.shard_bytes for r in rows.collect()}
    for key in ("depth", "shard"):
        rows, _ = sharding.assign(df, key, "text", 500)
        path = str(tmp_path / key)
        sharding.write_shards(df, rows, key, path)
        back = spark.read.parquet(path)
        assert back.count() == 40 and sorted(r.shard_in for r in back.collect()) == list(range(40))
