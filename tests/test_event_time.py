"""Event-time windows: reported once, late events listed, the same after a restart or a replayed batch."""

import datetime as dt

from grounded.session import scratch_dir
from grounded.streaming import streams

SCHEMA = "event_id long, ts timestamp_ntz, event_type string, value double"
T0 = dt.datetime(2024, 3, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


BATCHES = [
    [(1, at(0.1), "a", 1.0), (2, at(0.9), "a", 2.0), (3, at(0.2), "b", 3.0), (4, at(2.5), "a", 1.0)],
    [(5, at(0.99), "a", 4.0), (6, at(5.2), "b", 1.0), (7, None, "a", 9.0)],      # 5: the window (0, 1) is still open
    [(8, at(0.5), "a", 5.0), (9, at(2.9), "a", 6.0), (10, at(3.3), "a", 7.0)],   # 8 and 9 are late, 10 is not
    [(11, at(4.0), "c", None), (12, at(9.0), "a", 1.0)],
]


def plain(batches):
    final, late, counts, mark = {}, [], {}, None
    for rows in batches:
        seen = mark
        for i, ts, kind, value in rows:
            w = ts and ts.replace(minute=0, second=0, microsecond=0)
            if ts is None or (mark and w + dt.timedelta(hours=1) <= mark):
                late.append((i, mark))
                continue
            n, total = counts.get((w, kind), (0, None))
            counts[w, kind] = n + 1, total if value is None else (total or 0) + value
            seen = max(filter(None, (seen, ts - dt.timedelta(hours=2))))
        mark = seen
        for key in [k for k in counts if k[0] + dt.timedelta(hours=1) <= mark]:
            assert key not in final
            final[key] = counts.pop(key)
    return sorted((*k, *v) for k, v in final.items()), sorted(late, key=str)


def run(spark, path, root, batches):
    out = None
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")
        out = streams.request_rate_final(spark, streams.table_stream(spark, path, "events"), root=root)
    final, late = out
    return (sorted((r.window_start, r.event_type, r.n, r.total_value) for r in final.collect()),
            sorted(((r.event_id, r.watermark) for r in late.collect()), key=str))


def test_final_and_late_over_restarts(spark, tmp_path):
    """Each arrival restarts the stream from its checkpoint."""
    assert run(spark, str(tmp_path), scratch_dir(spark, "t-rates"), BATCHES) == plain(BATCHES)
    assert plain(BATCHES)[1] == sorted([(7, at(0.5)), (8, at(3.2)), (9, at(3.2))], key=str)


def test_one_run_over_all_files_and_ordered_input(spark, tmp_path):
    for k, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    final, late = streams.request_rate_final(spark, streams.table_stream(spark, str(tmp_path), "events"))
    want = plain(BATCHES)
    assert sorted((r.window_start, r.event_type, r.n, r.total_value) for r in final.collect()) == want[0]
    assert sorted(r.event_id for r in late.collect()) == sorted(i for i, _ in want[1])


def test_any_session_time_zone(spark, tmp_path):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")     # +05:30
        got = run(spark, str(tmp_path), scratch_dir(spark, "t-rates"), BATCHES)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == plain(BATCHES)


def test_a_replayed_batch_counts_once_and_old_state_goes(spark, tmp_path, monkeypatch):
    import os
    root = scratch_dir(spark, "t-rates")
    run(spark, str(tmp_path), root, BATCHES[:2])
    fails, real = [1], streams.remove_path

    def broken(*a):
        if fails:
            fails.pop()
            raise IOError("lost before the batch was committed")
        return real(*a)

    monkeypatch.setattr(streams, "remove_path", broken)
    try:
        run(spark, str(tmp_path), root, BATCHES[2:3])
    except Exception as exc:  # noqa: BLE001 - the stream reports the batch's failure
        assert "lost" in str(exc)
    else:
        raise AssertionError("the batch should have failed")
    assert run(spark, str(tmp_path), root, BATCHES[3:]) == plain(BATCHES)
    assert sorted(os.listdir(root.removeprefix("file:") + "/open")) == ["batch=2", "batch=3"]
