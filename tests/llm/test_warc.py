"""Archives: round trip, revisits, joined ranges, odd rows."""

import base64
import hashlib

from grounded.llm import warc
from grounded.session import scratch_dir

ROWS = [(3, "http://a/é", "<p>one</p>", 1), (1, "http://b", "<p>one</p>", 2), (2, None, "<p>one</p>", 3), (7, "http://c", None, 4),
        (8, "http://d\r\nX: y", "", 5), (9, "u", "x\r\n\r\ny" * 100000, 6), (None, "n", "<p>one</p>", 7), (None, "m", "alone", 8),
        (5, "same", "again", 9), (5, "same", "again", 9)]
SCHEMA = "page_id long, url string, html string, file long"


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    folder = scratch_dir(spark, "warc-test")
    index = warc.write(pages, folder)
    back = warc.read_records(index, folder).collect()
    assert len(back) == len(ROWS)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for pid, _, text, _ in ROWS:
        if pid is not None:
            first[text or ""] = min(first.get(text or "", pid), pid)
    want = []
    for pid, url, text, _ in ROWS:
        to = first.get(text or "")
        revisit = to is not None and to != pid
        want.append((pid, url, "revisit" if revisit else "response", to if revisit else None, len((text or "").encode()), sha(text),
                     None if revisit else (text or "").encode()))
    got = [(r.page_id, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest,
            None if r.payload is None else bytes(r.payload)) for r in back]
    assert sorted(got, key=str) == sorted(want, key=str)
    # A selection reads these records alone.
    some = warc.read_records(index.where("page_id in (3, 9)"), folder).collect()
    assert sorted(r.page_id for r in some) == [3, 9]
    assert index.where("record_type = 'revisit'").count() == sum(w[2] == "revisit" for w in want)


def test_small_payloads_can_stay_responses(spark):
    folder = scratch_dir(spark, "warc-test")
    index = warc.write(spark.createDataFrame(ROWS, SCHEMA), folder, least_bytes=100)
    assert {r.record_type for r in index.collect()} == {"response"}


def test_empty(spark):
    folder = scratch_dir(spark, "warc-test")
    assert warc.read_records(warc.write(spark.createDataFrame([], SCHEMA), folder), folder).count() == 0


def test_joined_ranges():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP + 1, 5), ("b", 0, 5), ("b", 5, warc.READ)]
    assert [len(g) for g in warc.joined_ranges(rows)] == [2, 1, 1, 1]
    assert list(warc.joined_ranges([])) == []
