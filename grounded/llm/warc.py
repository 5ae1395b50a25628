"""Operator 8: WARC archives with an index of byte ranges.

Writing: every row becomes one record, compressed as a gzip member of its own,
so that a byte range is enough to read it.  Records with equal payloads (same
SHA-1 and length) are stored once: the smallest id is the ``response``, the
others are ``revisit`` records that name it.  Each task appends its records to
files of its own in the shared folder and returns an index row per record:
file, offset, length, URL and digest.  The index is committed by Spark, so
files of lost or repeated tasks are never looked at.

Reading: the selected index rows are sorted by file and offset, neighbouring
ranges are joined into larger reads, and the records are parsed from those.

Archives are written and read through Arrow's file systems (local or shared
mounts, HDFS, S3); tables are read by Spark alone.

Results for odd rows: a null payload is empty; a null URL leaves its header
out; null ids are written without an id and count as larger than all others;
rows that repeat id and payload are all of the same type; payloads smaller than
``least_bytes`` are always responses; an empty table gives an empty index.
Input columns other than the three named ones are not read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grounded.llm.common import batch_of, checkpointed, map_batches, map_partitions
from grounded.session import scratch_dir

DATE = "2024-01-01T00:00:00Z"
# A file is closed and the next begun beyond this size.
FILE_BYTES = 256 << 20
# Ranges closer than GAP are read together, up to READ bytes at once; a task reads stretches of STRETCH bytes.
GAP, READ, STRETCH = 64 << 10, 4 << 20, 16 << 20

INDEX = ("page_id long, url string, file string, offset long, length long, digest string, record_type string, "
         "refers_to long, payload_bytes long")
RECORDS = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
           "payload binary")


def filesystem(path: str):
    """Arrow file system and path of a folder named as Spark names it."""
    from pyarrow import fs
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int,
           refers_to: int | None = None) -> bytes:
    """One uncompressed WARC record; a revisit holds the HTTP header alone."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:?#[]@!$&'()*+,;=-._~"))
    if kind == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    return fields, block.partition(b"\r\n\r\n")[2]


def compressed(data: bytes) -> bytes:
    return gzip.compress(data, compresslevel=4, mtime=0)


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html",
          least_bytes: int = 0) -> DataFrame:
    """Writes the archives under ``folder`` and returns their committed index."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        payload.alias("payload"), F.sha1(payload).alias("sha1"))
    # Which record of equal payloads comes first: ids and digests alone are shuffled.
    ids = rows.select("page_id", "sha1", F.octet_length("payload").alias("n"))
    same = (ids.where(F.col("n") >= least_bytes).groupBy("sha1", "n")
            .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and first is not null"))
    revisits = (ids.join(same, ["sha1", "n"]).where("page_id is null or page_id > first")
                .select(F.col("page_id").alias("v_id"), F.col("sha1").alias("v_sha1"), "first").distinct())

    def pack():
        def fn(batch):
            out = [], [], [], [], [], []
            for pid, u, data, sha1 in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = compressed(record("response", pid, u, data, digest, len(data)))
                for column, value in zip(out, (pid, u, sha1, digest, len(data), member)):
                    column.append(value)
            return list(out)
        return fn

    packed = map_batches(rows, pack, "page_id long, url string, sha1 string, digest string, size long, member binary", 64)
    typed = packed.join(revisits, F.col("page_id").eqNullSafe(F.col("v_id")) & (F.col("sha1") == F.col("v_sha1")), "left")
    index = map_partitions(typed.select("page_id", "url", "digest", "size", "member", "first"), _writer(folder), INDEX)
    return checkpointed(index, "warc-index")


def _writer(folder: str):
    def run(batches, schema):
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                entries = []
                for pid, url, digest, size, member, first in zip(*(c.to_pylist() for c in batch.columns)):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                        info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Date: {DATE}\r\nWARC-Filename: {name}\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
                        lead = compressed(info.encode())
                        out.write(lead)
                        at += len(lead)
                    kind = "response" if first is None else "revisit"
                    data = member if first is None else compressed(record(kind, pid, url, b"", digest, size, first))
                    out.write(data)
                    entries.append((pid, url, name, at, len(data), digest, kind, first, size))
                    at += len(data)
                yield batch_of(entries, schema)
        finally:
            if out is not None:
                out.close()
    return run


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows, read back by their byte ranges; ``payload`` is null without ``payloads``.

    Id, type, reference, size and digest come from the record itself; a response's size and digest are taken
    from its payload, and a record that does not hold what its header says fails the job."""
    stretch = F.floor(F.col("offset") / STRETCH)
    wanted = (index.select("file", "offset", "length", "url")
              .repartition(F.col("file"), stretch).sortWithinPartitions("file", "offset"))

    def run(batches, schema):
        files, base = filesystem(folder)
        name, source = None, None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for group in joined_ranges(rows):
                if group[0][0] != name:
                    name, source = group[0][0], files.open_input_file(f"{base}/{group[0][0]}")
                start = group[0][1]
                data = source.read_at(max(r[1] + r[2] for r in group) - start, start)
                yield batch_of([_row(data[r[1] - start:r[1] - start + r[2]], r[3], payloads) for r in group], schema)

    return map_partitions(wanted, run, RECORDS)


def joined_ranges(rows: list[tuple]):
    """Sorted (file, offset, length, ...) rows in groups that one read covers."""
    group, end = [], 0
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] > end + GAP or row[1] + row[2] - group[0][1] > READ):
            yield group
            group = []
        group.append(row)
        end = row[1] + row[2]
    if group:
        yield group


def _row(member: bytes, url: str | None, payloads: bool) -> tuple:
    fields, payload = parse(zlib.decompress(member, 16 + zlib.MAX_WBITS))
    kind, size = fields["WARC-Type"], int(fields["X-Payload-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response":
        if (len(payload), base32_sha1(payload)) != (size, digest):
            raise ValueError("a payload differs from its record's header")
        size, digest = len(payload), base32_sha1(payload)
    return (_page(fields.get("WARC-Record-ID")), url, kind, _page(fields.get("WARC-Refers-To")), size, digest,
            payload if payloads and kind == "response" else None)


def archived(pages: DataFrame) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads every record back."""
    folder = scratch_dir(pages.sparkSession, "warc")
    return read_records(write(pages, folder), folder, payloads=False)
