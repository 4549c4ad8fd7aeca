"""WARC archives: writing with revisit records, and reading by verified chains of record boundaries.

Writing.  Of the pages with equal payloads of at least `min_bytes`, the one with
the largest page_id becomes a response record and the others revisit records
that refer to it.  Every task writes files of its own under names that no other
attempt uses and reports them; only reported files belong to the archive.

Reading.  A file is cut into splits.  Each split's task looks for the record
magic, parses a header there and gives the offset of the record after it.  Magic
inside a payload gives such candidates too, so a candidate counts only if the
chain of successors from the file's start reaches it.  Inside a split chains are
followed at once, to the first offset beyond the split; between splits pointer
jumping doubles the reach in each round.  Every split then has at most one true
entry, from which its records are read in order.

A header is parsed line by line up to the first line that is no field, and lines
that several candidates share are parsed once, so payloads of nothing but magic
or header lines cost linear time.  No header is longer than the longest that the
files' writer reports.

Cases: a null html is an empty payload; repeated rows of one page_id are alike,
all responses or all revisits; a null page_id is written as null and revisits
the largest page_id of its payload, and where that has none all are responses;
an empty table makes no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, prepare, settle

MAGIC = b"WARC/1.1\r\n"
FILE_BYTES = 256 << 20
SPLIT_BYTES = 4 << 20
#: How much of a file is read for a header at first.
HEAD_BYTES = 4096
MANIFEST = "file string, size long, head long"

_FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")


def _base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (refers_to given, payload None) keeps the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return MAGIC + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(path)
        out, name, size, longest, done = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, html, n_bytes, sha1, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is not None and size >= FILE_BYTES:
                    out.close()
                    done.append((name, size, longest))
                    out = None
                if out is None:
                    name, size, longest = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc", 0, 0
                    out = store.open_output_stream(f"{root}/{name}")
                raw = record(page_id, url, None if html is None else html.encode(), n_bytes, _base32(bytes.fromhex(sha1)), head)
                out.write(raw)
                size += len(raw)
                longest = max(longest, raw.index(b"\r\n\r\n") + 4)
        if out is not None:
            out.close()
            done.append((name, size, longest))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["file", "size", "head"])

    return run


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under path; gives the files: name, size and longest header."""
    spark = pages.sparkSession
    prepare(spark)
    store, root = pa.fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    heads = rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    heads = settle(heads, "heads")  # written: the join may then be split where one payload has many rows
    joined = rows.join(heads, "sha1", "left").withColumn("head", F.when(~F.col("page_id").eqNullSafe(F.col("head")), F.col("head")))
    ready = joined.select("page_id", "url", F.when(F.col("head").isNull(), F.col("html")).alias("html"), "n_bytes", "sha1", "head")
    return settle(ready.mapInArrow(_writer(path), MANIFEST), "manifest")


class _File:
    """Random reads of one file."""

    def __init__(self, path: str, name: str) -> None:
        store, root = pa.fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(f"{root}/{name}")
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(max(0, min(n, self.size - at)), at)

    def header(self, at: int) -> tuple[dict[bytes, bytes], int]:
        """(fields, offset of the block) of the record at `at`, where there is one."""
        n = HEAD_BYTES
        have = self.read(at, n)
        while (end := have.find(b"\r\n\r\n")) < 0 and len(have) < self.size - at:
            n *= 4
            have = self.read(at, n)
        if end < 0 or not have.startswith(MAGIC):
            raise ValueError(f"no record at {at}")
        return {m[1].lower(): m[2] for m in _FIELD.finditer(have, len(MAGIC), end + 2)}, at + end + 4


def successors(data: bytes, upto: int, head: int) -> dict[int, int]:
    """For every header of up to `head` bytes that begins before `upto`, the place behind its record.

    `known` holds, for every line start that was looked at, the place behind the
    header's blank line and its last Content-Length, or None where a line is no field.
    """
    known: dict[int, tuple[int, int] | None] = {}
    after: dict[int, int] = {}
    p = data.find(MAGIC, 0, upto + len(MAGIC) - 1)
    while p >= 0:
        line, seen = p + len(MAGIC), []
        while line not in known:
            if data.startswith(b"\r\n", line):
                known[line] = (line + 2, -1)
                break
            m = _FIELD.match(data, line)
            if m is None:
                known[line] = None
                break
            seen.append((line, m))
            line = m.end()
        found = known[line]
        for start, m in reversed(seen):
            if found and found[1] < 0 and m[1].lower() == b"content-length" and m[2].isdigit():
                found = (found[0], int(m[2]))
            known[start] = found
        if found and found[1] >= 0 and found[0] - p <= head:
            after[p] = found[0] + found[1] + 4
        p = data.find(MAGIC, p + 1, upto + len(MAGIC) - 1)
    return after


def _candidates(path: str):
    """(file, c, j): every candidate and the first offset beyond its split that its chain leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, lo, hi, head in zip(*(batch.column(c).to_pylist() for c in ("file", "lo", "hi", "head")), strict=True):
                after = {lo + c: lo + j for c, j in successors(_File(path, name).read(lo, hi - lo + head), hi - lo, head).items()}
                leads: dict[int, int] = {}
                for c in sorted(after, reverse=True):
                    nxt = after[c] if after[c] >= hi else leads.get(after[c])
                    if nxt is not None:
                        leads[c] = nxt
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(leads), pa.string()), pa.array(list(leads), pa.int64()), pa.array(list(leads.values()), pa.int64())], names=["file", "c", "j"])

    return run


def _records(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for name, hi, at in zip(*(batch.column(c).to_pylist() for c in ("file", "hi", "entry")), strict=True):
                f, rows = _File(path, name), []
                while at < hi:
                    fields, start = f.header(at)
                    block = f.read(start, int(fields[b"content-length"]))
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    ids = [re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(k, b"")) for k in (b"warc-record-id", b"warc-refers-to")]
                    kind = fields[b"warc-type"].decode()
                    digest = _base32(hashlib.sha1(payload).digest()) if kind == "response" else fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
                    if kind == "response" and (len(payload) != size or f"sha1:{digest}".encode() != fields[b"warc-payload-digest"]):
                        raise ValueError(f"{name}: damaged payload at {at}")
                    rows.append((ids[0] and int(ids[0][1]), fields[b"warc-target-uri"].decode(), payload if kind == "response" else None, size, digest, kind, ids[1] and int(ids[1][1])))
                    at = start + len(block) + 4
                    if len(rows) >= 256 or at >= hi:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []

    return run


def read(spark, path: str, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of files (file, size, head) under path: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    splits = files.where("size > 0").select("file", "size", "head", F.explode(F.sequence(F.lit(0), F.expr(f"(size - 1) div {split_bytes}"))).alias("split"))
    splits = splits.withColumn("lo", F.col("split") * split_bytes).withColumn("hi", F.least("size", F.col("lo") + split_bytes))
    most, n = splits.agg(F.max("split"), F.count("*")).first()
    spread = splits.repartition(max(1, min(n, 10_000)), "file", "split")
    jumps = settle(spread.mapInArrow(_candidates(path), "file string, c long, j long"), "jumps")
    true = files.where("size > 0").select("file", F.lit(0).cast("long").alias("c"))
    for _ in range(max(most or 0, 0).bit_length()):
        true = settle(true.union(true.join(jumps, ["file", "c"]).select("file", F.col("j").alias("c"))).distinct(), "true")
        step = jumps.select("file", F.col("c").alias("j"), F.col("j").alias("k"))
        jumps = settle(jumps.join(step, ["file", "j"], "left").select("file", "c", F.coalesce("k", "j").alias("j")), "jumps")
    entries = true.select("file", F.expr(f"c div {split_bytes}").alias("split"), F.col("c").alias("entry"))
    placed = splits.join(entries, ["file", "split"]).where("entry < hi").repartition(max(1, min(n, 10_000)), "file", "split")
    return placed.mapInArrow(_records(path), "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as an archive in the shared folder and read it back: one row per page, without payloads."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    return read(spark, path, write(pages, path, min_bytes)).drop("payload", "url")
