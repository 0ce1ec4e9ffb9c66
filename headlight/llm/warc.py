"""WARC as a chunked record table: rows (archive, record, chunk number, bytes) whose concatenation is a WARC/1.1 file.

Payloads are cut into chunks that are views of the input row's buffer; digests are carried from chunk to chunk, so
neither writing nor reading allocates a whole record. Each chunk row carries the SHA-1 of its record's payload so far.
Of records with equal payloads of at least `least` bytes the one with the smallest id is a response, the others are
revisits without a payload. A record's block is an HTTP message, whose header carries the page's id and the payload's length. A
null payload is empty; each row is a record with an id of its own, so rows that repeat the smallest id with the same payload are
all responses; a null page id is left out of the header, its record always a response and never referred to; the target of a page
without a url is `urn:page:` and its id; extra columns are ignored; an empty table gives an empty archive.

A record whose chunks a file split cuts apart is read again through a shuffle by record; others are read in place.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headlight.llm.common import ready, scratch, table

CHUNK = 64 * 1024
#: Revisits up to this many rows (56 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
CHUNKS = "archive int, record long, chunk int, last boolean, bytes binary, sha1 binary"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if ": " in line)


def _uri(url: str | None, page_id) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or f"urn:page:{'' if page_id is None else page_id}"


def _head(place: tuple[int, int], page_id, url: str | None, refers_to, refers_url: str | None, length: int, digest: bytes, date: str) -> bytes:
    """The WARC header and the HTTP header of a record."""
    revisit, same = refers_to is not None, [] if page_id is None else [("X-Page-Id", page_id)]
    same += [("X-Same-As-Page-Id", refers_to)] if revisit else []
    http = ("HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", length), *same]) + "\r\n").encode()
    out = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{date}/{place}/{page_id}')}>"), ("WARC-Date", date), ("WARC-Target-URI", _uri(url, page_id))]
    out += [("WARC-Payload-Digest", f"sha1:{base32(digest)}")]
    out += [("WARC-Refers-To-Target-URI", _uri(refers_url, refers_to)), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)] if revisit else []
    return header([*out, ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + (0 if revisit else length))]) + http


def write(pages: DataFrame, path: str | None = None, least: int = 0, chunk: int = CHUNK, date: str = "2024-01-01T00:00:00Z") -> str:
    """pages: page_id, url, html (text or bytes). Returns the folder of the chunk table (Parquet)."""
    spark = pages.sparkSession
    ready(spark)
    path = path or scratch(spark)
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    keyed = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    keys = table(keyed.where(F.length("payload") >= least).select("page_id", "digest", "url"))
    first = keys.where("page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("copies"))
    revisits = keys.select("page_id", "digest").join(table(first.where("copies > 1")), "digest")
    revisits = table(revisits.where("page_id <> first_id").select("page_id", "digest", "first_id", "first_url").distinct())
    if revisits.count() <= BROADCAST_ROWS:
        revisits = F.broadcast(revisits)
    rows = keyed.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "payload", "first_id", F.unhex("digest").alias("digest"), "first_url")

    def run(batches):
        archive, record = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[tuple] = []
            held = 0
            ids, urls, refers, digests, others = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i, value in enumerate(batch.column(2)):
                view = memoryview(value.as_buffer())
                head = _head((archive, record), ids[i], urls[i], refers[i], others[i], len(view), digests[i], date)
                if refers[i] is not None:
                    view = view[:0]
                out.append((archive, record, 0, False, head, hashlib.sha1().digest()))
                sofar, number = hashlib.sha1(), 1
                for at in range(0, len(view), chunk):
                    sofar.update(view[at : at + chunk])
                    out.append((archive, record, number, False, view[at : at + chunk], sofar.digest()))
                    number, held = number + 1, held + chunk
                    if held > 8 << 20:
                        yield _rows(out)
                        out, held = [], 0
                out.append((archive, record, number, True, END, sofar.digest()))
                record, held = record + 1, held + len(head)
            yield _rows(out)

    rows.mapInArrow(run, CHUNKS).write.option("compression", "zstd").parquet(path)
    return path


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
    cols = list(zip(*out, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["archive", "record", "chunk", "last", "bytes", "sha1"])


FOUND = "archive int, record long, whole boolean, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, valid boolean"
_kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]


def _id(field: str | None) -> int | None:
    return int(field) if field else None


def _read(batches):
    """Runs of chunk rows in order; a run that lacks its first or last chunk is reported as not whole."""
    key, expect, head, sha, length, ok = None, 0, None, None, 0, True
    out: list[tuple] = []

    def cut() -> None:
        if key is not None:
            out.append((*key, False, *(None,) * 5, False))

    for batch in batches:
        archives, records, chunks, lasts, sums = (batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5))
        for i, data in enumerate(batch.column(4)):
            if chunks[i] == 0:
                cut()
                outer, _, inner = data.as_py().partition(b"\r\n\r\n")
                key, expect, sha, length, ok = (archives[i], records[i]), 1, hashlib.sha1(), 0, True
                head = parse_header(outer) | {f"http {k}": v for k, v in parse_header(inner).items()} | {"http": len(inner)}
                continue
            if key != (archives[i], records[i]) or chunks[i] != expect:
                cut()
                key, head, expect = (archives[i], records[i]), None, chunks[i]
            expect += 1
            if head is not None and not lasts[i]:
                view = memoryview(data.as_buffer())
                sha.update(view)
                length += len(view)
                ok = ok and sha.digest() == sums[i]
            if lasts[i]:
                if head is None:
                    cut()
                else:
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head["http Content-Length"])
                    ok = ok and int(head["Content-Length"]) == head["http"] + length and (revisit or (digest, size) == (base32(sha.digest()), length))
                    out.append((*key, True, _id(head.get("http X-Page-Id")), size, digest if revisit else base32(sha.digest()), head["WARC-Type"], _id(head.get("http X-Same-As-Page-Id")), ok))
                key = None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])
            out = []
    cut()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: its headers, digests of what was read, and whether they agree (`valid`)."""
    ready(spark)
    chunks = spark.read.schema(CHUNKS).parquet(path)
    found = table(chunks.mapInArrow(_read, FOUND))
    apart = found.where("not whole").select("archive", "record").distinct()
    if apart.isEmpty():
        return found.drop("whole")
    again = chunks.join(apart, ["archive", "record"], "left_semi").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return found.where("whole").union(again.mapInArrow(_read, FOUND)).drop("whole")


# ---- real .warc files -----------------------------------------------------------------------------------------------


def export(spark: SparkSession, path: str, archive: int) -> Iterator[bytes]:
    """The bytes of one archive as a WARC file, chunk by chunk."""
    chunks = spark.read.schema(CHUNKS).parquet(path).where(F.col("archive") == archive).orderBy("record", "chunk")
    for row in chunks.select("bytes").toLocalIterator():
        yield bytes(row["bytes"])


def _block(stream: io.BufferedIOBase) -> bytes:
    """A header up to its empty line."""
    out = []
    while (line := stream.readline()) not in (b"\r\n", b""):
        out.append(line)
    return b"".join(out)


def parse(stream: io.BufferedIOBase, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, str]]:
    """(headers, payload length, base32 SHA-1) of each record of a WARC file, reading at most `chunk` bytes at a time.

    The payload of an HTTP message is what follows its header.
    """
    while line := stream.readline():
        if line == b"\r\n":
            continue
        head, sha = parse_header(line + _block(stream)), hashlib.sha1()
        left = int(head["Content-Length"])
        if head.get("Content-Type", "").startswith("application/http"):
            left -= len(_block(stream)) + 2
        length = left
        while left:
            data = stream.read(min(chunk, left))
            if not data:
                raise ValueError("the record ends early")
            sha.update(data)
            left -= len(data)
        yield head, length, base32(sha.digest())
