"""WARC archives: one gzip member per record, written and read as Spark jobs.

An archive is a file of a few megabytes, so that a reader holds one archive and inflates it piece by piece.
Archives are written by Spark's own file writer and so go to any store, with its commit protocol. It ends each
file with the separator it is given, which is an empty gzip member and holds no record.
"""

from __future__ import annotations

import base64
import hashlib
import string
import urllib.parse
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treespark.llm.common import attach, stored
from treespark.session import scratch_path

ARCHIVE_BYTES = 4 << 20
LEAST_REVISITED = 1000
CHUNK = 1 << 16
DATE = "1970-01-01T00:00:00Z"
NAME = "urn:treespark:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URI_SAFE = "".join(c for c in string.printable if not c.isspace())
EMPTY_MEMBER = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
RECORD = (
    "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, "
    "verified boolean, payload binary")


def planned(pages: DataFrame, least: int = LEAST_REVISITED) -> DataFrame:
    """(page_id, url, payload, payload_digest, refers_to): which record another one repeats.

    Of equal payloads of at least ``least`` bytes that with the largest page_id is the response and the others
    refer to it. Only digests are grouped; a payload that a third of all pages share is dealt over all tasks.
    """
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload"))
    groups = stored(
        rows.where(F.length("payload") >= least).groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1"))
    told = attach(rows, groups, "payload_digest", "copies", F.struct("page_id", "url"))
    repeats = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return told.select(
        "page_id", "url", F.when(~repeats, F.col("payload")).alias("payload"), F.length("payload").alias("size"),
        "payload_digest", F.when(repeats, F.col("first_id")).alias("refers_to"))


def labelled(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_of(page_id, url, payload, size: int, payload_digest: str, refers_to) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP head only, which still tells the length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{NAME}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", urllib.parse.quote(url or "about:blank", safe=URI_SAFE)),
        ("WARC-Payload-Digest", labelled(bytes.fromhex(payload_digest))),
        ("WARC-Block-Digest", labelled(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{NAME}{refers_to}>")]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(lines.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives of about ``ARCHIVE_BYTES`` from planned records, one row each."""
    def packed(parts: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["content"])

    parts, held = [], 0
    for batch in batches:
        columns = [batch.column(n) for n in ("page_id", "url", "payload", "size", "payload_digest", "refers_to")]
        for i in range(batch.num_rows):
            parts.append(record_of(*[c[i].as_py() for c in columns]))
            held += len(parts[-1])
            if held >= ARCHIVE_BYTES:
                yield packed(parts)
                parts, held = [], 0
    if parts:
        yield packed(parts)


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_REVISITED) -> None:
    """A WARC record per row of ``pages`` (page_id, url, html) into gzipped archives in ``folder``.

    A null html is an empty payload, a null url ``about:blank``; rows that repeat a page_id give a record each.
    A null page_id is written as an empty name. An empty table gives archives without records, or none.
    """
    rows = planned(pages, least).mapInArrow(archives, "content binary")
    text = rows.select(F.col("content").cast("string").alias("value"))
    (text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("maxRecordsPerFile", 1).text(folder))


class Member:
    """Reads one gzip member, inflated piece by piece."""

    def __init__(self, data: memoryview, at: int):
        self.data, self.at, self.z, self.held = data, at, zlib.decompressobj(31), bytearray()

    def more(self) -> bool:
        """Inflate some more; false at the end of the member."""
        if self.z.eof:
            return False
        source = self.z.unconsumed_tail
        if not source:
            source = self.data[self.at : self.at + CHUNK]
            self.at += len(source)
            if not source:
                raise ValueError("a gzip member is cut off")
        self.held += self.z.decompress(source, CHUNK)
        return True

    def end(self) -> int:
        """The place after the member."""
        while self.more():
            self.held.clear()
        return self.at - len(self.z.unused_data)

    def until(self, mark: bytes) -> bytes | None:
        """What stands before ``mark``, which is read too; nothing if the member is empty."""
        seen = 0
        while (cut := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if not self.more():
                if self.held:
                    raise ValueError("a record ends inside its header")
                return None
        found = bytes(self.held[:cut])
        del self.held[: cut + len(mark)]
        return found

    def take(self, length: int) -> Iterator[bytes]:
        """The next ``length`` bytes in pieces."""
        while length:
            if not self.held and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece = bytes(self.held[:length])
            del self.held[:length]
            length -= len(piece)
            if piece:
                yield piece


def fields_of(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def number(name: str) -> int | None:
    found = name.strip("<>").removeprefix(NAME)
    return int(found) if found.lstrip("-").isdigit() else None


def records(data: memoryview, with_payload: bool) -> Iterator[tuple]:
    """The response and revisit records of an archive, in order."""
    at = 0
    while at < len(data):
        member = Member(data, at)
        head = member.until(b"\r\n\r\n")
        if head is not None:
            if not head.startswith(b"WARC/1."):
                raise ValueError(f"no WARC record at byte {at}")
            fields = fields_of(head)
            block, payload, http, body, size = hashlib.sha1(), hashlib.sha1(), None, [], 0
            start = bytearray()
            for piece in member.take(int(fields["content-length"])):
                block.update(piece)
                if http is None:
                    start += piece
                    cut = start.find(b"\r\n\r\n")
                    if cut < 0:
                        continue
                    http, piece = fields_of(bytes(start[:cut])), bytes(start[cut + 4 :])
                payload.update(piece)
                size += len(piece)
                if with_payload:
                    body.append(piece)
            if b"".join(member.take(4)) != b"\r\n\r\n":
                raise ValueError(f"the record at byte {at} is not ended")
            kind = fields.get("warc-type")
            if kind in ("response", "revisit"):
                stated = fields.get("warc-payload-digest", "")
                right = labelled(block.digest()) == fields.get("warc-block-digest", labelled(block.digest()))
                length = int((http or {}).get("content-length", size))
                if kind == "response":
                    right = right and stated == labelled(payload.digest()) and length == size
                yield (
                    number(fields.get("warc-record-id", "")), length, base64.b32decode(stated.removeprefix("sha1:")).hex(), kind,
                    number(fields.get("warc-refers-to", "")), fields.get("warc-target-uri"), right,
                    b"".join(body) if with_payload and kind == "response" else None)
        at = member.end()


def read_batches(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        for content in batch.column("content"):
            rows = []
            for row in records(memoryview(content.as_buffer()), with_payload):
                rows.append(row)
                if len(rows) == 1000 or row[-1] and len(row[-1]) > ARCHIVE_BYTES:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def read_warc(archived: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row per response or revisit record of ``archived``, a table with the archives' ``content``.

    ``spark.read.format("binaryFile")`` gives such a table. Records are framed by their Content-Length.
    ``verified`` tells whether the block digest, and for responses the payload digest and length, are right. The
    length and digest of a revisit are those of the payload it refers to. A damaged archive raises an error.
    """
    rows = archived.select(F.col("content").cast("binary").alias("content"))
    return rows.mapInArrow(lambda batches: read_batches(batches, with_payload), RECORD)


def round_trip(pages: DataFrame, with_payload: bool = False) -> DataFrame:
    """``pages`` written to archives in the shared folder and read back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark.read.format("binaryFile").load(folder), with_payload)
