"""WARC archives in seekable Zstandard bundles.

Records are gathered into frames of about ``frame_bytes``; each frame is compressed
by itself, so any one can be read alone. An archive ends with a seek table in a
skippable frame (the sizes of all frames, compressed and not, as the published
seekable format has them). The index maps a record's identifier to its archive, its
frame's place and size, and its place inside the frame.

Of pages whose payloads are equal (SHA-1 and length) and at least ``revisit_bytes``
long, that with the largest page_id is written as a response and the others as
revisits of it, without the payload. Rows that share this largest page_id are all
responses. A null html is an empty payload; a null page_id can only be a response or
a revisit of a page that has an id. A null url is written as an empty target.
No rows: no archives. Other columns are not read, whatever their names.

Digests are grouped without payloads. The repeated ones are sent to all executors up to ``BROADCAST_ROWS`` rows, so payloads are
written where they are read; beyond that both sides are shuffled. A record's identifier comes from page_id and digest; where several rows
have the same of both, also from the place of the row in its task, and revisits of such a page name it by page_id alone.

Each task streams its own archives under names of its own; the index rows of
committed tasks name the archives that count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import attempt_file, batches_of, opened, rows_in, stored, work_dir

INDEX = "record_id string, page_id bigint, archive string, frame int, frame_offset bigint, frame_size bigint, record_offset bigint, record_size bigint"
RECORDS = "record_id string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
#: Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1


#: Repeated digests (some 60 bytes each) up to which they are sent to all executors.
BROADCAST_ROWS = 1_000_000


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    return f"urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}/{digest}{place}'.encode()).digest())}"


def response_of(pages: DataFrame, revisit_bytes: int, folder: str) -> DataFrame:
    """The pages with payload, its digest, the page that each refers to (null: it is a response), and whether several rows of a page have that payload."""
    told = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    told = told.select("*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("bigint").alias("bytes"))
    rows = told.groupBy("digest", "bytes", "page_id").agg(F.count("*").alias("rows"))
    every = rows.groupBy("digest", "bytes").agg(F.max("page_id").alias("first"), F.sum("rows").alias("copies"), F.max("rows").alias("most"))
    equal = every.where((F.col("most") > 1) | ((F.col("copies") > 1) & (F.col("bytes") >= revisit_bytes) & F.col("first").isNotNull()))
    equal = stored(equal.select("digest", "bytes", F.when(F.col("bytes") >= revisit_bytes, F.col("first")).alias("first"), (F.col("most") > 1).alias("shared")), f"{folder}/equal")
    few = F.broadcast(equal) if equal.count() <= BROADCAST_ROWS else equal
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    return told.join(few, ["digest", "bytes"], "left").select("page_id", "url", "payload", "digest", "bytes", refers.alias("refers_to"), F.coalesce("shared", F.lit(False)).alias("shared"))


def to_record(name: str, page_id: int | None, url: str, payload: bytes, digest: str, size: int, refers_to: int | None, refers_to_name: str | None, date: str) -> bytes:
    """A WARC/1.1 record with an HTTP block; a revisit's block has the header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<{name}>",
        "WARC-Date": date,
        "WARC-Target-URI": " ".join(url.split()),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "X-Payload-Length": size,
    }
    if page_id is not None:
        head["X-Page-ID"] = page_id
    if refers_to is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": refers_to}
        if refers_to_name is not None:
            head["WARC-Refers-To"] = f"<{refers_to_name}>"
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The header and payload of the record at ``at``, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    block = data[end + 4 : end + 4 + int(head["Content-Length"])]
    return head, block[block.index(b"\r\n\r\n") + 4 :], end + 8 + len(block)


class BundleWriter:
    """One archive."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        system, path = opened(uri)
        self.uri, self.out, self.frame_bytes = uri, system.open_output_stream(path, compression=None), frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.at, self.held, self.size, self.waiting = 0, [], 0, []

    def add(self, name: str, page_id: int | None, record: bytes) -> Iterator[tuple]:
        """Index rows of the frame that this record fills, if it does."""
        self.waiting.append((name, page_id, self.size, len(record)))
        self.held.append(record)
        self.size += len(record)
        if self.size >= self.frame_bytes:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        if self.held:
            data = self.compress(b"".join(self.held))
            self.out.write(data)
            for name, page_id, offset, size in self.waiting:
                yield name, page_id, self.uri, len(self.frames), self.at, len(data), offset, size
            self.frames.append((len(data), self.size))
            self.at, self.held, self.size, self.waiting = self.at + len(data), [], 0, []

    def close(self) -> Iterator[tuple]:
        yield from self.flush()
        table = b"".join(struct.pack("<II", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the end of the archive."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        size = f.size()
        count, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table: {uri}")
        width = 12 if flags & 0x80 else 8
        table = f.read_at(count * width, size - 9 - count * width)
    found, at = [], 0
    for i in range(count):
        packed, full = struct.unpack_from("<II", table, i * width)
        found.append((at, packed, full))
        at += packed
    return found


def write_archives(pages: DataFrame, folder: str, revisit_bytes: int = 1000, frame_bytes: int = 1 << 18, archive_bytes: int = 1 << 28, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages below ``folder``; the index, a stored table with a row per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            bundle, task = None, TaskContext.get().partitionId()
            for i, (page_id, url, payload, digest, size, refers_to, shared) in enumerate(rows_in(batches, "page_id", "url", "payload", "digest", "bytes", "refers_to", "shared")):
                bundle = bundle or BundleWriter(attempt_file(f"{folder}/archives", ".warc.zst"), frame_bytes, level)
                name = record_id(page_id, digest, f"/{task}/{i}" if shared else "")
                target = record_id(refers_to, digest) if refers_to is not None and not shared else None
                yield from bundle.add(name, page_id, to_record(name, page_id, url, payload, digest, size, refers_to, target, date))
                if bundle.at >= archive_bytes:
                    yield from bundle.close()
                    bundle = None
            if bundle is not None:
                yield from bundle.close()

        return batches_of(rows(), record_id="string", page_id="int64", archive="string", frame="int32", frame_offset="int64", frame_size="int64", record_offset="int64", record_size="int64")

    return stored(response_of(pages, revisit_bytes, folder).mapInArrow(write, INDEX), f"{folder}/index")


def _told(head: dict[str, str], payload: bytes, with_payload: bool) -> tuple:
    number = lambda k: int(head[k]) if k in head else None
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != number("X-Payload-Length")):
        raise ValueError(f"a payload differs from its digest: {head['WARC-Record-ID']}")
    row = (head["WARC-Record-ID"].strip("<>"), number("X-Page-ID"), head["WARC-Target-URI"], head["WARC-Type"], number("X-Payload-Length"), digest, number("X-Refers-To-Page-ID"))
    return (*row, payload if with_payload and head["WARC-Type"] == "response" else None)


_KINDS = {"record_id": "string", "page_id": "int64", "url": "string", "record_type": "string", "payload_bytes": "int64", "payload_digest": "string", "refers_to": "int64", "payload": "binary"}


def read_archives(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of the index's archives, found by the seek tables; a payload's digest is computed again."""
    spark = index.sparkSession

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((uri, at, packed) for (uri,) in rows_in(batches, "archive") for at, packed, _ in seek_table(uri))
        return batches_of(rows, archive="string", at="int64", packed="int64")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for uri, at, packed in rows_in(batches, "archive", "at", "packed"):
                system, path = opened(uri)
                with system.open_input_file(path) as f:
                    data, place = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at)), 0
                while place < len(data):
                    head, payload, place = parsed(data, place)
                    yield _told(head, payload, with_payload)

        return batches_of(rows(), 256 if with_payload else 4096, **_KINDS)

    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    archives = index.select("archive").distinct()
    return archives.mapInArrow(frames, "archive string, at bigint, packed bigint").repartition(width).mapInArrow(read, RECORDS)


def look_up(index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records that ``record_ids`` (column record_id) names, each read from its own frame alone, payload included."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for uri, at, packed, offset in rows_in(batches, "archive", "frame_offset", "frame_size", "record_offset"):
                system, path = opened(uri)
                with system.open_input_file(path) as f:
                    data = zstandard.ZstdDecompressor().decompress(f.read_at(packed, at))
                head, payload, _ = parsed(data, offset)
                yield _told(head, payload, True)

        return batches_of(rows(), 64, **_KINDS)

    return index.join(record_ids.select("record_id").distinct(), "record_id").mapInArrow(read, RECORDS)


def archived(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write and read back: page_id, payload_bytes, payload_digest, record_type, refers_to of each record."""
    index = write_archives(pages, work_dir(pages.sparkSession, "warc"), revisit_bytes)
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
