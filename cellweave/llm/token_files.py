"""Token files: concatenated ids with Elias-Fano coded document boundaries.

A file holds, in this order: ``MAGIC``; the ids of its documents one after the
other, little-endian, 2 bytes each if the vocabulary's largest id and the end id fit and else 4; the
end of each document (its number of ids and of those before it) as an Elias-Fano
sequence; the documents' ids less the smallest as another; a JSON footer; the
footer's length as 4 bytes; ``MAGIC``.

An Elias-Fano sequence keeps the low bits of each value in a packed array and the
high parts as a bit vector with a one for each value. The position of every 256th
one is kept, so ``select`` reads a few bytes from the nearest one to give a boundary: about
``2 + log2(ids / documents)`` bits a document instead of 64. Readers take their boundaries by ``select``
for ``BLOCK`` documents at a time; no table of all of them is made.

Files are written in ascending doc_id order over a range partitioning, each by one
streaming task that holds no more than the boundaries; a manifest row names each
file, and only files in the manifest are read. Null doc_ids come first and stand
in the files as a count. Null text: no ids but the end id. Rows that share a
doc_id are ordered by a hash of their text. No rows: no files.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm._shared import attempt_file, batch_of, batches_of, opened, rows_in, stored, work_dir
from cellweave.llm.vocabulary import encoded_rows, library_encoder

MAGIC, SAMPLE, BLOCK = b"CWTOKEN1", 256, 4096
MANIFEST = "part int, file string, documents bigint, ids bigint"
TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.ones = count, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits:
            each = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(each.astype(np.uint8).ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        marks[at] = 1
        return cls(n, bits, low, np.packbits(marks, bitorder="little"), at[::SAMPLE].astype("<u8"))

    def select(self, first: int, end: int | None = None):
        """Value ``first``, or values ``first`` to before ``end``: from the nearest kept one, over the bytes up to the last wanted one."""
        if end is None:
            return int(self.select(first, first + 1)[0])
        if not 0 <= first < end <= self.count:
            raise IndexError((first, end))
        kept = first // SAMPLE
        begin = int(self.ones[kept])
        after = -(-end // SAMPLE)
        stop = int(self.ones[after]) + 1 if after < len(self.ones) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8 : (stop + 7) // 8], bitorder="little")
        bits[: begin % 8] = 0
        at = np.flatnonzero(bits)[first - kept * SAMPLE : end - kept * SAMPLE] + begin // 8 * 8
        high = (at - np.arange(first, end)).astype(np.uint64)
        if not (width := self.low_bits):
            return high
        from_bit = first * width
        low = np.unpackbits(self.low[from_bit // 8 : (end * width + 7) // 8], bitorder="little")[from_bit % 8 :]
        each = low[: (end - first) * width].reshape(-1, width).astype(np.uint64)
        return (high << np.uint64(width)) | (each << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def parts(self) -> tuple[dict, bytes]:
        held = [self.low.tobytes(), self.high.tobytes(), self.ones.tobytes()]
        return {"count": self.count, "low_bits": self.low_bits, "sizes": [len(x) for x in held]}, b"".join(held)

    @classmethod
    def read(cls, about: dict, data: bytes) -> EliasFano:
        a, b, _ = about["sizes"]
        return cls(about["count"], about["low_bits"], np.frombuffer(data[:a], np.uint8), np.frombuffer(data[a : a + b], np.uint8), np.frombuffer(data[a + b :], "<u8"))


class TokenWriter:
    """Documents, in ascending order of their ids, to one file; raises for an id that ``id_bytes`` can't hold."""

    def __init__(self, uri: str, id_bytes: int):
        system, path = opened(uri)
        self.out, self.id_bytes, self.written = system.open_output_stream(path, compression=None), id_bytes, 0
        self.ends, self.names, self.unnamed = array("q"), array("q"), 0
        self.out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.id_bytes < 4 and len(ids) and int(ids.max()) >> (8 * self.id_bytes):
            raise ValueError(f"id {int(ids.max())} in {self.id_bytes} bytes")
        self.out.write(ids.astype(f"<u{self.id_bytes}").tobytes())
        self.written += len(ids)
        self.ends.append(self.written)
        if doc_id is None:
            self.unnamed += 1
        else:
            self.names.append(doc_id)

    def close(self) -> None:
        ends, data = EliasFano.of(np.array(self.ends, np.uint64)).parts()
        first = self.names[0] if self.names else 0
        names, more = EliasFano.of(np.array(self.names, np.int64).astype(np.uint64) - np.array(first, np.int64).astype(np.uint64)).parts()
        footer = json.dumps({"id_bytes": self.id_bytes, "ids": self.written, "unnamed": self.unnamed, "first": first, "ends": ends, "names": names}).encode()
        self.out.write(data + more + footer + len(footer).to_bytes(4, "little") + MAGIC)
        self.out.close()


class TokenFile:
    """A file of :class:`TokenWriter`, of which only the footer is held."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.data = system.open_input_file(path)
        size = self.data.size()
        tail = self.data.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"no token file: {uri}")
        length = int.from_bytes(tail[:4], "little")
        self.about = json.loads(self.data.read_at(length, size - 12 - length))
        a, b = (sum(self.about[k]["sizes"]) for k in ("ends", "names"))
        at = len(MAGIC) + self.about["ids"] * self.about["id_bytes"]
        self.ends = EliasFano.read(self.about["ends"], self.data.read_at(a, at))
        self.names = EliasFano.read(self.about["names"], self.data.read_at(b, at + a))

    def ids(self, first: int, end: int) -> np.ndarray:
        width = self.about["id_bytes"]
        return np.frombuffer(self.data.read_at((end - first) * width, len(MAGIC) + first * width), f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        """The ids of the ``i``-th document."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def documents(self, run: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in this file, its ids) of each; reads about ``run`` ids at a time."""
        start, unnamed = 0, self.about["unnamed"]
        for lo in range(0, self.ends.count, BLOCK):
            hi = min(lo + BLOCK, self.ends.count)
            ends = [start, *self.ends.select(lo, hi).astype(np.int64).tolist()]
            names = [None] * max(0, min(hi, unnamed) - lo)
            if hi > unnamed:
                names += (self.names.select(max(0, lo - unnamed), hi - unnamed).astype(np.int64) + self.about["first"]).tolist()
            i = 0
            while i < hi - lo:
                j = max(i + 1, bisect_right(ends, ends[i] + run) - 1)
                held = self.ids(ends[i], ends[j])
                for k in range(i, j):
                    yield names[k], ends[k], held[ends[k] - ends[i] : ends[k + 1] - ends[i]]
                i = j
            start = ends[-1]
        self.data.close()


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write the ids of all documents below ``folder``; the manifest, a stored table with a row per file in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, uri = library_encoder(vocabulary), None, ""
        id_bytes = 2 if max(encoder.largest_id, end_id) < 1 << 16 else 4
        end = np.array([end_id], "<u4")
        for doc_ids, ids, ends in encoded_rows(batches, encoder):
            for doc_id, lo, hi in zip(doc_ids, [0, *ends.tolist()], ends.tolist(), strict=False):
                if writer is None:
                    writer = TokenWriter(uri := attempt_file(f"{folder}/files", ".tok"), id_bytes)
                writer.add(doc_id, np.concatenate((ids[lo:hi], end)))
        if writer is not None:
            writer.close()
            yield batch_of([(TaskContext.get().partitionId(), uri, len(writer.ends), writer.written)], part="int32", file="string", documents="int64", ids="int64")

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return stored(ordered.mapInArrow(write, MANIFEST), f"{folder}/manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: its global start, number of ids, and their CRC as 32-bit integers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for uri, before in rows_in(batches, "file", "before"):
                for doc_id, start, ids in TokenFile(uri).documents():
                    yield doc_id, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

        return batches_of(rows(), doc_id="int64", start="int64", n_tokens="int64", ids_crc32="int64")

    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    files = manifest.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    return files.repartition(max(1, manifest.count())).mapInArrow(read, TOKENS)


def token_files(docs: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Write and read back."""
    return read_tokens(write_tokens(docs, work_dir(docs.sparkSession, "tokens"), vocabulary, end_id))
