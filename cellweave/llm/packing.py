"""Packing documents into training sequences of a fixed length.

Each document is its ids and an end id. What fills a whole sequence is cut off
first; the rest is one piece. Documents are dealt to groups at random (by a hash of the
place where they were read, so repeated rows are spread too), and each group
is packed by first-fit decreasing, with a tournament tree of the bins' free space:
a node holds the largest free space below it, so the leftmost bin that fits is
found in one walk from the root. The number of groups grows with the number of
pieces, so a group's size, and with it a task's memory, stays the same (a document of
ten million tokens adds 5,000 pieces to its group).

Null or empty text: the end id alone. Null doc_id: packed like any other, with a
null doc_id. Repeated rows are separate documents. No rows: no pieces. Columns
besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import batches_of, stored, work_dir
from cellweave.llm.vocabulary import encoded_rows, library_encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED = f"{PIECES}, sequence_id bigint, offset bigint, sequence_tokens bigint, padded_tokens bigint"


class FreeSpaceTree:
    """Bins in a row, each with ``capacity`` free; :meth:`place` takes the first that has room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.most = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it is capacity minus this free space)."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < length:
                node += 1
        free = most[node]
        bin_, most[node] = node - self.leaves, free - length
        while node > 1:
            node >>= 1
            left, right = most[2 * node], most[2 * node + 1]
            now = left if left > right else right
            if most[node] == now:
                break
            most[node] = now
        return bin_, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length; ``lengths`` must be in falling order and none above ``capacity``."""
    whole = sum(1 for n in lengths if n == capacity)
    tree = FreeSpaceTree(max(1, len(lengths) - whole), capacity)
    placed = [(i, 0) for i in range(whole)]
    for n in lengths[whole:]:
        bin_, free = tree.place(n)
        placed.append((whole + bin_, capacity - free))
    return placed


def cut(docs: DataFrame, vocabulary: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of all documents: whole sequences, then the rest of each; ``place`` is where a document was read."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = library_encoder(vocabulary), end_id.to_bytes(4, "little")

        def rows() -> Iterator[tuple]:
            place = TaskContext.get().partitionId() << 40
            for doc_ids, every, ends in encoded_rows(batches, encoder):
                for doc_id, lo, hi in zip(doc_ids, [0, *ends.tolist()], ends.tolist(), strict=False):
                    ids, place = every[lo:hi].tobytes() + end, place + 1
                    for start in range(0, len(ids) // 4, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        yield doc_id, start, len(part) // 4, zlib.crc32(part), len(ids) // 4, place

        return batches_of(rows(), doc_id="int64", start="int64", length="int64", ids_crc32="int64", doc_tokens="int64", place="int64")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(pieces, f"{PIECES}, place bigint")


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, group_pieces: int = 32_768, seed: int = 11) -> DataFrame:
    """One row per piece: where it stands in its document (start, length) and in its sequence (sequence_id, offset).

    ``sequence_tokens`` is what the sequence holds and ``padded_tokens`` its length
    with padding, which is ``capacity`` unless it holds a power of two.
    """
    spark = docs.sparkSession
    pieces = stored(cut(docs, vocabulary, capacity, end_id), f"{work_dir(spark, 'packing')}/pieces")
    groups = -(-pieces.count() // group_pieces) or 1

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("place", "ascending")])
        lengths = group["length"].to_numpy()
        bins, offsets = np.array(first_fit_decreasing(lengths.tolist(), capacity), np.int64).T
        held = np.bincount(bins, lengths).astype(np.int64)[bins]
        added = {
            "sequence_id": bins * groups + key[0].as_py(),
            "offset": offsets,
            "sequence_tokens": held,
            "padded_tokens": np.where(held & (held - 1), capacity, held),
        }
        for name, values in added.items():
            group = group.append_column(name, pa.array(values))
        return group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", *added])

    dealt = F.pmod(F.xxhash64("place", F.lit(seed)), F.lit(groups)).alias("pack_group")
    return pieces.groupBy(dealt).applyInArrow(packed, PACKED)
