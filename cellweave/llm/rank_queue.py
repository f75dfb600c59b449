"""Byte-level BPE by a queue of merge ranks over hierarchical bitmaps.

Every adjacent pair of a pre-token that can merge waits in the bucket of its rank.
A bitmap has a bit for each rank whose bucket is not empty, in words of 256 bits, and the level above
has a bit for each word that is not zero, so the smallest rank is found
by two find-first-set steps. A bucket gives its positions from left to right. A merge
changes the linked list of parts and queues the two new pairs, which are longer and so of other ranks;
what the old pairs left in the buckets is stale, shown by the rank noted at the position, and skipped.
A pre-token of n bytes costs O(n log n) whatever its length.

Null text: no ids, and the digests of no bytes. Null doc_id is kept. Repeated rows
give repeated results; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import batches_of, opened
from cellweave.llm.vocabulary import PieceEncoder, encoded_rows

DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Positions by rank."""

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.buckets:
            self.buckets[rank].append(position)
            return
        self.buckets[rank] = [position]
        high = rank >> 8
        self.words[high] |= 1 << (rank & 255)
        self.top |= 1 << high

    def pop(self) -> tuple[int, list[int]]:
        """The smallest rank, and its positions in order."""
        top, words = self.top, self.words
        high = (top & -top).bit_length() - 1
        word = words[high]
        first = word & -word
        words[high] = word = word ^ first
        if not word:
            self.top = top & (top - 1)
        rank = high << 8 | first.bit_length() - 1
        positions = self.buckets.pop(rank)
        positions.sort()
        return rank, positions


class RankEncoder(PieceEncoder):
    """Encodes and decodes with the ranks of a tiktoken file."""

    def __init__(self, path: str):
        system, name = opened(path)
        with system.open_input_stream(name, compression=None) as f:
            lines = f.read().split(b"\n")
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        bytes_of = {b: a for a, b in self.ranks.items()}
        self.largest_id = max(bytes_of)
        self.bytes_of = pa.array([bytes_of.get(i) for i in range(self.largest_id + 1)], pa.large_binary())
        self.longest = max(map(len, self.ranks))
        self.queue = RankQueue(self.largest_id)
        super().__init__(lambda word: array("I", self.pretoken(word.encode())).tobytes())

    def pretoken(self, word: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        ranks, n = self.ranks, len(word)
        if (known := ranks.get(word)) is not None:
            return [known]
        queue, longest, get = self.queue, self.longest, ranks.get
        push, pop = queue.push, queue.pop
        after, before = list(range(1, n + 2)), list(range(-1, n))
        waits = [-1] * n  # the rank that each part's pair with the next one waits at
        for i in range(n - 1):
            if (rank := get(word[i : i + 2])) is not None:
                waits[i] = rank
                push(rank, i)
        while queue.top:
            rank, positions = pop()
            for i in positions:
                if waits[i] != rank:
                    continue
                gone = after[i]
                end = after[gone]
                waits[gone] = waits[i] = -1
                after[i] = end
                if end < n:
                    before[end] = i
                    if after[end] - i <= longest and (new := get(word[i : after[end]])) is not None:
                        waits[i] = new
                        push(new, i)
                if (left := before[i]) >= 0:
                    waits[left] = -1
                    if end - left <= longest and (new := get(word[left:end])) is not None:
                        waits[left] = new
                        push(new, left)
        ids, i = [], 0
        while i < n:
            ids.append(ranks[word[i : after[i]]])
            i = after[i]
        return ids

    def decode(self, ids: bytes) -> bytes:
        data, ends = self.decode_all(np.frombuffer(ids, "<u4"))
        return data[: ends[-1]].tobytes()

    def decode_all(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes of all ids, where each id's begin and the last one's end)."""
        told = self.bytes_of.take(pa.array(ids))
        if told.null_count:
            raise KeyError("an id that the vocabulary lacks")
        _, places, data = told.buffers()
        places = np.frombuffer(places, np.int64)[told.offset : told.offset + len(told) + 1]
        return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), places


@lru_cache(maxsize=2)
def rank_encoder(path: str) -> RankEncoder:
    """One for each Python worker and vocabulary file."""
    return RankEncoder(path)


def encode_documents(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Per document the number of ids, a digest of them and one of what they decode to; with ``with_ids`` also the ids."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = rank_encoder(vocabulary)

        def rows() -> Iterator[tuple]:
            for doc_ids, ids, ends in encoded_rows(batches, encoder):
                data, places = encoder.decode_all(ids)
                for doc_id, lo, hi in zip(doc_ids, [0, *ends.tolist()], ends.tolist(), strict=False):
                    own = ids[lo:hi].tobytes()
                    row = (doc_id, hi - lo, hashlib.sha256(own).hexdigest(), hashlib.sha256(data[places[lo] : places[hi]]).hexdigest())
                    yield (*row, own) if with_ids else row

        return batches_of(rows(), 1024, doc_id="int64", n_tokens="int64", ids_sha256="string", decoded_sha256="string", **{"ids": "binary"} if with_ids else {})

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(encode, DIGESTS + ", ids binary" * with_ids)
