"""One document of each group of near copies: texts of which 0.8 of the five-word shingles are shared.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle is a 64-bit hash of
``WORDS`` words in a row (of all words, if there are fewer; a text without words has no shingle). Two texts are linked where
the Jaccard similarity of their sets of shingles is at least ``PARTS / WHOLE``. No pair within that is left out:

1. Texts with the same set are one node. SimHash fingerprints of the same shingles (operator 4's bit-sliced search)
   give a first lot of candidates, those within four bits.
2. At 0.8, two sets of 64-bit fingerprints are apart by about ten bits and often more, a radius at
   which blocks select nothing. The rest is found by prefixes: in any common order of shingles, sets so
   alike share one of the first n - ceil(0.8 n) + 1. Shingles that are frequent in a sample of the texts
   are put last, which keeps the groups of a shingle small; the order changes the work and not the result. At the first
   shingle that two sets share, what is left of each from there on must be enough for the similarity; where it is not, the pair is not made.
3. A few members of each group, those whose shingles are shared most, are compared with all of it. Then pairs of a group that are not
   yet in the same component are compared too.
4. Candidates are first compared by sketches: the shingles counted in about a quarter as many cells as there are shingles.
   What two sketches have in common, cell by cell, is never less than what the sets share, so a pair that
   falls short is no link. Whole sets are made from the texts of the pairs that are left.

So the pairs of a large group of copies are never all made, unless its members are not linked.

Null text has no words. Rows without doc_id are linked like others and stay only if their component has no doc_id.
Repeated rows leave one. Other columns may have any names. No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm import simhash
from cellweave.llm._shared import fresh, give_back, stored, work_dir
from cellweave.llm.components import connected
from cellweave.llm.rank_queue import rank_encoder
from cellweave.llm.vocabulary import library_encoder

WORDS = 5
PARTS, WHOLE = 4, 5
#: One text of so many is in the sample; a shingle in as many of its texts is frequent, and so many of these are told to executors.
SAMPLE, FREQUENT, TOLD = 8, 3, 200_000
#: Members of a group that are compared with all of it at first.
PIVOTS = 3
#: Rows (a doc_id and a hash each, or a node) up to which documents to drop or nodes to verify are sent to all executors; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of texts that are hashed at once.
SLAB = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _step(held: np.ndarray, word: np.ndarray) -> np.ndarray:
    held = (held ^ word) * _MIX
    return held ^ (held >> np.uint64(29))


def _hashed(texts: pa.Array) -> Iterator[np.ndarray]:
    """The shingles of each text, repeats included."""
    import xxhash

    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, places, data = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(places, places[i] + SLAB, side="right")) - 1)
        part = _LOWER[whole[places[i] : places[j]]]
        solid = ~_BLANK[part]
        begins = solid.copy()  # a word begins behind white space, or where a text does
        begins[1:] &= ~solid[:-1]
        starts = (places[i:j] - places[i])[places[i:j] < places[j]]
        begins[starts] = solid[starts]
        begin = np.flatnonzero(begins)
        solids = np.cumsum(solid, dtype=np.int64 if len(part) >> 31 else np.int32)
        offsets = np.append(solids[begin] - 1, solids[-1] if len(solids) else 0).astype(np.int64)
        held = np.ascontiguousarray(part[solid])
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(held)]).dictionary_encode()
        told = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
        word = told[words.indices.to_numpy()]
        ends = np.searchsorted(begin, places[i + 1 : j + 1] - places[i]).tolist()
        rolled = np.zeros(max(0, len(word) - WORDS + 1), np.uint64)
        for k in range(WORDS):
            rolled = _step(rolled, word[k : k + len(rolled)])
        for lo, hi in zip([0, *ends], ends, strict=False):
            if hi - lo >= WORDS:
                yield rolled[lo : hi - WORDS + 1]
            else:
                short = np.full(min(1, hi - lo), WORDS, np.uint64)
                for k in range(lo, hi):
                    short = _step(short, word[k : k + 1])
                yield short
        i = j


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The set of each text's shingles, in order."""
    return [np.unique(x) for x in _hashed(texts)]


def _sketch(shingles: np.ndarray) -> bytes:
    cells = 1 << max(3, (len(shingles) // 4).bit_length())
    counts = np.bincount((shingles & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else b""  # no bound


def _bound(a: bytes, b: bytes) -> float:
    """At least what two sets share."""
    if not a or not b:
        return float("inf")
    one, two = (np.frombuffer(x, np.uint8).astype(np.int64) for x in (a, b))
    cells = min(len(one), len(two))
    return int(np.minimum(one.reshape(-1, cells).sum(0), two.reshape(-1, cells).sum(0)).sum())


def _batches(rows: Iterator[tuple], size: int, kinds: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds.values(), strict=True)], names=list(kinds))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows. A worker that has encoded before lets go of its vocabularies, and in the end of free memory."""
    library_encoder.cache_clear()
    rank_encoder.cache_clear()
    give_back()
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)
    give_back()


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, told, node, fingerprint, size, sketch, text) of each row: told is a hash of the text and node one of its shingles."""
    kinds = {"doc_id": pa.int64(), "told": pa.int64(), "node": pa.int64(), "fingerprint": pa.int64(), "size": pa.int32(), "sketch": pa.binary(), "text": pa.string()}

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        def signed(value: int) -> int:
            return value - (value >> 63 << 64)

        def rows() -> Iterator[tuple]:
            for batch in _slices(batches):
                doc_ids, told, texts = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "told", "text"))
                for doc_id, hashed, every, text in zip(doc_ids.to_pylist(), told.to_pylist(), _hashed(texts), texts, strict=True):
                    own = np.unique(every)
                    yield doc_id, hashed, signed(xxhash.xxh64_intdigest(own.tobytes(), 42)), signed(simhash.majority(every)), len(own), _sketch(own), text.as_py()

        return _batches(rows(), 512, kinds)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("told"), "text")
    return rows.mapInArrow(mark, "doc_id bigint, told bigint, node bigint, fingerprint bigint, size int, sketch binary, text string")


def _frequent(marks: DataFrame) -> np.ndarray:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = shingle_sets(batch.column(0))
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    some = marks.where(F.pmod("node", F.lit(SAMPLE)) == 0).select("text").mapInArrow(each, "shingle bigint")
    often = some.groupBy("shingle").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "shingle").limit(TOLD)
    return np.sort(often.select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64)) if not often.isEmpty() else np.zeros(0, np.uint64)


def _prefixes(marks: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(shingle, node, size, place) of the first shingles of each node, in their order; a task tells a node once."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            new = []
            for i, node in enumerate(batch.column(0).to_pylist()):
                if node not in seen:
                    seen.add(node)
                    new.append(i)
            nodes, texts = (batch.column(k).take(pa.array(new, pa.int64())) for k in (0, 1))
            sets = shingle_sets(texts)
            sizes = np.array([len(x) for x in sets], np.int64)
            if not sizes.sum():
                continue
            every = np.concatenate(sets)
            at = np.minimum(np.searchsorted(frequent, every), max(0, len(frequent) - 1))
            late = np.split(frequent[at] == every if len(frequent) else np.zeros(len(every), bool), np.cumsum(sizes)[:-1])
            counts = np.where(sizes > 0, sizes - -(-PARTS * sizes // WHOLE) + 1, 0)
            out = [np.concatenate([x[~z], x[z]])[:k] for x, z, k in zip(sets, late, counts.tolist(), strict=True)]
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            arrays = np.concatenate(out).view(np.int64), np.repeat(nodes.to_numpy(), counts), np.repeat(sizes.astype(np.int32), counts), place.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["shingle", "node", "size", "place"])

    return marks.select("node", "text").mapInArrow(first, "shingle bigint, node bigint, size int, place int")


def _verified(pairs: DataFrame, nodes: DataFrame, marks: DataFrame, path: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets are alike enough."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, one, two, m, n = (batch.column(i).to_pylist() for i in range(6))
            good = [(PARTS + WHOLE) * _bound(s, t) >= PARTS * (j + k) for s, t, j, k in zip(one, two, m, n, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches, 256):
            one, two = (shingle_sets(part.column(k)) for k in (2, 3))
            good = [(PARTS + WHOLE) * len(np.intersect1d(x, y, assume_unique=True)) >= PARTS * (len(x) + len(y)) for x, y in zip(one, two, strict=True)]
            yield part.select([0, 1]).filter(pa.array(good, pa.bool_()))

    told = [nodes.select(F.col("node").alias(x), F.col("sketch").alias(f"_{x}"), F.col("size").alias(f"size_{x}")) for x in "ab"]
    sketched = pairs.join(told[0], "a").join(told[1], "b").select("a", "b", "_a", "_b", "size_a", "size_b")
    left = stored(sketched.mapInArrow(near, "a bigint, b bigint"), f"{path}-pairs")
    needed = stored(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), f"{path}-nodes")
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = stored(marks.select("node", "text").join(few, "node", "left_semi").groupBy("node").agg(F.max("text").alias("text")), f"{path}-texts")
    one, two = (texts.select(F.col("node").alias(x), F.col("text").alias(f"_{x}")) for x in "ab")
    return stored(left.join(one, "a").join(two, "b").select("a", "b", "_a", "_b").mapInArrow(alike, "a bigint, b bigint"), f"{path}-links")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(marks: DataFrame, folder: str) -> DataFrame:
    """(node, label) of the nodes that have links; ``marks`` as :func:`_marks` has them, stored."""
    rest_of = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place"))
    near = (F.least("size", "_size") * WHOLE >= F.greatest("size", "_size") * PARTS) & (rest_of * (PARTS + WHOLE) >= (F.col("size") + F.col("_size")) * PARTS)
    nodes = stored(marks.groupBy("node").agg(F.min("fingerprint").alias("fingerprint"), F.min("size").alias("size"), F.min("sketch").alias("sketch")), f"{folder}/nodes")
    classes = stored(nodes.groupBy("fingerprint").agg(F.min("node").alias("first")), f"{folder}/classes")
    same = nodes.join(classes, "fingerprint").select(F.col("node").alias("x"), F.col("first").alias("y"))
    edges = stored(simhash.links(classes.select("fingerprint")), f"{folder}/close")
    ends = [classes.select(F.col("fingerprint").alias(e), F.col("first").alias(n)) for e, n in (("a", "x"), ("b", "y"))]
    close = edges.join(ends[0], "a").join(ends[1], "b").select("x", "y")
    # most shingles have one node; a window spills what it can't hold
    rows, each = _prefixes(marks, _frequent(marks)), W.partitionBy("shingle")
    groups = rows.withColumn("_low", F.min("node").over(each)).withColumn("_high", F.max("node").over(each)).where("_low < _high").drop("_low", "_high").distinct()
    groups = stored(groups, f"{folder}/groups")
    # pivots are members whose shingles are shared most, as what lies in the middle of a group of copies is near to most of it
    crowd = groups.groupBy("shingle").agg(F.count("*").alias("rows"))
    weight = groups.join(crowd, "shingle").groupBy("node").agg(F.sum("rows").alias("weight"))
    weighed = groups.join(stored(weight, f"{folder}/weights"), "node")
    ofs = [F.when(F.pmod(F.xxhash64("node"), F.lit(PIVOTS)) == i, F.struct("weight", "node", "size", "place")) for i in range(PIVOTS)]
    pivots = weighed.groupBy("shingle").agg(F.array_compact(F.array(*map(F.max, ofs))).alias("_p")).select("shingle", F.explode("_p").alias("_p"))
    pivots = pivots.select("shingle", F.col("_p.node").alias("y"), F.col("_p.size").alias("_size"), F.col("_p.place").alias("_place"))
    stars = groups.join(pivots, "shingle").where(near).select(F.col("node").alias("x"), "y")
    found = _verified(_ordered(same.union(close).union(stars)), nodes, marks, f"{folder}/first")
    labels = connected(found, f"{folder}/one")
    named = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = named.groupBy("shingle").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low < _high").select("shingle")
    named = stored(named.join(mixed, "shingle", "left_semi"), f"{folder}/mixed")
    other = named.select("shingle", F.col("node").alias("y"), F.col("size").alias("_size"), F.col("place").alias("_place"), F.col("label").alias("_label"))
    rest = named.join(other, "shingle").where((F.col("label") < F.col("_label")) & near).select(F.col("node").alias("x"), "y")
    more = _verified(_ordered(rest).join(stored(found.select("a", "b"), f"{folder}/found"), ["a", "b"], "left_anti"), nodes, marks, f"{folder}/second")
    return connected(found.union(more), f"{folder}/two")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id, one without doc_id if none has any."""
    folder = work_dir(docs.sparkSession, "near_copies")
    marks = stored(_marks(docs), f"{folder}/marks")
    labelled = marks.select("doc_id", "told", "node").join(components(marks, folder), "node", "left").withColumn("label", F.coalesce("label", "node"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "told")
    best = labelled.groupBy("label").agg(F.min(order).alias("best"))
    told, other, gone_told = fresh(docs.columns, "_told", "_other", "_gone")
    gone = labelled.join(best, "label").where(order != F.col("best")).select(F.col("doc_id").alias(other), F.col("told").alias(gone_told)).distinct()
    gone = stored(gone, f"{folder}/gone")
    few = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    rows = docs.withColumn(told, F.xxhash64("text"))
    left = rows.join(few, (rows[told] == few[gone_told]) & rows["doc_id"].eqNullSafe(few[other]), "left_anti")
    if not marks.groupBy("doc_id", "told").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", told])
    return left.drop(told)
