"""Near-duplicate documents by 64-bit fingerprints, compared bit-sliced.

A fingerprint bit is set where over half of the shingles' XXH64 values have it.
Distinct fingerprints within ``radius`` bits are linked, and a document's component
is the smallest doc_id reachable.

Candidates: the 64 bits are cut into ``blocks`` blocks. Two fingerprints that differ
in at most ``radius`` bits agree on all bits of some ``blocks - radius`` blocks, so
for each such choice of blocks fingerprints are brought together by those bits; no
link is lost. The rows of many small groups are compared at once: rows are ordered
by group, the 64 bit planes are stored vertically, 64 rows to a word, and for each
distance d between rows every plane is compared with itself moved by d rows. The
differing bits of all rows are counted by carry-save adders on whole words, and
words in which all rows exceed the radius are abandoned on the way. Each task gives
back a forest over its links, not the pairs. Groups above ``tile_rows`` are cut into
parts, and each pair of parts is a group of its own.

Null text has no words, and so fingerprint zero, as has an empty one. Documents
without a doc_id link like others, but never give a component its name; a component
of such documents alone is null. Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import batches_of, rows_in, stored, work_dir
from cellweave.llm.components import connected, local_components

ONES = ~np.uint64(0)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Unsigned 64 bits."""
    import xxhash

    told = (text or "").encode().lower().split()
    if not told:
        return 0
    hashed = xxhash.xxh64_intdigest
    shingles = zip(*(told[i:] for i in range(words)), strict=False) if len(told) >= words else [told]
    return majority(np.array([hashed(b" ".join(x), seed) for x in shingles], "<u8"))


def majority(values: np.ndarray) -> int:
    """The bits that over half of the values (unsigned 64-bit integers) have; none of no values."""
    if not len(values):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 16):
        part = np.ascontiguousarray(values[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint), the latter as a signed bigint."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_in(batches, "doc_id", "text"):
                value = fingerprint(text, words, seed)
                yield doc_id, value - (value >> 63 << 64)

        return batches_of(rows(), doc_id="int64", fingerprint="int64")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(mark, "doc_id bigint, fingerprint bigint")


def _planes(values: np.ndarray) -> np.ndarray:
    """Row b holds bit b of all values, 64 to a word, with a word of zeros at the end."""
    n, words = len(values), -(-len(values) // 64) + 1
    planes = np.zeros((64, words * 8), np.uint8)
    for b in range(64):
        bits = np.packbits(((values >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little")
        planes[b, : len(bits)] = bits
    return planes.view("<u8")


def _packed(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 8, np.uint8)
    bits = np.packbits(flags, bitorder="little")
    out[: len(bits)] = bits
    return out.view("<u8")


def _moved(planes: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """Words ``at`` of the planes moved by so many rows."""
    q, s = divmod(by, 64)
    last = planes.shape[1] - 1
    low = planes[:, np.minimum(at + q, last)]
    if not s:
        return low
    return (low >> np.uint64(s)) | (planes[:, np.minimum(at + q + 1, last)] << np.uint64(64 - s))


def close_pairs(groups: np.ndarray, values: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (p, q) of values in the same group that differ in at most ``radius`` (under 8) bits.

    ``groups`` must be ordered by falling size of the group.
    """
    sizes = np.unique(groups, return_index=True, return_counts=True)
    by_start = np.argsort(sizes[1])
    counts = sizes[2][by_start]
    size_of_row = np.repeat(counts, counts)
    planes = _planes(values)
    for d in range(1, int(counts[0]) if len(counts) else 0):
        rows = int(np.searchsorted(-size_of_row, -d, side="left"))  # those in groups of over d
        if rows <= d:
            break
        words = -(-(rows - d) // 64)
        alive = _packed(groups[: rows - d] == groups[d:rows], words)
        at = np.flatnonzero(alive)
        alive = alive[at]
        one, two, four, many = (np.zeros(len(at), np.uint64) for _ in range(4))
        for first in range(0, 64, 8):
            if not len(at):
                break
            block = planes[first : first + 8]
            differ = block[:, at] ^ _moved(block, at, d)
            for i in range(0, 8, 2):  # a full adder takes two planes and the ones
                x, y = differ[i], differ[i + 1]
                half = x ^ y
                carry = (x & y) | (half & one)
                one = half ^ one
                carry2 = two & carry
                two = two ^ carry
                many |= four & carry2
                four = four ^ carry2
            total_over = many.copy()
            if radius < 7:
                total_over |= _above(one, two, four, radius)
            alive = alive & ~total_over
            if not alive.all():
                keep = np.flatnonzero(alive)
                at, alive, one, two, four, many = (z[keep] for z in (at, alive, one, two, four, many))
        if len(at):
            bits = np.unpackbits(alive.view(np.uint8).reshape(len(at), 8), axis=1, bitorder="little")
            w, b = np.nonzero(bits)
            p = at[w] * 64 + b
            yield p, p + d


def _above(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Where the counter of three bits is over ``radius``."""
    out, equal = np.zeros_like(one), np.full_like(one, ONES)
    for bit, plane in ((4, four), (2, two), (1, one)):
        if radius & bit:
            equal &= plane
        else:
            out |= equal & plane
            equal &= ~plane
    return out


def forest(groups: np.ndarray, values: np.ndarray, radius: int, held: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the same distinct values as all close pairs do."""
    _, inverse, counts = np.unique(groups, return_inverse=True, return_counts=True)
    order = np.lexsort((values, inverse, -counts[inverse]))
    groups, values = groups[order], values[order]
    nodes, node = np.unique(values, return_inverse=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def shrink() -> None:
        label = local_components(len(nodes), np.concatenate(a), np.concatenate(b))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        a[:], b[:] = [moved], [label[moved]]

    waiting = 0
    for p, q in close_pairs(groups, values, radius):
        a.append(node[p])
        b.append(node[q])
        waiting += len(p)
        if waiting >= held:
            shrink()
            waiting = 0
    shrink()
    return nodes[a[0]], nodes[b[0]]


def links(distinct: DataFrame, radius: int = 4, blocks: int = 6, cell_rows: int = 32_768, tile_rows: int = 4096) -> DataFrame:
    """(a, b): edges that connect the same fingerprints (column fingerprint, no repeats) as all links do."""
    spark = distinct.sparkSession
    folder = work_dir(spark, "simhash")
    bounds = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        masks.append(mask - (mask >> 63 << 64))
    spread = F.posexplode(F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m).cast("bigint")) for m in masks))).alias("choice", "key")
    keyed = distinct.select("fingerprint", spread)
    crowded = stored(keyed.groupBy("choice", "key").agg(F.count("*").alias("rows")).where(F.col("rows") > tile_rows), f"{folder}/crowded")
    hot = crowded.count()
    if hot:
        small = F.broadcast(crowded) if hot <= 100_000 else crowded
        keyed = keyed.join(small, ["choice", "key"], "left")
        parts = F.ceil(F.coalesce(F.col("rows"), F.lit(1)) / tile_rows).cast("int")
        keyed = keyed.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fingerprint", F.lit(5)), F.col("parts")).cast("int"))
        others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        keyed = keyed.select("fingerprint", "choice", "key", "part", others).withColumn("tile", F.xxhash64(F.least("part", "other"), F.greatest("part", "other")))
    else:
        keyed = keyed.withColumn("tile", F.lit(0).cast("bigint"))
    count = distinct.count() * len(masks)
    cells = max(1, -(-count // cell_rows))
    named = keyed.select("fingerprint", F.xxhash64("choice", "key", "tile").alias("name"))

    def compare(table: pa.Table) -> pa.Table:
        values = table["fingerprint"].to_numpy().astype(np.int64).view(np.uint64)
        a, b = forest(table["name"].to_numpy(), values, radius)
        return pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64))})

    return named.groupBy(F.pmod("name", F.lit(cells)).alias("cell")).applyInArrow(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each document."""
    folder = work_dir(docs.sparkSession, "simhash")
    marked = stored(fingerprints(docs, words, seed), f"{folder}/fingerprints")
    classes = stored(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), f"{folder}/classes")
    edges = stored(links(classes.select("fingerprint"), radius), f"{folder}/edges")
    joined = connected(edges, folder).withColumnRenamed("node", "fingerprint")
    members = classes.join(joined, "fingerprint", "left")
    alone = members.where("label is null").select("fingerprint", F.col("first").alias("component_id"))
    grouped = members.where("label is not null")
    named = grouped.join(grouped.groupBy("label").agg(F.min("first").alias("component_id")), "label").select("fingerprint", "component_id")
    told = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return marked.join(alone.union(named), "fingerprint").select("doc_id", told, "component_id")
