"""Exact substring deduplication with a logarithmic family of suffix arrays.

A byte is removed if a string of ``length`` bytes that covers it also starts in a
document with a smaller doc_id. Strings are judged on the input, never across
documents.

1. Texts are written as bytes to the shared folder; a *run* is a few megabytes of
   neighbouring rows of a file.
2. Each string of ``length`` bytes has a key: the smallest hash of the ``GRAM``-byte
   grams in it. Neighbouring strings mostly share their key, so a text gives about
   one stretch with one key for each 14 bytes. Equal strings have equal keys. The distinct keys
   of each run go, packed with those of neighbouring runs, to the bucket of the key; a bucket reports to the runs
   which keys also stand in another document. This leaves out what cannot match. Shorter grams would
   leave out ever less as a table grows, as they recur by chance.
3. The stretches with reported keys, as bytes, go to the bucket of their key, equal
   ones of a pack of runs once. Keys that stand in many runs (a passage that very many
   documents share) are dealt by finer keys instead, those of grams that lack ``SPARE`` bytes of a string, so that a bucket never
   holds all contexts of such a passage. A pack holds as many runs as fit ``HELD`` bytes or ``HELD_KEYS`` keys: packs
   by run would make runs x buckets rows, each of less the larger the table is.
4. In a bucket, the distinct stretches go to a logarithmic family of suffix arrays batch by batch, in ascending order of the
   smallest doc_id that has them. A new batch gets its suffix array (the places of its strings in its bytes, in the order
   of the strings, and the smallest doc_id of each) and is merge-scanned against each level that stands, for strings
   that an earlier document has. Then it is merged with the level of its size, and so on upwards, so sizes grow
   geometrically and each suffix is merged a logarithmic number of times. What a scan finds for a string, the smallest doc_id
   that has it, is compared with the doc_id of each place where its stretch stands.
5. Each file's removed stretches come back to the task that reads this file.

Keys are a filter and may collide; strings themselves are compared as bytes.
Rows that share a doc_id do not remove each other's bytes. A row without doc_id is left whole
and removes nothing. Null text is empty. No rows give no rows. Columns carried along may have any
names, but for :func:`remove_repeats` those of its results.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm._shared import fresh, opened, rows_in, stored, work_dir

GRAM, SHORT, SPARE, RUN_BYTES, STEP = 24, 16, 6, 4 << 20, 1 << 15
HELD, HELD_KEYS = 24 << 20, 1 << 22
RESULTS = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v * np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(32)
    return v * np.uint64(0xD6E8FEB86659FD93)


def gram_of(length: int) -> int:
    """Bytes of a gram: short strings need shorter ones, or neighbours would seldom share a key."""
    return max(SHORT, min(GRAM, length - GRAM - 2))


def _keys(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The key of the string at each position of ``data`` (at least ``length`` bytes): its smallest hash of ``gram`` bytes."""
    n = len(data) - gram + 1
    word = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), 0, (1,)).copy()
    grams = word[:n]
    for at in [*range(8, gram - 8, 8), gram - 8]:
        grams = (grams * np.uint64(0xFF51AFD7ED558CCD)) ^ word[at : at + n]
    grams = _mixed(grams)
    low, width, want = grams, 1, length - gram + 1
    while 2 * width <= want:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < want:
        low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
    return low


def stretches(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, document, first position, strings) of the stretches with one key; ``bounds`` are the documents' ends in ``data``."""
    total = len(data)
    for lo in range(0, max(0, total - length + 1), STEP):
        hi = min(lo + STEP, total - length + 1)
        keys = _keys(data[lo : hi + length - 1], length, gram)
        at = np.arange(lo, hi)
        one, last = np.searchsorted(bounds, (lo, hi - 1), side="right").tolist()
        times = np.diff(np.minimum(bounds[one : last + 1], hi), prepend=lo)  # the documents' positions of these
        doc = np.repeat(np.arange(one, last + 1), times)
        good = at <= np.repeat(bounds[one : last + 1] - length, times)
        new = np.ones(len(at), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1]) | (good[1:] != good[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        keep = good[first]
        first, count = first[keep], count[keep]
        yield _mixed(keys[first]) >> np.uint64(16), doc[first], at[first], count


def runs_of(uri: str, columns: list[str]) -> Iterator[tuple[int, int, pa.Table]]:
    """(number, first row, rows) of the runs of a file."""
    system, path = opened(uri)
    with system.open_input_file(path) as f:
        number, first, held, size = 0, 0, [], 0
        for batch in pq.ParquetFile(f).iter_batches(batch_size=64, columns=columns):
            held.append(batch)
            size += batch.nbytes
            if size >= RUN_BYTES:
                table = pa.Table.from_batches(held)
                yield number, first, table
                number, first, held, size = number + 1, first + len(table), [], 0
        if held:
            yield number, first, pa.Table.from_batches(held)


def _loaded(table: pa.Table, own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, rows, ids) of the documents of a run that have an id and text."""
    ids, texts = (table[c].to_pylist() for c in own)
    rows = [i for i, (d, t) in enumerate(zip(ids, texts, strict=True)) if d is not None and t]
    data = np.frombuffer(b"".join(texts[i] for i in rows), np.uint8)
    return data, np.cumsum([len(texts[i]) for i in rows], dtype=np.int64), np.array(rows, np.int64), np.array([ids[i] for i in rows], np.int64)


def _six(keys: np.ndarray) -> bytes:
    """Keys of 48 bits, 6 bytes each."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_packer, _unpacker = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _small(data: bytes) -> bytes:
    return _packer.compress(data)


def _whole(data: bytes) -> bytes:
    return _unpacker.decompress(data)


def _u4(values) -> bytes:
    return np.array(values, "<u4").tobytes()


class Level(NamedTuple):
    """A suffix array: the places in ``data`` of its distinct strings, in their order, and the smallest doc_id of each."""

    data: np.ndarray
    at: np.ndarray
    docs: np.ndarray


class SuffixFamily:
    """Suffix arrays over the first ``length`` bytes of suffixes, in levels whose sizes grow geometrically."""

    def __init__(self, length: int, block: int = 1 << 16):
        self.length, self.block, self.levels = length, block, {}

    def _strings(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        view = np.lib.stride_tricks.sliding_window_view(data, self.length)[at]
        return np.ascontiguousarray(view).view(f"S{self.length}").ravel()

    def _array(self, data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
        """(suffix array, its strings, which of them each of ``at`` is)."""
        strings = self._strings(data, at)
        order = np.argsort(strings, kind="stable")  # of two arrays in order this is one merge
        strings = strings[order]
        new = np.ones(len(strings), bool)
        new[1:] = strings[1:] != strings[:-1]
        first = np.flatnonzero(new)
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return Level(data, at[order[first]], np.minimum.reduceat(docs[order], first)), strings[first], which

    def _scan(self, level: Level, strings: np.ndarray, best: np.ndarray) -> None:
        """Go through the level and ``strings`` (in order) side by side, a block of the level at a time; lower ``best`` where they meet."""
        done = 0
        for lo in range(0, len(level.at), self.block):
            known = self._strings(level.data, level.at[lo : lo + self.block])
            upto = int(np.searchsorted(strings, known[-1], side="right"))
            if upto > done:
                mine = strings[done:upto]
                at = np.searchsorted(known, mine)
                hit = known[at] == mine
                best[done:upto][hit] = np.minimum(best[done:upto][hit], level.docs[lo : lo + self.block][at[hit]])
            done = upto

    def add(self, data: np.ndarray, at: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Take in a batch of strings; the smallest doc_id so far, this batch's own included, that has each.

        With batches in ascending order of doc_ids this is the smallest of all.
        """
        level, strings, which = self._array(data, at, docs)
        best = level.docs.copy()
        for standing in self.levels.values():
            self._scan(standing, strings, best)
        while (size := len(level.at).bit_length()) in self.levels:
            other = self.levels.pop(size)
            level = self._array(np.concatenate((other.data, level.data)), np.concatenate((other.at, level.at + len(other.data))), np.concatenate((other.docs, level.docs)))[0]
        self.levels[size] = level
        return best[which]


class SuffixDedup:
    """One run over a table; see the module."""

    def __init__(self, spark: SparkSession, length: int, hot_runs: int, bucket_bytes: int, batch_strings: int):
        if length < SHORT:
            raise ValueError(f"length must be at least {SHORT}")
        self.spark, self.length, self.hot_runs, self.bucket_bytes, self.batch_strings = spark, length, hot_runs, bucket_bytes, batch_strings

    def write(self, docs: DataFrame, folder: str) -> None:
        self.own = fresh(docs.columns, "_doc", "_bytes")
        docs = docs.select("*", docs["doc_id"].cast("bigint").alias(self.own[0]), F.coalesce(docs["text"].cast("binary"), F.lit(b"")).alias(self.own[1]))
        docs.write.option("compression", "zstd").option("maxRecordsPerFile", 1 << 20).parquet(f"{folder}/texts")
        texts = self.spark.read.schema(docs.schema).parquet(f"{folder}/texts")
        self.files = stored(texts.select(F.input_file_name().alias("file")).distinct(), f"{folder}/files")
        self.count = max(1, self.files.count())
        total = texts.agg(F.sum(F.octet_length(self.own[1]).cast("bigint"))).first()[0] or 0
        self.bits = max(2, (int(total) // self.bucket_bytes).bit_length())

    def each_file(self) -> DataFrame:
        return self.files.repartition(self.count)

    def shared_keys(self) -> DataFrame:
        """(file, runs, counts, keys, hot) of the keys that stand in more than one document: packs of the keys of some runs."""
        bits, length, hot_runs, own = self.bits, self.length, self.hot_runs, self.own

        def packed(file: str, held: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            """A row for each bucket that has keys; held: run, keys in order, which of them several documents have."""
            edges = np.arange((1 << bits) + 1, dtype=np.uint64)
            cuts = np.array([np.searchsorted(k >> np.uint64(48 - bits), edges) for _, k, _ in held])
            counts, runs, out = np.diff(cuts), np.array([r for r, _, _ in held], "<u4"), []
            for b in np.flatnonzero(counts.any(axis=0)).tolist():
                mine = np.flatnonzero(counts[:, b]).tolist()
                keys, several = (np.concatenate([held[i][x][cuts[i, b] : cuts[i, b + 1]] for i in mine]) for x in (1, 2))
                out.append((b, file, runs[mine].tobytes(), _u4(counts[mine, b]), _six(keys), np.packbits(several).tobytes()))
            columns = zip(*out, strict=True)
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "file", "runs", "counts", "keys", "flags"])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (file,) in rows_in(batches, "file"):
                held, size = [], 0
                for run, _, table in runs_of(file, own):
                    data, ends, _, ids = _loaded(table, own)
                    parts = [(k, ids[d]) for k, d, _, _ in stretches(data, ends, length, gram_of(length))]
                    if not parts:
                        continue
                    keys, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
                    if not len(keys):
                        continue
                    order = np.argsort(keys)
                    keys, docs = keys[order], docs[order]
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    held.append((run, keys[first], np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)))
                    size += len(first)
                    if size >= HELD_KEYS:
                        yield packed(file, held)
                        held, size = [], 0
                if held:
                    yield packed(file, held)

        def report(table: pa.Table) -> pa.Table:
            told = [_from_six(x) for x in table["keys"].to_pylist()]
            keys = np.concatenate(told)
            several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8))[: len(k)] for f, k in zip(table["flags"].to_pylist(), told, strict=True)])
            _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
            shared = (counts > 1) | (np.bincount(inverse, several) > 0)
            keep, hot = shared[inverse], (counts > hot_runs)[inverse]
            out, at = [], 0
            for file, runs, sizes, k in zip(*(table[c].to_pylist() for c in ("file", "runs", "counts")), told, strict=True):
                mine, sizes = keep[at : at + len(k)], np.frombuffer(sizes, "<u4").astype(np.int64)
                if mine.any():
                    left = np.add.reduceat(mine.astype(np.int64), np.cumsum(sizes) - sizes)
                    out.append((file, runs, _u4(left), _six(k[mine]), np.packbits(hot[at : at + len(k)][mine]).tobytes()))
                at += len(k)
            names = ("file", "runs", "counts", "keys", "hot")
            return pa.Table.from_pylist([dict(zip(names, r, strict=True)) for r in out], pa.schema([(n, pa.string() if n == "file" else pa.binary()) for n in names]))

        sent = self.each_file().mapInArrow(send, "bucket int, file string, runs binary, counts binary, keys binary, flags binary")
        return sent.groupBy("bucket").applyInArrow(report, "file string, runs binary, counts binary, keys binary, hot binary")

    def candidates(self, shared: DataFrame) -> DataFrame:
        """The stretches with shared keys, packed by (bucket, file, run): their bytes, and the places where they stand."""
        bits, length, own = self.bits, self.length, self.own
        kinds = pa.schema([("bucket", pa.int32()), ("file", pa.string()), ("run", pa.int32()), ("sizes", pa.binary()), ("strings", pa.binary()), ("entry", pa.binary()), ("doc", pa.binary()), ("row", pa.binary()), ("start", pa.binary())])

        def packed(file: str, run: int, buckets: dict) -> pa.RecordBatch:
            out = []
            for bucket, (entries, *places) in buckets.items():
                entry, docs, at_row, at = (np.array(x, k).tobytes() for x, k in zip(places, ("<u4", "<i8", "<u4", "<u4"), strict=True))
                out.append((bucket, file, run, *map(_small, (_u4([len(x) for x in entries]), b"".join(entries), entry, docs, at_row, at))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(kinds)], schema=kinds)

        def finer(data: np.ndarray, at: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            """(key, which stretch, first position, strings) of what stretches fall into by their strings' finer keys."""
            size = count + length - 1
            ends = np.cumsum(size)
            begin = ends - size
            parts = list(stretches(data[np.repeat(at - begin, size) + np.arange(ends[-1])], ends, length, max(SHORT, length - SPARE)))
            keys, of, p, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            return keys, of, at[of] + p - begin[of], n

        def pick(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_run, file = defaultdict(list), ""
            for file, runs, counts, keys, hot in rows_in(group, "file", "runs", "counts", "keys", "hot"):
                cuts = np.cumsum(np.frombuffer(counts, "<u4"), dtype=np.int64)[:-1]
                keys = _from_six(keys)
                for run, k, h in zip(np.frombuffer(runs, "<u4").tolist(), np.split(keys, cuts), np.split(np.unpackbits(np.frombuffer(hot, np.uint8))[: len(keys)], cuts), strict=True):
                    if len(k):
                        by_run[run].append((k, h))
            buckets: dict[int, tuple[dict, list, list, list, list]] = defaultdict(lambda: ({}, [], [], [], []))
            held = 0
            for run, first_row, table in runs_of(file, own):
                if run not in by_run:
                    continue
                known, hot = (np.concatenate(x) for x in zip(*by_run.pop(run), strict=True))
                order = np.argsort(known)
                known, hot = known[order], hot[order].astype(bool)
                data, ends, rows, ids = _loaded(table, own)
                raw, begins = data.tobytes(), np.append(0, ends[:-1])
                for keys, doc, at, count in stretches(data, ends, length, gram_of(length)):
                    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    found, crowded = known[place] == keys, hot[place]
                    told = [x[found & ~crowded] for x in (keys, doc, at, count)]
                    if len(split := np.flatnonzero(found & crowded)):
                        keys, of, p, n = finer(data, at[split], count[split])
                        told = [np.concatenate(x) for x in zip(told, (keys, doc[split[of]], p, n), strict=True)]
                    keys, doc, at, count = told
                    columns = (keys >> np.uint64(48 - bits), ids[doc], rows[doc] + first_row, at, at - begins[doc], count + (length - 1))
                    for bucket, doc_id, row, p, start, n in zip(*(x.tolist() for x in columns), strict=True):
                        entries, entry, docs, at_row, starts = buckets[bucket]
                        text, new = raw[p : p + n], len(entries)
                        i = entries.setdefault(text, new)
                        if i == new:
                            held += n
                        entry.append(i)
                        docs.append(doc_id)
                        at_row.append(row)
                        starts.append(start)
                    held += 20 * len(keys)
                    if held >= HELD:
                        yield packed(file, run, buckets)
                        buckets.clear()
                        held = 0
            if buckets:
                yield packed(file, run, buckets)

        return shared.groupBy("file").applyInArrow(pick, "bucket int, file string, run int, sizes binary, strings binary, entry binary, doc binary, row binary, start binary")

    def removals(self, sent: DataFrame) -> DataFrame:
        """(file, rows, starts, sizes): removed stretches, packed."""
        length, batch_strings = self.length, self.batch_strings
        kinds = pa.schema([("file", pa.string()), ("rows", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary())])

        def scan(table: pa.Table) -> pa.Table:
            table = table.sort_by([("file", "ascending"), ("run", "ascending")])
            seen: dict[bytes, int] = {}
            texts, places, files = [], [], {}
            for file, *packed in zip(*(table[c].to_pylist() for c in ("file", "sizes", "strings", "entry", "doc", "row", "start")), strict=True):
                sizes, strings, entry, doc, row, start = map(_whole, packed)
                ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
                known = []
                for lo, hi in zip([0, *ends], ends, strict=False):
                    text = strings[lo:hi]
                    i = seen.setdefault(text, len(texts))
                    if i == len(texts):
                        texts.append(text)
                    known.append(i)
                entry = np.array(known, np.int64)[np.frombuffer(entry, "<u4")]
                places.append((np.full(len(entry), files.setdefault(file, len(files))), entry, np.frombuffer(doc, "<i8"), np.frombuffer(row, "<u4"), np.frombuffer(start, "<u4")))
            del seen
            file, entry, doc, row, start = (np.concatenate(x) for x in zip(*places, strict=True))
            by_entry = np.argsort(entry, kind="stable")
            file, entry, doc, row, start = (x[by_entry] for x in (file, entry, doc, row, start.astype(np.int64)))
            begin = np.searchsorted(entry, np.arange(len(texts) + 1))  # an entry's places
            sizes = np.array([len(t) for t in texts], np.int64)
            count, lows = sizes - length + 1, np.minimum.reduceat(doc, begin[:-1])
            out: dict[int, list[tuple]] = defaultdict(list)

            def remove(place: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
                for f in np.unique(file[place]).tolist():
                    hit = file[place] == f
                    out[f].append((row[place][hit], at[hit], size[hit]))

            family, order = SuffixFamily(length), np.argsort(lows, kind="stable")
            upto = np.cumsum(count[order])
            done = 0
            while done < len(order):
                stop = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + batch_strings, side="right")))
                mine = order[done:stop]
                done = stop
                n, first = count[mine], np.cumsum(sizes[mine]) - sizes[mine]
                string = np.cumsum(n) - n
                data = np.frombuffer(b"".join(texts[i] for i in mine.tolist()), np.uint8)
                best = family.add(data, np.repeat(first - string, n) + np.arange(n.sum()), np.repeat(lows[mine], n))
                most, least = np.maximum.reduceat(best, string), np.minimum.reduceat(best, string)
                times = begin[mine + 1] - begin[mine]
                which = np.repeat(np.arange(len(mine)), times)
                place = np.repeat(begin[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                # a place loses the strings that the family knows from a smaller doc_id: all of its stretch, or some
                whole = most[which] < doc[place]
                remove(place[whole], start[place[whole]], sizes[mine[which[whole]]])
                some = np.flatnonzero(~whole & (least[which] < doc[place]))
                for at in range(0, len(some), 1 << 14):
                    w, p = which[some[at : at + (1 << 14)]], place[some[at : at + (1 << 14)]]
                    inside = np.arange(n[w].sum()) - np.repeat(np.cumsum(n[w]) - n[w], n[w])
                    of = np.repeat(np.arange(len(w)), n[w])
                    gone = best[string[w][of] + inside] < doc[p][of]
                    edge = of[1:] != of[:-1]
                    head = np.flatnonzero(gone & np.append(True, ~gone[:-1] | edge))
                    tail = np.flatnonzero(gone & np.append(~gone[1:] | edge, True))
                    remove(p[of[head]], start[p[of[head]]] + inside[head], tail - head + length)
            names = list(files)
            told = [(names[f], *(np.concatenate(x).astype("<u4").tobytes() for x in zip(*parts, strict=True))) for f, parts in out.items()]
            return pa.Table.from_arrays([pa.array([r[i] for r in told], f.type) for i, f in enumerate(kinds)], schema=kinds)

        return sent.groupBy("bucket").applyInArrow(scan, "file string, rows binary, starts binary, sizes binary")

    def cleaned(self, removed: DataFrame, carry: list[T.StructField], results: bool, as_text: bool) -> DataFrame:
        """The rows of all files: the carried columns, of which ``text`` is what is left if ``as_text``, and the results."""
        from pyspark.sql.pandas.types import to_arrow_schema

        names, held_as = [f.name for f in carry], self.own[1]
        every = self.each_file().select("file", *(F.lit(b"").alias(c) for c in ("rows", "starts", "sizes")))
        schema = T.StructType([*carry, *(T._parse_datatype_string(RESULTS).fields if results else [])])
        arrow = to_arrow_schema(schema)

        def clean(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file, held = "", []
            for file, *told in rows_in(group, "file", "rows", "starts", "sizes"):
                held.append(told)
            rows, starts, sizes = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in zip(*held, strict=True))
            order = np.lexsort((starts, rows))
            rows, starts, ends = rows[order], starts[order], (starts + sizes)[order]
            for _, first, part in runs_of(file, [*names, held_as]):
                told, texts = [], []
                at = np.searchsorted(rows, np.arange(first, first + len(part) + 1))
                for i, text in enumerate(part[held_as].to_pylist()):
                    spans = merged(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])
                    kept, done = [], 0
                    for lo, hi in spans:
                        kept.append(text[done:lo])
                        done = hi
                    left = b"".join([*kept, text[done:]])
                    told.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest()))
                    if as_text:
                        texts.append(left.decode("utf-8", "ignore"))
                columns = [pa.array(texts) if as_text and c == "text" else part[c].combine_chunks() for c in names]
                columns += [pa.array(x) for x in zip(*told, strict=True)] if results else []
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        return removed.unionByName(every).groupBy("file").applyInArrow(clean, schema)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The union of stretches that are ordered by start; touching ones become one."""
    if not len(starts):
        return []
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return list(zip(starts[first].tolist(), reach[np.append(first[1:], len(starts)) - 1].tolist(), strict=True))


def _cleaned(docs: DataFrame, length: int, carry: list[str], results: bool, as_text: bool, hot_runs: int, bucket_bytes: int, batch_strings: int) -> DataFrame:
    spark = docs.sparkSession
    work = SuffixDedup(spark, length, hot_runs, bucket_bytes, batch_strings)
    work.write(docs, work_dir(spark, "suffix"))
    found = work.removals(work.candidates(work.shared_keys()))
    return work.cleaned(found, [docs.schema[c] for c in carry], results, as_text)


def remove_repeats(docs: DataFrame, length: int = 50, carry: tuple[str, ...] = ("doc_id",), hot_runs: int = 512, bucket_bytes: int = 8 << 20, batch_strings: int = 1 << 17) -> DataFrame:
    """The ``carry`` columns of each row, n_bytes, n_removed, n_spans and kept_sha256."""
    return _cleaned(docs, length, list(carry), True, False, hot_runs, bucket_bytes, batch_strings)


def without_repeats(docs: DataFrame, length: int = 50, hot_runs: int = 512, bucket_bytes: int = 8 << 20, batch_strings: int = 1 << 17) -> DataFrame:
    """``docs`` with the repeats taken out of ``text``; a character that has lost some of its bytes goes as a whole."""
    return _cleaned(docs, length, docs.columns, False, True, hot_runs, bucket_bytes, batch_strings)
