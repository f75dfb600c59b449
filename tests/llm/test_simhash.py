import random
import re

import numpy as np
import xxhash

from cellweave.llm import simhash
from cellweave.llm._shared import work_dir
from cellweave.llm.components import connected


def slow_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(marks):
    """marks: (doc_id, fingerprint)."""
    values = sorted({f for _, f in marks})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    first = {}
    for d, f in marks:
        if d is not None:
            first[find(f)] = min(d, first.get(find(f), d))
    return sorted(((d, f"{f:016x}", first.get(find(f))) for d, f in marks), key=repr)


def check(docs):
    marks = [(d, slow_fingerprint(t)) for d, t in docs.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr) == slow_components(marks)


def test_documents(real, odd, nothing):
    check(real)
    check(odd)
    assert simhash.near_duplicates(nothing).count() == 0


def test_links_of_crowded_groups(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(12)]
    values = set(centres)
    for c in centres:
        for _ in range(60):
            v = c
            for _ in range(rng.randint(1, 7)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    frame = spark.createDataFrame([(v - (v >> 63 << 64),) for v in values], "fingerprint bigint")
    marks = [(v - (v >> 63 << 64), v) for v in values]
    expected = {f: c for _, f, c in slow_components(marks)}
    for kwargs in ({}, {"tile_rows": 8, "cell_rows": 100}, {"blocks": 5}):
        edges = simhash.links(frame, **kwargs)
        labels = {r.node: r.label for r in connected(edges, work_dir(spark, "test")).collect()}
        assert {f"{v % 2**64:016x}": labels.get(v, v) for v, _ in marks} == expected


def test_close_pairs_finds_each_pair_once():
    rng = np.random.default_rng(0)
    groups = np.repeat(np.arange(40), np.sort(rng.integers(1, 90, 40))[::-1])
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    values = base[groups]
    for _ in range(3):
        values ^= np.uint64(1) << rng.integers(0, 64, len(values)).astype(np.uint64)
    for radius in (0, 3, 4, 7):
        got = [pair for p, q in simhash.close_pairs(groups, values, radius) for pair in zip(p.tolist(), q.tolist(), strict=True)]
        n = len(values)
        want = [(i, j) for i in range(n) for j in range(i + 1, n) if groups[i] == groups[j] and (int(values[i]) ^ int(values[j])).bit_count() <= radius]
        assert sorted(got) == want


def test_long_chains(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    labels = {r.node: r.label for r in connected(chain, work_dir(spark, "test")).collect()}
    assert labels == {**dict.fromkeys(range(201), 0), 1000: 1000, 1001: 1000}
