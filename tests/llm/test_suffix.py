import hashlib
import random

import numpy as np
import pytest

from cellweave.llm import suffix_family


def slow(docs, length=50):
    first = {}
    told = [(d, (t or "").encode()) for d, t in docs]
    for d, b in told:
        if d is not None:
            for i in range(len(b) - length + 1):
                s = b[i : i + length]
                first[s] = min(d, first.get(s, d))
    out = []
    for d, b in told:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if d is not None and first.get(b[i : i + length], d) < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def got(frame, **kwargs):
    return sorted((tuple(r) for r in suffix_family.remove_repeats(frame, **kwargs).collect()), key=repr)


def test_documents(real, odd, nothing):
    for frame in (real, odd):
        assert got(frame) == slow(frame.select("doc_id", "text").collect())
    assert suffix_family.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("kwargs", [{}, {"hot_runs": 0, "bucket_bytes": 500, "batch_strings": 64}])
def test_shared_passages(spark, kwargs):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abé\0 \n") for _ in range(rng.randint(1, 90)))
    common = [word() + word() + word() for _ in range(6)] + ["a" * 120, "\0" * 70]
    docs = [(rng.randrange(60), "".join(rng.choice(common) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 8)))) for _ in range(80)]
    docs += [(None, common[0]), (70, None), (71, "x" * 49), (72, "x" * 50), (73, "x" * 50)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert got(frame, **kwargs) == slow(docs)


def test_batches_are_scanned_against_standing_levels():
    rng = np.random.default_rng(1)
    family, known, scans = suffix_family.SuffixFamily(4, block=7), {}, []
    scan = family._scan
    family._scan = lambda level, *a: scans.append(len(level.at)) or scan(level, *a)
    for step in range(40):
        data = rng.integers(97, 100, 53).astype(np.uint8)
        docs = np.sort(rng.integers(25 * step, 25 * step + 30, 50))
        standing = [len(level.at) for level in family.levels.values()]
        scans.clear()
        best = family.add(data, np.arange(50), docs)
        assert scans == standing and len(standing) <= 8
        strings = [data[i : i + 4].tobytes() for i in range(50)]
        for s, d in zip(strings, docs.tolist(), strict=True):
            known[s] = min(d, known.get(s, d))
        assert best.tolist() == [known[s] for s in strings]
    held = [{level.data[i : i + 4].tobytes() for i in level.at.tolist()} for level in family.levels.values()]
    assert set().union(*held) == set(known)
    for level in family.levels.values():
        strings = [level.data[i : i + 4].tobytes() for i in level.at.tolist()]
        assert strings == sorted(set(strings))


def candidates(frame, folder, hot_runs=512, bucket_bytes=8 << 20):
    """(bucket, file, strings of the distinct stretches, places, strings at the places) of each packet."""
    work = suffix_family.SuffixDedup(frame.sparkSession, 50, hot_runs, bucket_bytes, 1 << 17)
    work.write(frame, f"file://{folder}")
    out = []
    for r in work.candidates(work.shared_keys()).collect():
        sizes, entry = (np.frombuffer(suffix_family._whole(r[c]), "<u4").astype(np.int64) for c in ("sizes", "entry"))
        out.append((r.bucket, r.file, (sizes - 49).sum(), len(entry), (sizes - 49)[entry].sum()))
    return out


def letters(rng, size):
    return rng.integers(97, 123, size).astype(np.uint8).tobytes().decode()


def test_packets_do_not_grow_as_runs_by_buckets(spark, tmp_path):
    rng = np.random.default_rng(2)
    parts = [letters(rng, 1000) for _ in range(450)]
    docs = [(i, letters(rng, 19_000) + parts[i % 450]) for i in range(900)]  # more than 4 runs of 4 MB in one file
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    told = candidates(frame, tmp_path / "a", bucket_bytes=1 << 18)
    assert len({b for b, *_ in told}) >= 64
    assert len(told) == len({(b, f) for b, f, *_ in told})
    rows = suffix_family.remove_repeats(frame, bucket_bytes=1 << 18).collect()
    assert {(r.doc_id, r.n_removed >= 1000) for r in rows} == {(i, i >= 450) for i in range(900)}


def test_crowded_keys_are_not_dealt_by_single_strings(spark, tmp_path):
    rng = np.random.default_rng(3)
    common = letters(rng, 400)
    docs = [(i, letters(rng, 100) + common + letters(rng, 100)) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    told = candidates(frame, tmp_path / "a", hot_runs=0)
    assert 3 * sum(n for *_, n, _ in told) < sum(n for *_, n in told)
    assert len({b for b, *_ in told}) > 1
    assert got(frame, hot_runs=0) == got(frame) == slow(docs)


def test_short_grams_that_recur_are_no_candidates(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [letters(rng, 20) for _ in range(5)]
    docs = [(i, "".join(w + letters(rng, 15) for w in words)) for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert candidates(frame, tmp_path / "a") == []
    assert got(frame) == slow(docs)


@pytest.mark.parametrize("length", [16, 23, 31, 50, 77])
def test_lengths(spark, length):
    rng = random.Random(length)
    common = ["".join(rng.choice("abc") for _ in range(120)) for _ in range(3)] + ["z" * 90]
    docs = [(i % 30, "".join(c[rng.randrange(60) : rng.randrange(60, 120)] for c in rng.choices(common, k=4))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    assert got(frame, length=length) == got(frame, length=length, hot_runs=0) == slow(docs, length)
