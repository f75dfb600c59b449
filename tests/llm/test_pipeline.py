import re
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_quality import slow as slow_quality
from test_secrets import PLAIN
from test_simhash import slow_components, slow_fingerprint
from test_suffix import slow as slow_suffix


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, steps, now = docs.columns, [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, "/root/testdata/sf0.001").cache()
        steps.append((rows(now), out))
        assert name == corpus_pipeline.STAGES[-1][0] or out.columns == columns
        now = out
    (a, one), (b, two), (c, three), (d, four), (e, five) = steps
    kept = rows(one)
    for doc_id, text in a.items():
        n, _, _, _, again = slow_quality(text)
        assert doc_id not in kept or not (n < 50 or 100 * again > 50 * n)
    assert kept.items() <= a.items() and len(kept) > 0.7 * len(a)
    ids = sorted(b)  # the stage's own rule, not operator 4's
    assert rows(two) == {ids[k]: b[ids[k]] for k in set(slow_groups([b[i] for i in ids]))}
    told = {i: s for i, _, _, _, s in slow_suffix(list(c.items()))}
    import hashlib

    for doc_id, text in rows(three).items():
        if hashlib.sha256(text.encode()).hexdigest() != told[doc_id]:
            assert len(text) < len(c[doc_id])  # a character lost some of its bytes
    for doc_id, text in rows(four).items():
        spans = sorted((m.start(), m.end()) for _, p, g, least in PLAIN for m in p.finditer(d[doc_id]) if len(m[g]) >= least)
        out, at = "", 0
        for lo, hi in spans:
            if lo >= at:
                out += d[doc_id][at:lo] + "[SECRET]"
            at = max(at, hi)
        assert text == out + d[doc_id][at:]
    ends = defaultdict(int)
    for r in five.collect():
        ends[r.doc_id] += r.length
    assert set(ends) == set(e)


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(f"word{i} of the" for i in range(60))
    planted = [(1, text), (1, text), (None, text), (2, text + " more"), (None, text[::-1]), (None, text[::-1]), (3, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in planted], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame, "").collect()), key=repr)
    marks = slow_components([(i, slow_fingerprint(t)) for i, t in set(planted)])
    want = sorted({(i, t) for i, t in planted for d, f, c in marks if d == i and c == i and f == f"{slow_fingerprint(t):016x}"}, key=repr)
    assert got == want


def test_no_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def slow_groups(texts):
    """The least index of each text's component: links are five-word shingle sets alike to 0.8 or more."""
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(sets)))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                one, two = sorted((find(i), find(j)))
                root[two] = one
    return [find(i) for i in range(len(sets))]


def test_near_copies_at_the_rule(spark):
    rng = np.random.default_rng(5)
    texts = []
    for g in range(30):
        words = [f"w{g}_{i}" for i in range(100)]
        for changed in range(12):  # each changed word alters up to five shingles of 96: 0.8 lies between 2 and 3
            new = list(words)
            for at in rng.choice(100, changed // 2, replace=False):
                new[at] = f"n{g}_{changed}_{at}"
            texts.append(" ".join(new))
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert got == sorted(set(slow_groups(texts)))
    assert len(got) < len(texts) - 30


def test_repeated_ids_with_other_texts(spark):
    same = " ".join(f"word{i} of the" for i in range(60))
    rows = [(1, same), (5, same), (5, " ".join(f"other{i}" for i in range(90)))]
    frame = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, frame, "").collect()) == [rows[0], rows[2]]


@pytest.mark.parametrize("names", [["kept", "n_words", "class_distance", "_lang", "_row"], ["secrets", "_rules", "_id", "_clean", "row", "rules", "gram"], ["_bytes", "_doc", "file", "start", "rows"], ["_told", "_other", "node", "label", "place", "n_bytes", "offset"]])
def test_columns_of_any_name(spark, names):
    words = " ".join(f"word{i} of the {i % 7}" for i in range(60))
    rows = [(1, words, "en"), (1, words, "en"), (2, words + " token=abcdefgh12345 end", "en"), (None, words[::-1], None), (3, None, "en"), (4, "", "de"), (5, "long text " + "unique%d " * 4000 % tuple(range(4000)), "en")]
    frame = spark.createDataFrame([(*r, "s", 0, *(f"x{i}" for i in range(len(names)))) for r in rows], f"doc_id bigint, text string, lang string, source string, n_chars bigint, {', '.join(f'{n} string' for n in names)}")
    plain = frame.drop(*names)
    for (_, stage), last in zip(corpus_pipeline.STAGES, (0, 0, 0, 0, 1), strict=True):
        got, want = stage(spark, frame, ""), stage(spark, plain, "")
        assert last or got.columns == frame.columns
        assert sorted(map(repr, got.select(want.columns).drop("sequence_id", "offset", "sequence_tokens", "padded_tokens").collect())) == sorted(map(repr, want.drop("sequence_id", "offset", "sequence_tokens", "padded_tokens").collect()))
        if not last:
            assert all(r[n] == f"x{i}" for r in got.collect() for i, n in enumerate(names))
