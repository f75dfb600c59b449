import math
import re
from collections import Counter

from cellweave.llm import quality


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    trios = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(trios)
    covered = {i + k for i, t in enumerate(trios) if often[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(odd, real, nothing, spark):
    more = [(1, "a b c " * 400, "en"), (2, "a a a a", None), (3, "x\x0b\x1c y z # $\n\n \n#\n#", "xx"), (4, "one two three four\none two three\n" * 30, "en")]
    planted = spark.createDataFrame([(*m, 1) for m in more], "doc_id bigint, text string, lang string, n_words int")
    for frame in (odd, real, planted, nothing):
        got = sorted((tuple(r) for r in quality.judged(frame, ["doc_id"]).select("doc_id", *quality.BASE, "base_failed").collect()), key=repr)
        want = []
        for d, t in frame.select("doc_id", "text").collect():
            n = slow(t)
            want.append((d, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
        assert got == sorted(want, key=repr)


def test_distance(spark):
    frame = spark.createDataFrame([([1.0, 0.0], [0.0, 5.0]), ([1.0, 3.0], [2.0, 6.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 1.0], [1.0, 3.0])], "p array<double>, q array<double>")
    got = [r[0] for r in frame.select(quality.distance(frame.p, frame.q)).collect()]
    half = lambda x, m: x * math.log2(x / m)
    assert got[:3] == [1.0, 0.0, None]
    assert math.isclose(got[3], math.sqrt((half(0.5, 0.375) + half(0.5, 0.625) + half(0.25, 0.375) + half(0.75, 0.625)) / 2))


def test_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judged(docs, ["doc_id"]).join(labels, "doc_id").where("not base_failed").select("quality", "kept").collect()
    clean, poor = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert all(clean)
    assert sum(poor) <= 0.4 * len(poor)
