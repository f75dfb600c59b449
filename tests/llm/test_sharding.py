import zlib
from collections import Counter, defaultdict

import pytest

from cellweave.llm import sharding


def check(frame, **kwargs):
    got = sharding.shard(frame, **kwargs).collect()
    docs = [(d, (t or "").encode()) for d, t in frame.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=repr) == sorted(((d, len(t) + 1, zlib.crc32(t)) for d, t in docs), key=repr)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(16))
    assert not docs or max(counts.values()) - min(counts[s] for s in range(16)) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {(r.law, r.grown_shard) for r in got} <= {("rows", None)}
    return got


@pytest.mark.parametrize("bin_rows", [50_000, 7])
def test_groups_stay_together(spark, bin_rows):
    texts = [f"copy {i // 5}" for i in range(300)] + [f"alone {i}" for i in range(500)] + ["hot"] * 400
    got = check(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5), bin_rows=bin_rows)
    shards = defaultdict(set)
    for r in got:
        shards[texts[r.doc_id]].add(r.shard)
    assert sum(len(s) == 1 for t, s in shards.items() if t.startswith("copy")) >= 50
    assert len(shards["hot"]) <= 8


def test_odd_rows(odd, real, nothing):
    for frame in (odd, real, nothing):
        check(frame)
