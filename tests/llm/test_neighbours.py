import numpy as np
import pytest

from cellweave.llm import neighbours


def exact(rows, k=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for q, x in good:
        if q % 20 == 0:
            scored = sorted((-float((x * y).sum()), i) for i, y in good if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = frame.select("vec_id", "embedding").collect()
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = neighbours.search(frame, "vec_id % 20 = 0").collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in ids[ids % 20 == 0].tolist():
        scores = v @ v[ids == q][0]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = [found[q][n] for n in range(1, 21)]
        assert all(abs(s - scores[ids == i][0]) < 1e-12 for i, s in mine)
        assert mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in mine} & set(ids[order].tolist()))
    assert hits >= 0.9 * 20 * (ids % 20 == 0).sum()


@pytest.mark.parametrize("kwargs", [{}, {"chunk_rows": 9, "chunk_queries": 2}])
def test_ties_copies_and_odd_vectors(spark, kwargs):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(120)] + [(i, [1.0, 2.0, 0.0, 0.0, 1.0, 1.0]) for i in range(1000, 1090)]
    rows += [(20, None), (40, [0.0] * 6), (60, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (80, [float("nan")] * 6), (100, [float("inf")] + [1.0] * 5), (None, [1.0] * 6), (2000, [1.0, 1.0])]
    rows = [r for i, r in enumerate(rows) if not (i < 120 and r[0] in (20, 40, 60, 80, 100))]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, part int").repartition(3)
    got = neighbours.search(frame, "vec_id % 20 = 0", aim=1.1, **kwargs).collect()  # all parts: exact
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == exact([r for r in rows if r[0] != 2000])


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.search(few, "vec_id % 20 = 0").orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]
    assert neighbours.search(few.limit(0), "vec_id % 20 = 0").count() == 0


def test_parts_are_balanced():
    v = neighbours._unit(np.random.default_rng(0).normal(size=(500, 8)))
    part = neighbours.balanced_parts(v, neighbours.nearest(v, v, 5, True), 7)
    counts = np.bincount(part, minlength=7)
    assert counts.max() - counts.min() <= 1
