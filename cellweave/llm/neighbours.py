"""Approximate nearest neighbours by learned partitions, under the inner product.

Fitting, on a sample of at most ``sample_rows`` distinct vectors (those with the
smallest hashes): the graph of each vector's nearest neighbours is cut into
``partitions`` parts of equal size by moving vectors to the part of most of their
neighbours under quotas. A small network learns from a vector the parts in which its
neighbours are. On held-out vectors of the sample, the number of parts to search is set so that
``aim`` of the true neighbours are found; at most all parts, which is exact.

Indexing covers every row: the network's first choice names its part. A query goes to
its most probable parts, and all rows there are ranked by the inner product in
double precision. Parts are cut into chunks of bounded size, as are the queries that
go to one, so a task's memory does not grow with the table.

Equal vectors are tied, and ties go to smaller ids. So of the rows with one vector the
k + 1 smallest ids alone can be in an answer, and equal queries are searched once; a
vector that a third of all rows have costs no more than another, and nothing is lost.

Vectors that are null, zero, or have null or non-finite components take no part, nor do
those of another length than most, nor rows without id. A repeated id is a candidate as often as it
is there, but never for a query with this id. No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm._shared import stored, work_dir


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Positions of the k largest inner products for each query."""
    k, out = min(k, len(rows) - skip_self), []
    for at in range(0, len(queries), 256):
        scores = queries[at : at + 256] @ rows.T
        if skip_self:
            scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out.append(np.argpartition(-scores, k - 1, axis=1)[:, :k] if k > 0 else np.zeros((len(scores), 0), int))
    return np.concatenate(out) if out else np.zeros((0, max(k, 0)), int)


def balanced_parts(vectors: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """A part for each vector, sizes at most one apart, with few of the graph's edges between parts."""
    n, rng = len(vectors), np.random.default_rng(seed)
    quota = np.full(parts, n // parts) + (np.arange(parts) < n % parts)
    centres = vectors[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, int)
    for step in range(rounds):
        if step < 4:  # a start: balanced clusters
            gain = vectors @ centres.T
        else:  # votes of the neighbours, both ways, and the centres for ties
            votes = np.zeros((n, parts), np.float32)
            for j in range(graph.shape[1]):
                np.add.at(votes, (np.arange(n), part[graph[:, j]]), 1)
                np.add.at(votes, (graph[:, j], part), 1)
            gain = votes + 0.5 * (vectors @ centres.T)
        best = np.sort(gain, axis=1)
        order = np.argsort(best[:, -2] - best[:, -1] if parts > 1 else best[:, -1], kind="stable")
        choices, room = np.argsort(-gain, axis=1), quota.copy()
        for i in order.tolist():
            for p in choices[i].tolist():
                if room[p]:
                    room[p] -= 1
                    part[i] = p
                    break
        centres = np.zeros_like(centres)
        np.add.at(centres, part, vectors)
        centres = _unit(centres)
    return part


@dataclass
class Router:
    """A network of one hidden layer from a vector to its parts, and how many parts a query searches."""

    weights: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
    partitions: int
    probes: int

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.maximum(_unit(vectors) @ a + b, 0) @ c + d

    def parts(self, vectors: np.ndarray, many: int) -> np.ndarray:
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :many]


def _train(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int = 20, batch: int = 256, seed: int = 2) -> tuple:
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, target.shape[1])), np.zeros(target.shape[1])]
    w = [p.astype(np.float32) for p in w]
    first, second, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            i = order[at : at + batch]
            z = x[i] @ w[0] + w[1]
            h = np.maximum(z, 0)
            logits = h @ w[2] + w[3]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            up = (p / p.sum(axis=1, keepdims=True) - target[i]) / len(i)
            down = (up @ w[2].T) * (z > 0)
            step += 1
            for j, g in enumerate((x[i].T @ down, down.sum(0), h.T @ up, up.sum(0))):  # Adam
                first[j] += 0.1 * (g - first[j])
                second[j] += 0.001 * (g * g - second[j])
                w[j] -= 3e-3 * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return tuple(w)


def fit(sample: np.ndarray, partitions: int, k: int, aim: float, hidden: int = 128, degree: int = 12, held_out: int = 512) -> Router:
    """See the module."""
    x = _unit(sample)
    partitions = max(1, min(partitions, len(x) // 16))
    width = x.shape[1]
    if partitions == 1:
        return Router((np.zeros((width, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32)), 1, 1)
    graph = nearest(x, x, degree, True)
    part = balanced_parts(x, graph, partitions)
    target = np.zeros((len(x), partitions), np.float32)
    np.add.at(target, (np.arange(len(x)), part), 1)
    for j in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[graph[:, j]]), 1)
    target /= target.sum(axis=1, keepdims=True)
    test = np.arange(len(x)) % max(2, len(x) // held_out) == 0
    router = Router(_train(x[~test], target[~test], hidden), partitions, partitions)
    rows = sample.astype(np.float64)
    true = nearest(rows[test], rows[~test], k, False)
    home = router.parts(sample[~test], 1)[:, 0]
    place = np.argsort(router.parts(sample[test], partitions), axis=1)  # the place of each part in a query's order
    found = place[np.arange(len(true))[:, None], home[true]]
    reached = [(found < m).mean() for m in range(1, partitions + 1)]
    router.probes = next((m + 1 for m, share in enumerate(reached) if share >= aim), partitions)
    return router


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def best_rows(query: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k largest products of each query, ties to smaller ids; a product is summed the same way wherever its row stands."""
    look = min(len(rows), 3 * k + 1)
    for at in range(0, len(query), 256):
        rough = query[at : at + 256] @ rows.T
        some = np.argpartition(-rough, look - 1, axis=1)[:, :look]
        for q, r, near in zip(query[at : at + 256], rough, some, strict=True):
            exact = (rows[near] * q).sum(axis=1)
            if look < len(rows) and r[near].min() > np.sort(exact)[-min(k, len(exact))] - 1e-9:  # more could be tied
                near = np.arange(len(rows))
                exact = (rows * q).sum(axis=1)
            order = np.lexsort((ids[near], -exact))[:k]
            yield ids[near][order], exact[order]


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that takes part, as doubles."""
    v = F.col(column).cast("array<double>")
    good = F.col(id_column).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    told = vectors.where(good).select(F.col(id_column).cast("bigint").alias("vec_id"), v.alias("v"))
    most = told.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return told.where(F.size("v") == (most["n"] if most else 0))


def search(
    vectors: DataFrame,
    is_query: str,
    k: int = 20,
    id_column: str = "vec_id",
    column: str = "embedding",
    sample_rows: int = 4096,
    partitions: int = 32,
    aim: float = 0.96,
    chunk_rows: int = 32_768,
    chunk_queries: int = 8192,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row that satisfies ``is_query`` (SQL over vec_id)."""
    spark = vectors.sparkSession
    folder = work_dir(spark, "neighbours")
    rows = stored(usable(vectors, id_column, column).withColumn("h", F.xxhash64("v")), f"{folder}/rows")
    equal = W.partitionBy("h", "v").orderBy("vec_id")
    index = stored(rows.withColumn("place", F.row_number().over(equal)).where(F.col("place") <= k + 1), f"{folder}/distinct")
    sample = index.where("place = 1").orderBy(F.xxhash64("h", F.lit(3))).limit(sample_rows).toArrow()
    width = len(sample["v"][0]) if len(sample) else 1
    router = fit(_matrix(sample["v"]), partitions, k, aim) if len(sample) else fit(np.zeros((0, width)), 1, k, aim)

    def routed(many: int, names: list[str]):
        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    parts = router.parts(_matrix(batch["v"]), many).astype(np.int32)
                    of = np.repeat(np.arange(len(batch)), parts.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(parts.ravel()), *(batch[n].take(pa.array(of)) for n in names)], names=["part", *names])

        return route

    placed = stored(index.select("vec_id", "v").mapInArrow(routed(1, ["vec_id", "v"]), "part int, vec_id bigint, v array<double>"), f"{folder}/index")
    asked = rows.where(is_query)
    questions = stored(asked.groupBy("h", "v").agg(F.min("vec_id").alias("qid")), f"{folder}/questions")
    sent = questions.select("qid", "v").mapInArrow(routed(router.probes, ["qid", "v"]), "part int, qid bigint, v array<double>")
    count = lambda df: {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}  # noqa: E731  a row per part
    per_part, per_query = count(placed), count(sent.select("part"))
    cells = lambda held, size: F.get(F.array(*(F.lit(max(1, -(-held.get(p, 0) // size))) for p in range(router.partitions))), F.col("part"))
    row_chunks, query_chunks = cells(per_part, chunk_rows), cells(per_query, chunk_queries)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = placed.withColumn("rc", F.pmod(F.xxhash64("vec_id"), row_chunks).cast("int")).withColumn("qc", every(query_chunks))
    right = sent.withColumn("qc", F.pmod(F.xxhash64("qid"), query_chunks).cast("int")).withColumn("rc", every(row_chunks))

    def rank(one: pa.Table, two: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(one) and len(two):
            asked_ids = two["qid"].to_numpy()
            for qid, (ids, scores) in zip(asked_ids.tolist(), best_rows(_matrix(two["v"]), _matrix(one["v"]), one["vec_id"].to_numpy(), k + 1), strict=True):
                out.append((np.full(len(ids), qid), ids, scores))
        return pa.table(dict(zip(("qid", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    key = ["part", "rc", "qc"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(rank, "qid bigint, vec_id bigint, score double")
    order = [F.desc("score"), F.asc("vec_id")]
    kept = near.withColumn("n", F.row_number().over(W.partitionBy("qid").orderBy(*order))).where(F.col("n") <= k + 1)
    members = asked.join(questions, ["h", "v"]).select(F.col("vec_id").alias("query_id"), "qid")
    told = members.join(kept.drop("n"), "qid").where("query_id != vec_id")
    told = told.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return told.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
