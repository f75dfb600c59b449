"""Sharding by balanced label propagation under the law ``rows``: counts differ by one at most.

Documents are linked if their texts are equal. All linked documents begin in shards
drawn by a hash. In each round the documents of a text look at the shards of their
neighbours: every text takes, among the shards that still have room, the one in
which most of its documents are, and those elsewhere ask to move there. A shard has a quota of rows; it
admits what fits, text by text, and the rest look elsewhere in the next round. A
document that no round has settled, and one without links, which cuts no edge
wherever it goes, fills what room is left, so every shard ends exactly at its quota.

Joins of documents are on a text's digest and one of at least 64 parts, more as rows grow, so
no task holds all documents of a text. Counts by (text, part) and (text, shard) are aggregated
before they move, so a text with a third of all rows is a few rows there, and is spread over as
many shards as it needs. Numbering within a shard is split by a hash and put
together from a table of counts, so no task holds a shard.

Null text counts as no bytes and is equal to an empty one here. Null doc_ids and
repeated rows are placed like any other. No rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cellweave.llm._shared import ranked, shuffle_width, stored, work_dir


#: Parts at least that the documents of a text are dealt to.
PARTS = 64


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _lookup(values: list[int], key: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("bigint") for v in values)), key)


def propagate(linked: DataFrame, parts: DataFrame, quota: list[int], folder: str, rounds: int, bins: int) -> tuple[DataFrame, list[int]]:
    """Settle linked documents (row, text_key, part): (row, shard) of the settled, and the room left.

    ``row`` is a document's name, ``text_key`` its text's, ``part`` the part of that text's
    documents it is in; ``parts`` has a row (text_key, part) for each. A settled document stays.
    """
    shards = len(quota)
    state = stored(linked.select("row", "text_key", "part", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("settled")), f"{folder}/labels0")
    room = list(quota)
    for step in range(1, rounds + 1):
        open_ = [s for s in range(shards) if room[s] > 0]
        if not open_:
            break
        # how many of each text's documents are in each open shard; one that is settled weighs as much as any
        tally = state.groupBy("text_key", "shard").agg(F.count("*").alias("held"), F.sum(F.when(F.col("settled"), 0).otherwise(1)).alias("waiting"))
        waiting = tally.groupBy("text_key").agg(F.sum("waiting").alias("asking"))
        best = tally.where(F.col("shard").isin(open_)).groupBy("text_key").agg(F.max(F.struct("held", (-F.col("shard")).alias("s"))).alias("best"))
        some = F.get(F.array(*map(F.lit, open_)), F.pmod(F.xxhash64("text_key", F.lit(step)), F.lit(len(open_))).cast("int"))
        wish = waiting.where("asking > 0").join(best, "text_key", "left").select("text_key", "asking", F.coalesce(-F.col("best.s"), some).cast("int").alias("target"))
        # a shard admits whole texts while they fit, in the order of a hash; its numbering is split by that hash
        numbered = wish.withColumn("bin", F.pmod(F.xxhash64("text_key", F.lit(step)), F.lit(bins)))
        sums = numbered.groupBy("target", "bin").agg(F.sum("asking").alias("n"))
        before = W.partitionBy("target").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        starts = sums.select("target", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
        inside = W.partitionBy("target", "bin").orderBy("asking", "text_key").rowsBetween(W.unboundedPreceding, -1)
        placed = numbered.withColumn("ahead", F.coalesce(F.sum("asking").over(inside), F.lit(0))).join(starts, ["target", "bin"])
        limit = _lookup(room, F.col("target")) - F.col("start") - F.col("ahead")
        admitted = stored(placed.select("text_key", "target", F.least(F.col("asking"), F.greatest(F.lit(0), limit)).alias("admit")).where("admit > 0"), f"{folder}/admitted{step}")
        taken = {r["target"]: r["n"] for r in admitted.groupBy("target").agg(F.sum("admit").alias("n")).collect()}  # a row per shard
        if not taken:
            break
        # those already in the wished shard settle first
        told = admitted.join(numbered.select("text_key", "asking"), "text_key").join(parts, "text_key")
        partly = state.where(~F.col("settled")).join(told, ["text_key", "part"])
        order = [(F.col("shard") != F.col("target")).cast("int"), F.col("row")]
        whole = partly.where("admit >= asking").select("row", "target")
        split = partly.where("admit < asking")
        chosen = ranked(split, F.xxhash64("row"), ["text_key"], order, bins, "place").where("place < admit").select("row", "target")
        moved = whole.union(chosen)
        state = stored(
            state.join(moved, "row", "left").select("row", "text_key", "part", F.coalesce("target", "shard").alias("shard"), (F.col("settled") | F.col("target").isNotNull()).alias("settled")),
            f"{folder}/labels{step}",
        )
        for s, n in taken.items():
            room[s] -= n
        if state.where(~F.col("settled")).isEmpty():
            break
    return state.where("settled").select("row", "shard"), room


def shard(docs: DataFrame, shards: int = 16, rounds: int = 8, bin_rows: int = 50_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    spark = docs.sparkSession
    folder = work_dir(spark, "sharding")
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    told = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("text_key"))
    named = stored(told.withColumn("row", F.monotonically_increasing_id()), f"{folder}/documents")
    rows = named.count()
    bins = max(shuffle_width(spark), rows // bin_rows)
    # documents of one text in parts by a hash: the counts of parts meet, documents only by part
    dealt = named.withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(max(PARTS, bins))).cast("int"))
    held = dealt.groupBy("text_key", "part").agg(F.count("*").alias("held"))
    copies = held.groupBy("text_key").agg(F.sum("held").alias("copies")).where("copies > 1")
    parts = stored(held.select("text_key", "part").join(copies, "text_key"), f"{folder}/parts")
    sized = stored(dealt.join(parts, ["text_key", "part"], "left"), f"{folder}/sized")
    settled, room = propagate(sized.where("copies > 1"), parts.select("text_key", "part"), quotas(rows, shards), folder, rounds, bins)
    joined = sized.join(settled, "row", "left")
    # the rest fills the room left: the i-th goes to the shard whose stretch of room holds i
    rest = ranked(joined.where("shard is null"), F.xxhash64("row", F.lit(3)), [], [F.col("row")], bins, "place")
    ends, total = [], 0
    for n in room:
        total += n
        ends.append(total)
    fill = F.size(F.filter(F.array(*(F.lit(e).cast("bigint") for e in ends)), lambda e: F.col("place") >= e))
    everything = joined.where("shard is not null").unionByName(rest.withColumn("shard", fill).drop("place"))
    everything = stored(everything.select("row", "doc_id", "size", "text_crc32", "shard"), f"{folder}/placed")
    slotted = ranked(everything, F.xxhash64("row", F.lit(4)), ["shard"], [F.col("row")], bins, "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
