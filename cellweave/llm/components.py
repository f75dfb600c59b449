"""Connected components of a graph given as edges between whole numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._shared import discard, stored


def local_components(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of 0 .. count-1, over the edges a[i]-b[i]."""
    label = np.arange(count)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while not np.array_equal(up := label[label], label):
            label = up


def connected(edges: DataFrame, folder: str) -> DataFrame:
    """(node, label): the smallest node reachable, for each node of ``edges`` (a, b).

    Each round takes the smallest label among neighbours, then the label of the
    label, so rounds grow with the logarithm of a path's length. A round's table is
    written in the shared folder, and the one before it is removed. Nothing but whether anything changed reaches the driver.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).union(edges.select("b", "a")).distinct(), f"{folder}/links")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("label")), f"{folder}/round0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels.select(F.col("node").alias("next"), "label"), "next").groupBy("node").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        jumped = lower.join(above, "label").select("node", "was", F.least("label", "above").alias("label"))
        told = stored(jumped, f"{folder}/round{step}")
        discard(edges.sparkSession, f"{folder}/round{step - 1}")
        if told.where("label < was").isEmpty():
            return told.select("node", "label")
        labels = told.select("node", "label")
