"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.tables import stored


def components(edges: DataFrame) -> DataFrame:
    """One row (node, component) per node that has an edge; equal components mean connected.

    ``edges`` has two 64-bit columns a and b; direction, repeats and loops do
    not matter. In every round each node is merged into its least neighbour,
    in an order drawn anew (a one-to-one hash of 64-bit numbers), and the
    edges are carried over to the merged nodes, until none is left: a number
    of rounds that grows with the logarithm of the nodes, chains included.
    Each round's tables are written to the shared folder. A node with very
    many neighbours meets its minimum in map-side steps, and the joins have
    one row per node on one side, so that adaptive execution can split it.
    """
    hashed = stored(edges.where("a != b").select(F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y")).distinct())
    merged: list[DataFrame] = []
    while not hashed.isEmpty():
        both = hashed.select("x", "y").unionAll(hashed.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("y"))
        step = stored(least.select(F.col("x").alias("node"), F.xxhash64(F.least("x", "y")).alias("into")))
        merged.append(step)
        moved = (hashed.join(step.select(F.col("node").alias("x"), F.col("into").alias("p")), "x")
                 .join(step.select(F.col("node").alias("y"), F.col("into").alias("q")), "y").where("p != q"))
        hashed = stored(moved.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).distinct())
    nodes = edges.select(F.col("a").alias("node")).unionAll(edges.select("b")).distinct()
    if not merged:
        return nodes.withColumn("component", F.col("node"))

    def onward(found: DataFrame, step: DataFrame) -> DataFrame:
        # a node that lost all its edges has its last name; it moves with the later hashes no more
        later = step.select(F.col("node").alias("component"), F.col("into").alias("later"))
        return found.join(later, "component", "left").select("node", F.coalesce("later", "component").alias("component"))

    return reduce(onward, merged, nodes.withColumn("component", F.xxhash64("node")))


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For ``n`` local nodes and edges between them, the smallest node that each is connected with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return label
        label = new
