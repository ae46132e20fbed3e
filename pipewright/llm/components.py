"""Connected components of an edge table, without a driver-side or single-task union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, settle


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the nodes of an edge list that are not their own smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = flat[: len(a)], flat[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task become (node, root) stars; what is held is never more than a few batches."""
    held: list[np.ndarray] = []
    size = 0

    def out():
        node, root = _forest(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        return node, root

    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        size += batch.num_rows
        if size > 2_000_000:
            node, root = out()
            if len(node) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])
                held, size = [], 0
            else:
                held, size = [np.stack([node, root])], len(node)
    if held:
        node, root = out()
        if len(node):
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["a", "b"])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long, no nulls) that is not itself the smallest of its component.

    Each task first reduces its edges to a forest. Rounds of large-star and small-star then hang every
    node on the smallest node known; both are minima over a node's neighbours, which Spark combines
    before the shuffle, joined back to the edges, where AQE splits a hub's rows. A round ends in a
    written table, so a lost executor costs at most that round. Repeated edges and loops do no harm.
    """
    spark = edges.sparkSession
    now = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(lean(_contract), "a long, b long"), "edges", few=True)
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        # Large star: the larger neighbours of each node go to the smallest of its neighbourhood.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        # Small star: the smaller neighbours of each node, and the node, go to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        after = settle(small.union(low.select("a", F.col("low").alias("b"))).distinct(), "edges", few=True)
        # Done when every node has one parent and no parent has a parent.
        many = after.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
        deep = after.select("a").join(after.select(F.col("b").alias("a")), "a", "left_semi").limit(1)
        if many.isEmpty() and deep.isEmpty():
            return after.select(F.col("a").alias("node"), F.col("b").alias("component"))
        now = after
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
