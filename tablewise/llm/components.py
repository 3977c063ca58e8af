"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.session import cut_lineage

#: A table of no more edges goes to one task; it has as many numbers as a small broadcast.
ONE_TASK = 100_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of all edges of a task: every node's parent is the smaller root, followed to its end."""
    a, b = (np.concatenate(x) for x in zip(*([np.zeros(0, np.int64)] * 2, *((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches)), strict=True))
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes)).tolist()

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        parent[max(x, y)] = min(x, y)
    found = np.array([root(x) for x in range(len(nodes))], np.int64)
    yield pa.record_batch([pa.array(nodes), pa.array(nodes[found])], ["node", "root"])


def _towards_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """(other, least) for the neighbours ``other`` of each ``node``; least: the smallest of ``node`` and those neighbours.

    Minima are formed before the shuffle; the join brings one row per node to its edges, so Spark can split a node with many.
    """
    least = edges.groupBy(node).agg(F.min(other).alias("least")).withColumn("least", F.least("least", node))
    return edges.join(least, node).select(F.col(other).alias("u"), F.col("least").alias("v"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that it is connected with, for every node of ``edges(a, b)``.

    Each round points every node's larger neighbours to its smallest neighbour, then every node and its smaller
    neighbours. Rounds end when nothing changes, after some log n of them; the edges never grow in number.
    A table of up to ``ONE_TASK`` edges is done in one task instead, with the same result.
    Rows that repeat and edges from a node to itself are allowed (a node that has only the latter is its own root).
    """
    if edges.limit(ONE_TASK + 1).count() <= ONE_TASK:
        return edges.select("a", "b").coalesce(1).mapInArrow(_joined, "node long, root long")
    alone = edges.where("a = b").select(F.col("a").alias("node")).distinct()
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut_lineage(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both, "u", "v").where("u > v").distinct()
        small = _towards_least(large, "u", "v")
        ends = large.groupBy("u").agg(F.min("v").alias("v"))
        edges = cut_lineage(small.where("u <> v").unionByName(ends).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    own = alone.join(found.select("node").unionByName(roots.select("node")), "node", "left_anti").withColumn("root", F.col("node"))
    return found.unionByName(roots).unionByName(own)
