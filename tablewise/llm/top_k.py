"""Exact top-k search by inner product with vector-approximation files.

Every component of a vector is a whole number, and each dimension's range is cut into cells of equal width. The approximation
of a vector is the cell of each component, one byte each. For a query the cells give a lower and an upper bound of
the inner product with every vector. The search has two passes over blocks of vectors:

1. The approximations alone are scanned: the k-th largest lower bound over all vectors is a score that the result reaches.
2. Of the vectors whose upper bound reaches that score, exact ones are read in the order of their upper bounds until the k-th best
   exact score is above the next bound. Each block's k best are merged.

Queries are dealt to blocks of their own. Each block of vectors meets each block of queries in a merge join, in a task chosen by a slot and the block of queries, so neither
side is ever broadcast or gathered. There are as many slots as keep the tasks busy, so the copies of the queries grow with the tasks, not with tasks times blocks.

Results in odd cases: rows whose ``vec_id`` is null neither ask nor are candidates; vectors that are null or hold a null or a component that is not finite take no part; vectors of another
dimension than the query's are no candidates of it; equal scores go to the smaller id; a row with the query's own id is no candidate;
of several rows with one query id the largest vector asks, and each row is a candidate; fewer candidates than k give all of them;
scores must fit 64 bits, else Arrow raises an error; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import tasks, written

#: Vectors and queries of a block.
BLOCK = 4096
QUERIES = 1024
#: Pairs of a slot and a block of queries for each task, and blocks of vectors of a slot at most (about).
PAIRS = 2
SLOT_BLOCKS = 64
#: Cells of a dimension.
CELLS = 256
_FILES = "dim int, block long, ids binary, codes binary, exact binary"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, or null if a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double")))


def ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest component of each dimension, by number of dimensions: as many rows as dimensions there are."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for b in batches:
            for dim, _, rows in _by_dim(b):
                edge = np.stack([rows.min(axis=0), rows.max(axis=0)])
                old = found.get(dim, edge)
                found[dim] = np.stack([np.minimum(old[0], edge[0]), np.maximum(old[1], edge[1])])
        for dim, edge in found.items():
            yield pa.record_batch([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), pa.array(edge[0]), pa.array(edge[1])], ["dim", "at", "low", "high"])

    edges = vectors.mapInArrow(of, "dim int, at int, low double, high double").groupBy("dim", "at").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = edges.orderBy("dim", "at").collect()
    for dim in sorted({r["dim"] for r in rows}):
        own = [r for r in rows if r["dim"] == dim]
        out[dim] = (np.array([r["low"] for r in own]), np.array([r["high"] for r in own]))
    return out


def _by_dim(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, ids and matrix of the vectors of a batch ``(vec_id, vector)``."""
    ids, lists = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    values, begin = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
    for dim in np.unique(size[size > 0]).tolist():
        on = np.flatnonzero(size == dim)
        yield dim, ids[on], values[begin[on][:, None] + np.arange(dim)]


def _cells(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Width of a dimension's cells, a whole number."""
    return np.maximum(1, np.floor((high - low) / CELLS) + 1)


def _bounds(q: np.ndarray, codes: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of queries and approximated vectors.

    A cell's last number is its first and the same more in every cell of a dimension, so one product gives both bounds.
    Whole numbers below 2 ** 53 are exact; beyond that the bounds are widened by more than rounding can take away.
    """
    width = _cells(low, high)
    first = q @ (low + codes * width).T
    greatest = np.maximum(np.abs(low), np.abs(high)) + width
    slack = np.abs(q) @ greatest
    slack = np.where(slack < 2**52, 0, slack * 1e-12)
    return first + (np.minimum(q, 0) @ (width - 1) - slack)[:, None], first + (np.maximum(q, 0) @ (width - 1) + slack)[:, None]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of one query with vectors."""
    if np.abs(q).sum() * np.abs(v).max(initial=0) < 2**53:
        return (v @ q).astype(np.int64)
    exact = [int(x) for x in q]
    return np.array([sum(a * int(b) for a, b in zip(exact, row, strict=True)) for row in v], dtype=object)


def _matrix(blob: bytes, dim: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, dim)


def approximated(vectors: DataFrame, edges: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Blocks of ids, cells and exact vectors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, ids, rows in _by_dim(b):
                low, high = edges[dim]
                codes = ((rows - low) // _cells(low, high)).astype(np.uint8)
                for lo in range(0, len(ids), BLOCK):
                    part = slice(lo, lo + BLOCK)
                    row = [dim, int(ids[lo]), ids[part].astype("<i8").tobytes(), codes[part].tobytes(), rows[part].astype("<f8").tobytes()]
                    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.record_batch([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["dim", "block", "ids", "codes", "exact"])

    return vectors.mapInArrow(of, _FILES)


def _meeting(files: DataFrame, queries: DataFrame, slots: int, blocks: int, columns: list[str]) -> DataFrame:
    """Each block of vectors with each block of queries of its dimension, as rows ``(dim, columns, q_ids, q_exact, q_reach)``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list[tuple[int, float, np.ndarray]]] = {}

        def row(key: tuple[int, int]) -> pa.RecordBatch:
            own = waiting.pop(key)
            blobs = [np.array([x[k] for x in own], kind).tobytes() for k, kind in ((0, "<i8"), (2, "<f8"), (1, "<f8"))]
            return pa.record_batch([pa.array([k], pa.int32()) for k in key] + [pa.array([x], pa.binary()) for x in blobs], ["dim", "q_block", "q_ids", "q_exact", "q_reach"])

        for b in batches:
            for q_id, vector, block, reach in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                own = waiting.setdefault((key := (len(vector), block)), [])
                own.append((q_id, reach, np.asarray(vector.values)))
                if len(own) >= QUERIES:
                    yield row(key)
        for key in list(waiting):
            yield row(key)

    asked = queries.withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).select("vec_id", "vector", "q_block", "reach")
    asked = asked.repartition("q_block").mapInArrow(gather, "dim int, q_block int, q_ids binary, q_exact binary, q_reach binary")
    asked = asked.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    spread = files.select("dim", *columns, F.pmod(F.xxhash64("block"), F.lit(slots)).cast("int").alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("q_block"))
    # Spark takes the queries for as small as their file, without the copies, and would gather these on the driver
    return spread.join(asked.hint("merge"), ["dim", "slot", "q_block"]).select("dim", *columns, "q_ids", "q_exact", "q_reach")


def _best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, asks: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the ``k`` rows of ``vectors(vec_id, embedding)`` with the largest inner product for each row where ``asks`` holds."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding"), scale).alias("vector"), asks.alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
    edges = ranges(rows.select("vec_id", "vector"))
    files = written(approximated(rows.select("vec_id", "vector"), edges), "approximations")
    queries = written(rows.where("asks").groupBy("vec_id").agg(F.max("vector").alias("vector")), "queries")
    blocks = -(-max(1, queries.count()) // QUERIES)
    slots = max(-(-PAIRS * tasks(vectors) // blocks), -(-files.count() // SLOT_BLOCKS))
    sent = vectors.sparkSession.sparkContext.broadcast(edges)  # two numbers for each dimension

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                low, high = sent.value[r["dim"]]
                ids, q_ids = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                least, _ = _bounds(_matrix(r["q_exact"], r["dim"]), _matrix(r["codes"], r["dim"], "u1"), low, high)
                least[q_ids[:, None] == ids[None, :]] = -np.inf
                best = least if least.shape[1] <= k else np.partition(least, least.shape[1] - k, axis=1)[:, -k:]
                yield pa.record_batch([pa.array(np.repeat(q_ids, best.shape[1])), pa.array(best.ravel())], ["query_id", "least"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                low, high = sent.value[r["dim"]]
                ids, vectors = np.frombuffer(r["ids"], "<i8"), _matrix(r["exact"], r["dim"])
                q_ids, q_all, reach = np.frombuffer(r["q_ids"], "<i8"), _matrix(r["q_exact"], r["dim"]), np.frombuffer(r["q_reach"], "<f8")
                _, most = _bounds(q_all, _matrix(r["codes"], r["dim"], "u1"), low, high)
                most[q_ids[:, None] == ids[None, :]] = -np.inf
                out: list[tuple[int, int, int]] = []
                for i, q in enumerate(q_all):
                    near = np.flatnonzero((most[i] >= reach[i]) & (most[i] > -np.inf))
                    near = near[np.argsort(-most[i][near], kind="stable")]
                    found: list[tuple[int, int]] = []
                    for lo in range(0, len(near), 2 * k):
                        some = near[lo : lo + 2 * k]
                        if len(found) >= k and -found[k - 1][0] > most[i][some[0]]:
                            break  # no vector left can be among the k best
                        found = sorted(found + [(-int(s), int(v)) for s, v in zip(_products(q, vectors[some]), ids[some], strict=True)])[:k]
                    out += [(int(q_ids[i]), v, -s) for s, v in found]
                if out:
                    yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    first = _meeting(files, queries.withColumn("reach", F.lit(float("-inf"))), slots, blocks, ["ids", "codes"])
    reach = _best(first.mapInArrow(lower, "query_id long, least double"), k, F.desc("least"))
    reach = reach.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("least")).otherwise(F.lit(float("-inf"))).alias("reach"))
    asked = queries.join(reach.withColumnRenamed("query_id", "vec_id").hint("merge"), "vec_id")
    second = _meeting(files, asked, slots, blocks, ["ids", "codes", "exact"])
    best = _best(second.mapInArrow(exact, "query_id long, vec_id long, score long"), k, F.desc("score"), F.col("vec_id"))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
