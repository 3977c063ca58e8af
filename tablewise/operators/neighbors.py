"""Exact nearest neighbours, spread over leaves of a partition tree.

A small base is sent to the tasks behind a size check. A larger one is cut into leaves by
a tree fitted on a bounded sample. Each query first searches its own leaf, which gives an
upper bound of its k-th distance; it is then sent only to the leaves whose bounding box is
nearer than that bound. A task searches its rows through a small tree of the same kind. Both steps keep k rows per query, never the pairs. A crowded leaf
(for example many copies of one point) is split by key hash; copies are not compared with
the other splits because a bound of zero prunes them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewise.operators.measures import hash_uniform, measure, number

NOBODY = np.iinfo(np.int64).max

BROADCAST_VALUES = 2_000_000  # numbers a base may hold to be sent to every task
SAMPLE_VALUES = 4_000_000  # numbers of the sample the tree is fitted on
LEAF_ROWS = 20_000  # rows of one distributed leaf
QUERY_ROWS = 50_000  # queries one task takes for a leaf
DEALT_ROWS = 2_000  # rows that are not worth a shuffle
LOCAL_ROWS = 512  # rows of one leaf of the small tree inside a task
VISITED_ROWS = 4096  # queries held against such a leaf at once
RESULT = "id long, neighbor long, distance double"


def vectors(df: DataFrame, key: str, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(id, vec, keep...): standardised numeric columns, a missing value at the mean."""
    exprs = {f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("a", F.avg), ("s", F.stddev_pop))}
    return scaled_vectors(df, key, columns, measure(df, **exprs), keep)


def scaled_vectors(df: DataFrame, key: str, columns: Sequence[str], row, keep: Sequence[str] = ()) -> DataFrame:
    cells = [F.coalesce((number(c) - (row[f"a{i}"] or 0.0)) / (row[f"s{i}"] or 1.0), F.lit(0.0)) for i, c in enumerate(columns)]
    return df.select(F.col(key).cast("long").alias("id"), F.array(*cells).alias("vec"), *keep)


EMPTY = {"id": "int64", "neighbor": "int64", "distance": "float64"}


class LocalTree:
    """Splits of the rows one task holds; copies of one point are cut into leaves of bounded size."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, rows: int | None = None):
        self.rows = rows or LOCAL_ROWS
        self.nodes: list[list] = []  # feature, cut, low child, high child, leaf
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []  # of each node
        self.members: list[np.ndarray] = []
        self.pieces: dict[int, int] = {}  # leaves that hold copies of one point, by the first of them
        self.points, self.ids = points, ids
        self._grow(np.arange(len(points)))
        self.table = [np.array(c) for c in zip(*self.nodes)]
        self.leaf_points = [points[m] for m in self.members]
        self.leaf_ids = [ids[m] for m in self.members]
        self.lo = np.array([p.min(axis=0) for p in self.leaf_points])
        self.hi = np.array([p.max(axis=0) for p in self.leaf_points])

    def _grow(self, at: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append([0, 0.0, -1, -1, -1])
        part = self.points[at]
        low, high = part.min(axis=0), part.max(axis=0)
        self.boxes.append((low, high))
        if len(at) > self.rows:
            spread = high - low
            f = int(np.argmax(spread))
            if spread[f] > 0:
                cut = middle_cut(part[:, f])
                side = part[:, f] < cut
                self.nodes[me][:2] = [f, cut]
                self.nodes[me][2] = self._grow(at[side])
                self.nodes[me][3] = self._grow(at[~side])
                return me
        self.nodes[me][4] = len(self.members)
        pieces = [at[s : s + self.rows] for s in range(0, max(1, len(at)), self.rows)]
        self.pieces[len(self.members)] = len(pieces)
        self.members += pieces
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        return descend(x, *self.table)

    def nearest(self, q: np.ndarray, qid: np.ndarray, k: int, same: bool, bound: np.ndarray | None = None) -> pd.DataFrame:
        """The k nearest rows of each query within its bound, smaller ids first at equal distances: its own leaf first, then the leaves within reach."""
        n = len(q)
        dist = np.full((n, k), np.inf if bound is None else 0.0)
        if bound is not None:
            dist[:] = bound[:, None]
        near = np.full((n, k), NOBODY, dtype=np.int64)  # after every row at the same distance

        def visit(leaf: int, at: np.ndarray) -> None:
            b, bid = self.leaf_points[leaf], self.leaf_ids[leaf]
            d2 = np.zeros((len(at), len(b)))
            for j in range(q.shape[1]):
                gap = q[at, j, None] - b[None, :, j]
                d2 += gap * gap
            d = np.sqrt(d2)
            if same:
                d[qid[at, None] == bid[None, :]] = np.inf
            all_d = np.concatenate([dist[at], d], axis=1)
            all_b = np.concatenate([near[at], np.broadcast_to(bid, d.shape)], axis=1)
            if all_d.shape[1] > 4 * k:  # all within the k-th distance, ties included, come first
                limit = np.partition(all_d, k - 1, axis=1)[:, k - 1 : k]
                width = max(k, int((all_d <= limit).sum(axis=1).max()))
                pick = np.argpartition(all_d, width - 1, axis=1)[:, :width]
                all_d, all_b = np.take_along_axis(all_d, pick, axis=1), np.take_along_axis(all_b, pick, axis=1)
            pick = np.lexsort((all_b, all_d), axis=1)[:, :k]
            dist[at] = np.take_along_axis(all_d, pick, axis=1)
            near[at] = np.take_along_axis(all_b, pick, axis=1)

        def visits(leaf: int, at: np.ndarray) -> None:
            for lo in range(0, len(at), VISITED_ROWS):
                visit(leaf, at[lo : lo + VISITED_ROWS])

        own = self.assign(q)
        order = np.argsort(own, kind="stable")
        leaves, first = np.unique(own[order], return_index=True)
        for leaf, at in zip(leaves.tolist(), np.split(order, first[1:])):
            visits(leaf, at)
        stack = [(0, np.arange(n))]  # the queries go down the tree together; a branch is entered by those that may find a nearer row there
        while stack:
            node, at = stack.pop()
            lo, hi = self.boxes[node]
            reach = np.zeros(len(at))
            for j in range(q.shape[1]):
                gap = np.maximum(lo[j] - q[at, j], 0) + np.maximum(q[at, j] - hi[j], 0)
                reach += gap * gap
            reach = np.sqrt(reach)
            near_enough = reach <= dist[at].max(axis=1)
            at, reach = at[near_enough], reach[near_enough]
            if not len(at):
                continue
            _, _, below, above, leaf = self.nodes[node]
            if leaf < 0:
                stack += [(above, at), (below, at)]
                continue
            for part in range(leaf, leaf + self.pieces[leaf]):
                visits(part, at[(own[at] != part) & (reach <= dist[at].max(axis=1))])
        rows, cols = np.nonzero((near != NOBODY) & np.isfinite(dist))
        return pd.DataFrame({"id": qid[rows], "neighbor": near[rows, cols], "distance": dist[rows, cols]})


    def counted(self, q: np.ndarray, radius: float) -> np.ndarray:
        """How many rows are within the radius of each query; leaves that lie inside it whole are not looked into."""
        out = np.zeros(len(q), dtype=np.int64)
        for leaf, points in enumerate(self.leaf_points):
            near, far = np.zeros(len(q)), np.zeros(len(q))
            for j in range(q.shape[1]):
                below, above = self.lo[leaf, j] - q[:, j], q[:, j] - self.hi[leaf, j]
                near += np.maximum(np.maximum(below, above), 0) ** 2
                far += np.maximum(np.abs(below), np.abs(above)) ** 2
            inside = np.sqrt(far) <= radius * (1 - 1e-9)
            out[inside] += len(points)
            at = np.flatnonzero((np.sqrt(near) <= radius) & ~inside)
            for lo in range(0, len(at), 4096):
                part = at[lo : lo + 4096]
                d2 = np.zeros((len(part), len(points)))
                for j in range(q.shape[1]):
                    gap = q[part, j, None] - points[None, :, j]
                    d2 += gap * gap
                out[part] += (np.sqrt(d2) <= radius).sum(axis=1)
        return out


def middle_cut(values: np.ndarray) -> float:
    """A cut with rows on both sides: the median, or the next value above a heavy minimum."""
    cut = float(np.median(values))
    low = values.min()
    return cut if cut > low else float(values[values > low].min())


def descend(x, feature, cut, low, high, leaf) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    while True:
        inner = leaf[node] < 0
        if not inner.any():
            return leaf[node]
        at = node[inner]
        node[inner] = np.where(x[inner, feature[at]] < cut[at], low[at], high[at])


def matrix(col: pd.Series, width: int) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(float) if len(col) else np.zeros((0, width))


def gathered(rows: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of rows (id, vec) on the driver, 8 bytes a number: no object is made per row. Every vector has ``width`` numbers, none of them null."""
    table = rows.select("id", "vec").toArrow()
    values = [c.flatten().to_numpy(zero_copy_only=False) for c in table.column("vec").chunks]
    ids = table.column("id").to_numpy()
    return ids, np.concatenate([np.zeros(0), *values]).astype(float).reshape(len(ids), width)


class Leaves:
    """Axis-parallel splits fitted on a sample; assigns a leaf number to each vector."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[list] = []
        self.count = 0
        self._grow(sample, leaves)
        self.table = [np.array(c) for c in zip(*self.nodes)]

    def _grow(self, points: np.ndarray, leaves: int) -> int:
        me = len(self.nodes)
        self.nodes.append([0, 0.0, -1, -1, -1])
        if leaves > 1 and len(points) >= 8:
            spread = points.max(axis=0) - points.min(axis=0)
            f = int(np.argmax(spread))
            if spread[f] > 0:
                cut = middle_cut(points[:, f])
                low = points[:, f] < cut
                self.nodes[me][:2] = [f, cut]
                self.nodes[me][2] = self._grow(points[low], leaves // 2)
                self.nodes[me][3] = self._grow(points[~low], leaves - leaves // 2)
                return me
        self.nodes[me][4] = self.count
        self.count += 1
        return me

    def assign(self, x: np.ndarray) -> np.ndarray:
        return descend(x, *self.table)

    def enclose(self, leaf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Leaves:
        """Give every node the box of the leaves below it; a leaf that is not named is empty."""
        width = lo.shape[1] if len(lo) else 1
        self.lo, self.hi = np.full((len(self.nodes), width), np.inf), np.full((len(self.nodes), width), -np.inf)
        at = {int(x): i for i, x in enumerate(leaf)}
        for node in range(len(self.nodes) - 1, -1, -1):  # children come after their parent
            _, _, low, high, own = self.nodes[node]
            if own < 0:
                self.lo[node], self.hi[node] = np.minimum(self.lo[low], self.lo[high]), np.maximum(self.hi[low], self.hi[high])
            elif own in at:
                self.lo[node], self.hi[node] = lo[at[own]], hi[at[own]]
        return self

    def within(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(box, leaf) for every leaf whose box is no further than its bound from a box, and the nodes looked at per box.

        The boxes go down the tree together; a branch is entered by those that its box is near enough to.
        """
        rows, leaves, looked = [], [], 0
        stack = [(0, np.arange(len(lo)))]
        while stack:
            node, at = stack.pop()
            looked += len(at)
            d2 = np.zeros(len(at))
            with np.errstate(invalid="ignore"):
                for j in range(lo.shape[1]):
                    gap = np.maximum(self.lo[node, j] - hi[at, j], 0) + np.maximum(lo[at, j] - self.hi[node, j], 0)
                    d2 += gap * gap
            at = at[np.sqrt(d2) <= bound[at]] if np.isfinite(self.lo[node]).all() else at[:0]
            if not len(at):
                continue
            _, _, low, high, own = self.nodes[node]
            if own < 0:
                stack += [(high, at), (low, at)]
            else:
                rows.append(at)
                leaves.append(np.full(len(at), own))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none, *leaves]), looked


def knn(queries: DataFrame, base: DataFrame, k: int, same: bool = False) -> DataFrame:
    """(id, neighbor, distance, rank) of the k nearest base rows of each query by Euclidean distance.

    Both frames have (id long, vec array<double>). With ``same`` a row is not its own neighbour. Equal distances go
    to smaller ids, whatever the order of the rows; so of many copies of a point only the first k (and the row itself) can count.
    """
    queries, base = queries.select("id", "vec"), base.select("id", "vec")
    head = base.select(F.size("vec").alias("d")).first()
    if head is None:
        return queries.sparkSession.createDataFrame([], RESULT + ", rank int")
    width, n = head["d"], base.count()
    copy = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    base = base.withColumn("copy", copy).where(F.col("copy") <= k + 1).drop("copy")
    if n * width <= BROADCAST_VALUES:
        found = _against_small(queries, base, k, same, width)
    else:
        found = _through_leaves(queries, base, k, same, width, n)
    w = Window.partitionBy("id").orderBy("distance", "neighbor")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dealt(df: DataFrame, n: int, rows: int = QUERY_ROWS) -> DataFrame:
    """Rows (id, vec) that cost much each, dealt over all cores and at most about ``rows`` to a task; ``n`` is their number."""
    if n <= DEALT_ROWS:
        return df
    parts = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-n // DEALT_ROWS)), -(-n // rows))
    return df.repartition(parts, "id", "vec")


def _against_small(queries, base, k, same, width):
    ids, points = gathered(base, width)  # bounded by BROADCAST_VALUES
    tree = queries.sparkSession.sparkContext.broadcast(LocalTree(points, ids))

    def search(batches):
        for pdf in batches:
            if len(pdf):
                yield tree.value.nearest(matrix(pdf["vec"], width), pdf["id"].to_numpy(), k, same)

    return dealt(queries, queries.count()).mapInPandas(search, RESULT)


def _through_leaves(queries, base, k, same, width, n):
    spark = queries.sparkSession
    want = min(n, SAMPLE_VALUES // width)
    base = base.persist()  # else the copies are counted anew for the sample, the boxes and both searches
    _, sample = gathered(base.where(hash_uniform("id", 7) < min(1.0, want / n)).limit(2 * want), width)
    tree = spark.sparkContext.broadcast(Leaves(sample, max(1, min(-(-n // LEAF_ROWS), len(sample) // 8))))

    def assign(batches):
        for pdf in batches:
            yield pdf.assign(leaf=tree.value.assign(matrix(pdf["vec"], width)).astype("int64"))

    placed = "id long, vec array<double>, leaf long"
    b, q = base.mapInPandas(assign, placed).persist(), queries.mapInPandas(assign, placed)
    boxes = b.groupBy("leaf").agg(
        F.count("*").alias("n"), F.array(*[F.min(F.col("vec")[j]) for j in range(width)]).alias("lo"), F.array(*[F.max(F.col("vec")[j]) for j in range(width)]).alias("hi")
    ).orderBy("leaf").toPandas()  # one row per leaf
    base.unpersist()
    leaf_ids, lo, hi = boxes["leaf"].to_numpy(), matrix(boxes["lo"], width), matrix(boxes["hi"], width)
    splits = {int(leaf): int(-(-c // (2 * LEAF_ROWS))) for leaf, c in zip(leaf_ids, boxes["n"])}
    split_of = _lookup(splits, 1)
    b = b.withColumn("part", F.pmod(F.xxhash64("id"), split_of(F.col("leaf"))).cast("int"))
    q = q.withColumn("part", F.pmod(F.xxhash64("id"), split_of(F.col("leaf"))).cast("int")).persist()
    first = _search(q.withColumn("bound", F.lit(float("inf"))), b, k, same, width, splits).persist()
    reach = first.groupBy("id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("bound"))
    enclosed = spark.sparkContext.broadcast((tree.value.enclose(leaf_ids, lo, hi), splits))
    shape = "id long, vec array<double>, bound double, leaf long, part int"

    def route(batches):
        nodes, splits = enclosed.value
        for pdf in batches:
            x = matrix(pdf["vec"], width)
            r, leaf, _ = nodes.within(x, x, pdf["bound"].to_numpy())
            times = np.array([splits[int(k)] for k in leaf], dtype=np.int64)
            r, leaf = np.repeat(r, times), np.repeat(leaf, times)
            part = np.arange(len(r)) - np.repeat(np.cumsum(times) - times, times)
            own = (leaf == pdf["leaf"].to_numpy()[r]) & (part == pdf["part"].to_numpy()[r])
            r, leaf, part = r[~own], leaf[~own], part[~own]
            src = pdf.iloc[r]
            yield pd.DataFrame({"id": src["id"].to_numpy(), "vec": src["vec"].to_numpy(), "bound": src["bound"].to_numpy(), "leaf": leaf, "part": part.astype("int32")})

    routed = q.join(reach.hint("merge"), "id", "left").fillna(float("inf"), ["bound"]).select("id", "vec", "leaf", "part", "bound").mapInPandas(route, shape).persist()
    return first.union(_search(routed, b, k, same, width, splits))


def _lookup(values: dict[int, int], default: int):
    """Small driver map as a column function; only the entries that differ from the default are listed."""
    odd = {k: v for k, v in values.items() if v != default}

    def at(c: Column) -> Column:
        if not odd:
            return F.lit(default)
        table = F.create_map(*[x for kv in odd.items() for x in (F.lit(kv[0]).cast("long"), F.lit(kv[1]))])
        return F.coalesce(F.try_element_at(table, c), F.lit(default))

    return at


def _search(q: DataFrame, b: DataFrame, k: int, same: bool, width: int, splits: dict[int, int]) -> DataFrame:
    """Top k of each query inside the (leaf, part) it was sent to; crowded query groups are chunked."""
    load = {r["leaf"]: int(-(-r["n"] // (QUERY_ROWS * splits.get(r["leaf"], 1)))) for r in q.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    chunks = _lookup({leaf: max(1, c) for leaf, c in load.items()}, 1)
    q = q.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), chunks(F.col("leaf"))).cast("int"))
    b = b.withColumn("chunk", F.explode(F.sequence(F.lit(0), (chunks(F.col("leaf")) - 1).cast("int"))))

    def search(qs: pd.DataFrame, bs: pd.DataFrame) -> pd.DataFrame:
        if len(qs) == 0 or len(bs) == 0:
            return pd.DataFrame({c: [] for c in EMPTY}).astype(EMPTY)
        tree = LocalTree(matrix(bs["vec"], width), bs["id"].to_numpy())
        return tree.nearest(matrix(qs["vec"], width), qs["id"].to_numpy(), k, same, qs["bound"].to_numpy())

    keys = ["leaf", "part", "chunk"]
    return q.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(search, RESULT)
