"""Clustering, its measures, and principal coordinates."""

from __future__ import annotations

import copy
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up
from tablewise.operators import measures
from tablewise.operators.measures import hash_normal, hash_uniform, measure, number, quantiles, report
from tablewise.operators.neighbors import Leaves, LocalTree, knn, matrix, vectors
from tablewise.operators.transforms import principal_components
from tablewise.session import cut_lineage


def assembled(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(id, vec, features): scaled vectors for the learners."""
    return vectors(df, key, columns).withColumn("features", array_to_vector("vec"))


def kmeans_scan(df: DataFrame, key: str, columns: Sequence[str], max_k: int = 6, seed: int = 42) -> DataFrame:
    """Inertia and silhouette for k = 2..max_k, the best silhouette marked."""
    data = assembled(df, key, columns).persist()
    n = data.count()
    rows = []
    for k in range(2, max(2, min(max_k, n - 1)) + 1):
        model = KMeans(k=k, seed=seed).fit(data)
        rows.append((k, half_up(model.summary.trainingCost, 2), half_up(ClusteringEvaluator().evaluate(model.transform(data)))))
    data.unpersist()
    best = max(rows, key=lambda r: r[2])[0]
    return report(df, [(*r, r[0] == best) for r in rows], "k int, inertia double, silhouette double, best boolean")


def kmeans(df: DataFrame, key: str, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    data = assembled(df, key, columns)
    return KMeans(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def hierarchical(df: DataFrame, key: str, columns: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Top-down splits in place of bottom-up merging."""
    data = assembled(df, key, columns)
    return BisectingKMeans(k=k, seed=seed).fit(data).transform(data).select("id", F.col("prediction").alias("cluster"))


def mixtures(df: DataFrame, key: str, columns: Sequence[str], max_k: int = 4, seed: int = 42) -> DataFrame:
    """Log-likelihood and BIC of Gaussian mixtures."""
    data = assembled(df, key, columns).persist()
    n, d, rows = data.count(), len(columns), []
    for k in range(2, max_k + 1):
        ll = GaussianMixture(k=k, seed=seed, maxIter=30).fit(data).summary.logLikelihood
        free = k - 1 + k * d + k * d * (d + 1) // 2
        rows.append((k, half_up(ll, 2), half_up(free * math.log(n) - 2 * ll, 2)))
    data.unpersist()
    return report(df, rows, "k int, log_likelihood double, bic double")


def spectral(df: DataFrame, key: str, columns: Sequence[str], k: int, neighbors: int = 10) -> DataFrame:
    """Power iteration clustering of the nearest-neighbour graph: `pyspark.ml`'s for at most ``measures.ROWS_PER_TASK`` edges, whose graph grows in every round; else the same rounds over kept edges."""
    v = vectors(df, key, columns)
    near = knn(v, v, neighbors, same=True)
    edges = near.select(F.least("id", "neighbor").alias("src"), F.greatest("id", "neighbor").alias("dst"), F.exp(-F.col("distance") * F.col("distance")).alias("weight"))
    edges = cut_lineage(edges.groupBy("src", "dst").agg(F.max("weight").alias("weight")).where("weight > 0"))
    if edges.count() <= measures.ROWS_PER_TASK:
        return PowerIterationClustering(k=k, maxIter=15, weightCol="weight").assignClusters(edges).select("id", "cluster")
    points = power_vector(edges).select("id", array_to_vector(F.array("x")).alias("features"))
    return KMeans(k=k, seed=0, maxIter=20).fit(points).transform(points).select("id", F.col("prediction").alias("cluster"))


def power_vector(edges: DataFrame, iterations: int = 15, seed: int = 0) -> DataFrame:
    """(id, x): power iterations (Lin and Cohen) of the weights of undirected edges (src, dst, weight), every node's divided by their sum.

    Same steps, start and stop as `pyspark.ml`'s, whose graph is built anew in every round, but the start is drawn from the ids, not per partition.
    The edges are dealt by one end and kept; a round shuffles one number per node, and partial sums of the products. All joins are merge joins: Spark takes what comes
    from a small file for small, and would bring a number per node, or all edges, to the driver.
    """
    edges = edges.where("src <> dst").select("src", "dst", "weight")
    both = edges.union(edges.select("dst", "src", "weight"))
    degree = both.groupBy("src").agg(F.sum("weight").alias("degree"))
    kept = kept_by_end(both.join(degree.hint("merge"), "src").select("src", "dst", (F.col("weight") / F.greatest("degree", F.lit(2.0**-52))).alias("share")))
    try:
        now = cut_lineage(degree.select(F.col("src").alias("id"), hash_normal("src", seed).alias("x")))
        n, size = now.agg(F.count(F.lit(1)), F.sum(F.abs("x"))).first()
        now = now.select("id", (F.col("x") / F.lit(size)).alias("x"))
        tolerance, before, change = max(1e-5 / max(1, n), 1e-8), math.inf, math.inf
        for _ in range(iterations if n else 0):
            if change <= tolerance:
                break
            step = cut_lineage(products(kept, now).join(now.hint("merge"), "id"))
            norm = step.agg(F.sum(F.abs("y"))).first()[0]
            step = step.withColumn("y", F.col("y") / F.lit(norm))
            moved = step.agg(F.sum(F.abs(F.col("y") - F.col("x")))).first()[0]
            change, before = abs(moved - before), moved
            now = step.select("id", F.col("y").alias("x"))
    finally:
        kept.unpersist()
    return now


def kept_by_end(edges: DataFrame) -> DataFrame:
    """Edges dealt and sorted by ``dst``, and kept so."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(parts, "dst").sortWithinPartitions("dst").persist()


def products(kept: DataFrame, now: DataFrame) -> DataFrame:
    """(id, y): the matrix of shares times the vector (id, x)."""
    return kept.join(now.withColumnRenamed("id", "dst").hint("merge"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("share") * F.col("x")).alias("y"))


def calinski_harabasz(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Between over within spread, from the moments of each cluster in one aggregate."""
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(number(c)).alias(f"a{i}") for i, c in enumerate(columns)], *[F.var_pop(number(c)).alias(f"v{i}") for i, c in enumerate(columns)]).collect()
    n, k = sum(r["n"] for r in per), len(per)
    mean = [sum(r["n"] * r[f"a{i}"] for r in per) / n for i in range(len(columns))]
    between = sum(r["n"] * (r[f"a{i}"] - mean[i]) ** 2 for r in per for i in range(len(columns)))
    within = sum(r["n"] * r[f"v{i}"] for r in per for i in range(len(columns)))
    return report(df, [(k, half_up(between, 2), half_up(within, 2), half_up((between / (k - 1)) / (within / (n - k)) if k > 1 and within else 0.0))], "clusters int, between double, within double, score double")


def cluster_profiles(df: DataFrame, columns: Sequence[str], cluster: str) -> DataFrame:
    """Size, share, mean, exact median and std per cluster and feature against the overall mean."""
    names = sorted(r[0] for r in df.select(cluster).distinct().collect())  # one row per cluster
    n = df.count()
    overall = measure(df, **{f"a{i}": F.avg(number(c)) for i, c in enumerate(columns)})
    stats = {r[cluster]: r for r in df.groupBy(cluster).agg(F.count("*").alias("n"), *[f(number(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("a", F.avg), ("s", F.stddev_samp))]).collect()}
    med = quantiles(df, {f"{j}_{i}": F.when(F.col(cluster) == g, number(c)) for j, g in enumerate(names) for i, c in enumerate(columns)}, [0.5])
    rows = [(str(g), stats[g]["n"], half_up(100.0 * stats[g]["n"] / n, 1), c, half_up(stats[g][f"a{i}"], 3), half_up(med[f"{j}_{i}"][0], 3), half_up(stats[g][f"s{i}"], 3), half_up(overall[f"a{i}"], 3))
            for j, g in enumerate(names) for i, c in enumerate(columns)]
    return report(df, rows, "cluster string, size long, pct double, feature string, mean double, median double, std double, overall_mean double")


def adjusted_rand(a: DataFrame, b: DataFrame) -> float:
    """Agreement of two labelings (id, cluster), from pair counts per cell."""
    cells = a.join(b.select("id", F.col("cluster").alias("other")), "id").groupBy("cluster", "other").agg(F.count("*").cast("double").alias("n")).collect()
    pairs = lambda x: x * (x - 1) / 2
    rows, cols = {}, {}
    for r in cells:
        rows[r["cluster"]] = rows.get(r["cluster"], 0) + r["n"]
        cols[r["other"]] = cols.get(r["other"], 0) + r["n"]
    n = sum(rows.values())
    both, ra, cb = sum(pairs(r["n"]) for r in cells), sum(map(pairs, rows.values())), sum(map(pairs, cols.values()))
    want = ra * cb / pairs(n)
    return 1.0 if (ra + cb) / 2 == want else (both - want) / ((ra + cb) / 2 - want)


def stability(df: DataFrame, key: str, columns: Sequence[str], k: int, runs: int = 5) -> DataFrame:
    """Mean agreement of k-means over several seeds."""
    labels = [kmeans(df, key, columns, k, seed).persist() for seed in range(runs)]
    scores = [adjusted_rand(labels[i], labels[j]) for i in range(runs) for j in range(i)]
    for x in labels:
        x.unpersist()
    return report(df, [(runs, half_up(sum(scores) / len(scores)), half_up(min(scores)))], "runs int, mean_agreement double, min_agreement double")


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): smallest node reachable, by alternating stars.

    A round points the larger neighbours of every node to its smallest neighbour, then every node and its smaller neighbours to the smallest of those. The edges
    never grow in number, and after some log n rounds every node points to its component.
    """
    up = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = up.union(up.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        up = cut_lineage(small.where("u <> v").distinct())
        now = up.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    found = up.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Cells the tree of a clustering is fitted on, and rows of one of its leaves.
SAMPLE_CELLS = 500_000
LEAF_ROWS = 20_000


def dbscan(df: DataFrame, key: str, columns: Sequence[str], eps: float | None = None, min_rows: int | None = None) -> DataFrame:
    """(id, cluster): density clusters, named by their smallest core row; noise is -1.

    Rows fall into cells whose diagonal is ``eps``. All rows of a cell that holds ``min_rows`` are core rows; only the others are counted around, exactly. Core rows
    of one cell belong together, and two cells do if two of their core rows are within ``eps``: each pair of near cells is probed once, unless
    it is connected already. Components are taken over the cells. A row that is not core goes to its nearest core row within ``eps``.

    A tree over the cells deals the work: a task gets the rows of its leaf and the others' rows within ``eps`` of the leaf's box, split by key where they are many, so
    nothing is listed per row. Any number of columns; with many of them few cells hold two rows, and all rows are counted around.
    """
    v = vectors(df, key, columns)
    n, d = df.count(), len(columns)
    min_rows = min_rows or max(3, n // 100)
    if eps is None:
        kth = knn(v, v, 4, same=True).groupBy("id").agg(F.max("distance").alias("r")).persist()  # the row itself counts as the first of five
        eps = quantiles(kth, ["r"], [0.9])["r"][0] if n > 1 else 1.0
        kth.unpersist()
    side = eps / math.sqrt(d) * (1 - 1e-9)
    v = v.withColumn("cell", F.transform("vec", lambda x: F.floor(x / side)) if side else F.col("vec"))  # within no distance there are only copies
    box = [F.array(*[f(F.col("vec")[j]) for j in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    cells = v.groupBy("cell").agg(F.min("id").alias("c"), F.count(F.lit(1)).alias("n"), *box)
    rows = cut_lineage(v.join(cells.withColumn("mid", F.zip_with("lo", "hi", lambda x, y: (x + y) / 2)).drop("lo", "hi"), "cell").select("id", "vec", "c", "n", "mid"))
    deal = _dealer(rows, d, n)
    sparse = F.col("n") < min_rows
    counted = deal(rows.where(sparse), rows, eps, _count, "id long, hits long").groupBy("id").agg(F.sum("hits").alias("hits"))
    core = F.when(sparse, F.coalesce(F.col("hits"), F.lit(0)) >= min_rows).otherwise(True)
    rows = cut_lineage(rows.join(counted, "id", "left").select("id", "vec", "c", "mid", core.alias("core")))
    cores = rows.where("core")
    links = deal(cores, cores, eps, _link, "a long, b long").distinct()
    label = connected_components(links, cores.select(F.col("c").alias("node")).distinct())
    inner = cores.select("id", F.col("c").alias("node")).join(label, "node").select("id", "component").persist()
    numbers = inner.groupBy("component").agg(F.min("id").alias("first"))
    inner = inner.join(numbers, "component").select("id", F.col("first").alias("cluster"))
    edge = deal(rows.where("NOT core"), cores, eps, _nearest, "id long, neighbor long, distance double")
    edge = edge.groupBy("id").agg(F.min_by("neighbor", F.struct("distance", "neighbor")).alias("neighbor"))
    edge = edge.join(inner.select(F.col("id").alias("neighbor"), "cluster"), "neighbor").select("id", "cluster")
    return rows.select("id").join(inner.union(edge), "id", "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("long"))


def _dealer(rows: DataFrame, d: int, n: int):
    """A function that brings ``base`` rows within a distance of ``asking`` rows to them, task by task, and runs ``found`` on both."""
    mids = rows.groupBy("c").agg(F.first("mid").alias("mid"))
    share = min(1.0, SAMPLE_CELLS / max(1, n))
    sample = mids.where(hash_uniform("c", 11) < share).select("mid").limit(2 * SAMPLE_CELLS).toPandas()
    tree = Leaves(matrix(sample["mid"], d), max(1, min(-(-n // LEAF_ROWS), len(sample) // 8)))
    shape = "id long, vec array<double>, c long, leaf long"

    def own(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "vec": pdf["vec"], "c": pdf["c"], "leaf": tree.assign(matrix(pdf["mid"], d)).astype("int64")})

    def deal(asking: DataFrame, base: DataFrame, eps: float, found, schema: str) -> DataFrame:
        asking = asking.select("id", "vec", "c", "mid").mapInPandas(own, shape)
        box = [F.array(*[f(F.col("vec")[j]) for j in range(d)]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
        boxes = asking.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), *box).orderBy("leaf").toPandas()  # a row per leaf
        nodes = copy.copy(tree).enclose(boxes["leaf"].to_numpy(), matrix(boxes["lo"], d), matrix(boxes["hi"], d))

        def reach(batches):
            for pdf in batches:
                x = matrix(pdf["vec"], d)
                at, leaf, _ = nodes.within(x, x, np.full(len(x), eps * (1 + 1e-9))) if len(boxes) else (np.zeros(0, int),) * 3
                src = pdf.iloc[at]
                yield pd.DataFrame({"id": src["id"].to_numpy(), "vec": src["vec"].to_numpy(), "c": src["c"].to_numpy(), "leaf": leaf})

        near = base.select("id", "vec", "c").mapInPandas(reach, shape)
        counts = near.groupBy("leaf").count().withColumnRenamed("count", "m").join(asking.groupBy("leaf").count(), "leaf")
        parts = counts.select("leaf", *[F.ceil(F.col(x) / (2 * LEAF_ROWS)).cast("int").alias(y) for x, y in (("count", "pi"), ("m", "pj"))])
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        cut = lambda c: F.pmod(F.xxhash64("id", F.lit(5)), F.col(c)).cast("int")
        keys = ["leaf", "i", "j"]
        asking = asking.join(parts, "leaf").withColumn("i", cut("pi")).withColumn("j", every("pj")).select(*keys, "id", "vec", "c")
        near = near.join(parts, "leaf").withColumn("j", cut("pj")).withColumn("i", every("pi")).select(*keys, "id", "vec", "c")

        def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            names = [x.split()[0] for x in schema.split(", ")]
            if not len(q) or not len(b):
                return pd.DataFrame({x: [] for x in names})
            return found(matrix(q["vec"], d), q["id"].to_numpy(), q["c"].to_numpy(), matrix(b["vec"], d), b["id"].to_numpy(), b["c"].to_numpy(), eps)

        return asking.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInPandas(run, schema)

    return deal


def _count(q, qid, qc, b, bid, bc, eps) -> pd.DataFrame:
    """Rows within the distance of each row, itself counted."""
    return pd.DataFrame({"id": qid, "hits": LocalTree(b, bid).counted(q, eps)})


def _nearest(q, qid, qc, b, bid, bc, eps) -> pd.DataFrame:
    """The nearest row within the distance."""
    found = LocalTree(b, bid).nearest(q, qid, 1, False, np.full(len(q), np.nextafter(eps, np.inf)))
    return found[found["distance"] <= eps]


def _link(q, qid, qc, b, bid, bc, eps) -> pd.DataFrame:
    """A forest of links between cells that have two rows within the distance."""
    order, other = np.argsort(qc, kind="stable"), np.argsort(bc, kind="stable")
    q, qc, b, bc = q[order], qc[order], b[other], bc[other]
    (a_cell, a_at), (b_cell, b_at) = np.unique(qc, return_index=True), np.unique(bc, return_index=True)
    a_end, b_end = np.append(a_at[1:], len(q)), np.append(b_at[1:], len(b))
    a_lo, a_hi = np.minimum.reduceat(q, a_at), np.maximum.reduceat(q, a_at)
    b_lo, b_hi = np.minimum.reduceat(b, b_at), np.maximum.reduceat(b, b_at)
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    links = []
    for lo in range(0, len(a_cell), max(1, 2_000_000 // len(b_cell))):
        part = slice(lo, lo + max(1, 2_000_000 // len(b_cell)))
        near, far = np.zeros((len(a_lo[part]), len(b_cell))), np.zeros((len(a_lo[part]), len(b_cell)))
        for k in range(q.shape[1]):
            below, above = b_lo[None, :, k] - a_hi[part, None, k], a_lo[part, None, k] - b_hi[None, :, k]
            near += np.maximum(np.maximum(below, above), 0) ** 2
            far += np.maximum(b_hi[None, :, k] - a_lo[part, None, k], a_hi[part, None, k] - b_lo[None, :, k]) ** 2
        i, j = np.nonzero((np.sqrt(near) <= eps * (1 + 1e-9)) & (a_cell[part, None] != b_cell[None, :]))
        sure = np.sqrt(far[i, j]) <= eps * (1 - 1e-9)
        for at in np.argsort(far[i, j], kind="stable").tolist():
            x, y = int(i[at]) + lo, int(j[at])
            one, two = top(int(a_cell[x])), top(int(b_cell[y]))
            if one == two:
                continue
            if sure[at] or _touch(q[a_at[x] : a_end[x]], b[b_at[y] : b_end[y]], eps):
                root[max(one, two)] = min(one, two)
                links.append((int(a_cell[x]), int(b_cell[y])))
    return pd.DataFrame(links, columns=["a", "b"])


def _touch(p: np.ndarray, q: np.ndarray, eps: float) -> bool:
    """Whether two rows of two cells are within the distance: only rows near the other's box are compared."""
    for _ in range(2):
        gap = np.maximum(np.maximum(q.min(axis=0) - p, p - q.max(axis=0)), 0)
        p = p[np.sqrt((gap * gap).sum(axis=1)) <= eps * (1 + 1e-9)]
        if not len(p):
            return False
        p, q = q, p
    step = max(1, 1_000_000 // len(q))
    for lo in range(0, len(p), step):
        d2 = np.zeros((len(p[lo : lo + step]), len(q)))
        for k in range(p.shape[1]):
            gap = p[lo : lo + step, None, k] - q[None, :, k]
            d2 += gap * gap
        if (np.sqrt(d2) <= eps).any():
            return True
    return False


def coordinates(df: DataFrame, key: str, columns: Sequence[str], keep: int = 2) -> tuple[DataFrame, DataFrame]:
    """Principal coordinates per row, and variance shares with the 5 strongest loadings per component."""
    out, shares, loads = principal_components(df, columns, min(len(columns), max(keep, len(columns))))
    arr = vector_to_array("components")
    points = out.select(F.col(key).alias("id"), *[arr[i].alias(f"pc{i + 1}") for i in range(keep)])
    rows, total = [], 0.0
    for i, s in enumerate(shares):
        total += s
        top = sorted(range(len(columns)), key=lambda j: -abs(loads[j, i]))[:5]
        rows.append((i + 1, half_up(float(s)), half_up(float(total)), ",".join(columns[j] for j in top)))
    need = next((r[0] for r in rows if r[2] >= 0.95), len(rows))
    return points, report(df, [(*r, need) for r in rows], "component int, share double, cumulative double, loadings string, needed_for_95 int")
