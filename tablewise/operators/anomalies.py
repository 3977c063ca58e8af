"""Anomaly detectors, their consensus, and what makes a row an outlier."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.operators.explore import outlier_measures
from tablewise.operators.measures import measure, number, quantiles
from tablewise.operators.neighbors import dealt, knn, matrix, vectors

NODES = "tree int, node int, feature int, cut double, low int, high int, size int"


def _grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Random axis splits down to single points or the depth limit: rows (node, feature, cut, low, high, size)."""
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes: list = []

    def grow(part: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append(None)
        lo, hi = part.min(axis=0), part.max(axis=0)
        open_ = np.nonzero(hi > lo)[0]
        if depth >= limit or len(part) <= 1 or len(open_) == 0:
            nodes[me] = (me, -1, 0.0, -1, -1, len(part))
            return me
        f = int(rng.choice(open_))
        cut = float(rng.uniform(lo[f], hi[f]))
        side = part[:, f] < cut
        nodes[me] = (me, f, cut, grow(part[side], depth + 1) if side.any() else -1, grow(part[~side], depth + 1) if (~side).any() else -1, len(part))
        return me

    grow(x, 0)
    return nodes


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    return np.where(n > 2, 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe, np.where(n == 2, 1.0, 0.0))


def isolation_scores(df: DataFrame, key: str, columns: Sequence[str], trees: int = 200, rows: int = 256, seed: int = 42) -> DataFrame:
    """(id, score): isolation score in 0..1 per row.

    Each tree is grown in its own task from a hash sample of about ``rows`` rows; the
    forest (at most trees x 2 x rows nodes) is sent to the scoring tasks.
    """
    data = vectors(df, key, columns)
    n = df.count()
    unit = lambda *p: F.pmod(F.xxhash64(*p), F.lit(2**30)).cast("double") / 2**30
    pool = data.where(unit(F.col("id"), F.lit(seed)) < trees * rows / n) if n > trees * rows else data
    draws = max(1, math.ceil(trees * rows / min(n, trees * rows)))
    members = pool.select("id", "vec", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda t: F.pmod(F.xxhash64("id", t, F.lit(seed + 1)), F.lit(trees)).cast("int")))).alias("tree"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = matrix(pdf.sort_values("id")["vec"], 0)
        return pd.DataFrame([(t, *r) for r in _grow_tree(x, np.random.default_rng(seed + t))], columns=[c.split(" ")[0] for c in NODES.split(", ")])

    forest = members.groupBy("tree").applyInPandas(build, NODES).toPandas()
    packed = []
    for _, g in forest.sort_values(["tree", "node"]).groupby("tree"):
        packed.append(tuple(g[c].to_numpy() for c in ("feature", "cut", "low", "high", "size")))
    shared = df.sparkSession.sparkContext.broadcast(packed)

    def score(batches):
        for pdf in batches:
            x = matrix(pdf["vec"], 0)
            depth = np.zeros(len(x))
            norm = 0.0
            for feature, cut, low, high, size in shared.value:
                node, level = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
                left = np.zeros(len(x))
                live = np.arange(len(x))
                while len(live):
                    at = node[live]
                    stop = feature[at] < 0
                    done = live[stop]
                    left[done] = average_path(size[node[done]])
                    live = live[~stop]
                    at = node[live]
                    nxt = np.where(x[live, feature[at]] < cut[at], low[at], high[at])
                    gone = nxt < 0  # an empty side: the point stands alone one level down
                    level[live] += 1
                    node[live[~gone]] = nxt[~gone]
                    live = live[~gone]
                depth += level + left
                norm += float(average_path(size[0]))
            yield pd.DataFrame({"id": pdf["id"], "score": np.power(2.0, -depth / max(norm, 1e-9))})

    return dealt(data, n).mapInPandas(score, "id long, score double")


def flag_top(scores: DataFrame, share: float) -> DataFrame:
    """Mark the given share of rows with the highest scores."""
    scores = scores.persist()  # two numbers per row, read by the cut and by the result
    cut = quantiles(scores, ["score"], [1 - share])["score"][0]
    return scores.withColumn("flag", (F.col("score") > cut).cast("int"))


def local_outlier_factor(df: DataFrame, key: str, columns: Sequence[str], k: int = 20) -> DataFrame:
    """(id, score): how much sparser the neighbourhood of a row is than those of its neighbours."""
    v = vectors(df, key, columns)
    near = knn(v, v, k, same=True).select("id", "neighbor", "distance").persist()
    reach = near.groupBy("id").agg(F.max("distance").alias("kd"))
    r = near.join(reach.select(F.col("id").alias("neighbor"), "kd"), "neighbor").select("id", "neighbor", F.greatest("kd", "distance").alias("r"))
    density = r.groupBy("id").agg((1.0 / (F.avg("r") + 1e-10)).alias("lrd"))
    around = near.join(density.select(F.col("id").alias("neighbor"), F.col("lrd").alias("nl")), "neighbor").groupBy("id").agg(F.avg("nl").alias("m"))
    return around.join(density, "id").select("id", (F.col("m") / F.col("lrd")).alias("score"))


def z_vote(df: DataFrame, key: str, columns: Sequence[str], limit: float = 3.0) -> DataFrame:
    """(id, score, flag): largest absolute z over the columns and whether it is over the limit."""
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("a", F.avg), ("s", F.stddev_pop))})
    z = [F.abs((number(c) - row[f"a{i}"]) / (row[f"s{i}"] or 1.0)) for i, c in enumerate(columns)]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    return df.select(F.col(key).cast("long").alias("id"), top.alias("score")).withColumn("flag", (F.col("score") > limit).cast("int"))


def mahalanobis(df: DataFrame, key: str, columns: Sequence[str], share: float = 0.05) -> DataFrame:
    """(id, score, flag): distance from the mean in the covariance metric, flagged above the 1 - share quantile."""
    d = len(columns)
    exprs = {f"a{i}": F.avg(number(c)) for i, c in enumerate(columns)}
    exprs |= {f"c{i}_{j}": F.covar_samp(number(columns[i]), number(columns[j])) for i in range(d) for j in range(i + 1)}
    row = measure(df, **exprs)
    inv = np.linalg.pinv(np.array([[row[f"c{max(i, j)}_{min(i, j)}"] for j in range(d)] for i in range(d)]))
    gap = [number(c) - row[f"a{i}"] for i, c in enumerate(columns)]
    q = F.lit(0.0)
    for i in range(d):
        for j in range(d):
            q = q + gap[i] * gap[j] * float(inv[i, j])
    return flag_top(df.select(F.col(key).cast("long").alias("id"), F.sqrt(F.greatest(q, F.lit(0.0))).alias("score")), share)


def detect(df: DataFrame, key: str, columns: Sequence[str], share: float = 0.05, lof: bool = True) -> DataFrame:
    """(id, votes, label): agreement of the detectors."""
    parts = [flag_top(isolation_scores(df, key, columns), share), z_vote(df, key, columns), mahalanobis(df, key, columns, share)]
    if lof:
        parts.append(flag_top(local_outlier_factor(df, key, columns), share))
    votes = parts[0].select("id", "flag")
    for p in parts[1:]:
        votes = votes.union(p.select("id", "flag"))
    need = max(2, len(parts) // 2)
    return votes.groupBy("id").agg(F.sum("flag").cast("int").alias("votes")).select(
        "id", "votes", F.when(F.col("votes") >= need, "anomaly").when(F.col("votes") > 0, "suspicious").otherwise("clean").alias("label"))


def detection_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("label").agg(F.count("*").alias("n"))


def top_anomalies(found: DataFrame, n: int = 20) -> DataFrame:
    return found.where("votes > 0").orderBy(F.desc("votes"), "id").limit(n)


def explain(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Flagged rows with the methods that flag them, their strangest features, similar rows and a verdict."""
    fences = {m["column"]: (m["lower"], m["upper"]) for m in outlier_measures(df, columns, 2.0)}
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("a", F.avg), ("s", F.stddev_samp), ("p", F.stddev_pop))})
    iqr = F.lit(False)
    for c, (lo, hi) in fences.items():
        iqr = iqr | (number(c) < lo) | (number(c) > hi)
    z3 = F.lit(False)
    for i, c in enumerate(columns):
        if row[f"p{i}"]:
            z3 = z3 | (F.abs(number(c) - row[f"a{i}"]) / row[f"p{i}"] > 3)
    forest = flag_top(isolation_scores(df, key, columns, trees=100), 0.05).select("id", F.col("flag").alias("_iso"))
    usable = [i for i in range(len(columns)) if row[f"s{i}"] and row[f"s{i}"] >= 1e-8]
    strange = F.array_compact(F.array(*[
        F.when(F.abs(number(columns[i]) - row[f"a{i}"]) / row[f"s{i}"] > 2.5,
               F.struct((F.abs(number(columns[i]) - row[f"a{i}"]) / row[f"s{i}"]).alias("z"), F.lit(columns[i]).alias("feature"), number(columns[i]).alias("value"))) for i in usable]))
    data = df.select(F.col(key).cast("long").alias("id"), iqr.cast("int").alias("_iqr"), z3.cast("int").alias("_z"), F.sort_array(strange, asc=False).alias("features")).join(forest, "id")
    data = data.withColumn("severity", F.col("_iqr") + F.col("_z") + F.col("_iso")).where("severity > 0")
    data = data.withColumn("main", F.when(F.size("features") > 0, F.col("features")[0]))
    # similar rows: neighbours of the main value within half a standard deviation, from counts per
    # narrow slice of the feature (a tenth of a std) summed over the eleven slices around the value
    width = {columns[i]: row[f"s{i}"] / 10 for i in usable}
    slice_of = lambda c, x: F.floor(x / width[c]).cast("long")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), slice_of(c, number(c)).alias("b")) for c in width])).alias("x")).select("x.*").groupBy("f", "b").agg(F.count("*").alias("n"))
    pos = F.coalesce(*[F.when(F.col("main.feature") == c, slice_of(c, F.col("main.value"))) for c in width])
    probes = data.where("main is not null").select("id", F.col("main.feature").alias("f"), F.explode(F.sequence(pos - 5, pos + 5)).alias("b"))
    similar = probes.join(cells, ["f", "b"]).groupBy("id").agg(F.sum("n").alias("similar"))
    out = data.join(similar, "id", "left").withColumn("similar", F.coalesce("similar", F.lit(0)).cast("long"))
    verdict = (F.when(F.col("severity") >= 3, "likely_error").when((F.col("severity") == 2) & (F.col("similar") <= 2), "suspicious")
               .when(F.col("similar") >= 5, "legitimate_extreme").otherwise("borderline"))
    return out.select("id", F.col("severity").cast("int").alias("severity"), F.transform(F.slice("features", 1, 5), lambda x: x["feature"]).alias("features"), "similar", verdict.alias("verdict"))
