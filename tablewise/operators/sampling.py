"""Subsampling, splits, rebalancing and synthetic rows. All draws come from row keys, so they repeat exactly."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up
from tablewise.functions.tails import normal_quantile
from tablewise.operators.drift import ks
from tablewise.operators.measures import (
    col, correlation, distinct_counts, frequencies, hash_normal, hash_uniform, measure, number, positions,
    report, smallest_per_group, smallest_rows,
)
from tablewise.operators.neighbors import knn, vectors


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(col(label)).agg(F.count("*").alias("_n"))


def take_by_class(df: DataFrame, label: str, key: str, take: Column, seed: int = 42) -> DataFrame:
    """``take`` rows (an expression over the class size ``_n``) of each class, in hash order."""
    quota = class_counts(df, label).select(col(label), take.cast("long").alias("take"))
    data = df.withColumn("_u", hash_uniform(key, seed))
    return smallest_per_group(data, [label], "_u", key, quota).drop("_u")


def stratified(df: DataFrame, label: str, key: str, size: int, seed: int = 42) -> DataFrame:
    """About ``size`` rows in the class shares of the table, at least one per class."""
    n = df.count()
    return take_by_class(df, label, key, F.greatest(F.lit(1), F.floor(F.col("_n") * size / n)), seed)


def boundary(df: DataFrame, label: str, key: str, columns: Sequence[str], size: int, k: int = 10, seed: int = 42) -> DataFrame:
    """60% of the rows whose neighbours most often have another label, 40% at random from the rest."""
    near = knn(vectors(df, key, columns), vectors(df, key, columns), k, same=True)
    own = df.select(F.col(key).cast("long").alias("id"), col(label).alias("y"))
    other = df.select(F.col(key).cast("long").alias("neighbor"), col(label).alias("ny"))
    score = near.join(own.hint("merge"), "id").join(other.hint("merge"), "neighbor").groupBy("id").agg(F.avg((F.col("y") != F.col("ny")).cast("double")).alias("_score"))
    data = df.join(score.hint("merge"), F.col(key).cast("long") == F.col("id")).drop("id")  # one row per row on each side: never through the driver
    data = data.withColumn("_u", hash_uniform(key, seed)).persist()
    first, left, cut = int(size * 0.6), int(size * 0.6), 2.0
    for r in sorted(data.groupBy("_score").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["_score"]):  # at most k + 1 levels
        cut = r["_score"]
        if r["n"] >= left:
            break
        left -= r["n"]
    edge = data.where(F.col("_score") > cut).unionByName(smallest_rows(data.where(F.col("_score") == cut), "_u", key, left))
    rest = smallest_rows(data.join(edge.select(key), key, "left_anti"), "_u", key, size - first)
    return edge.withColumn("part", F.lit("boundary")).unionByName(rest.withColumn("part", F.lit("random"))).drop("_score", "_u")


def diverse(df: DataFrame, key: str, columns: Sequence[str], size: int, seed: int = 42) -> DataFrame:
    """Rows from every k-means cell in proportion to its size."""
    v = vectors(df, key, columns).withColumn("features", array_to_vector("vec"))
    model = KMeans(k=max(2, min(20, size // 10)), seed=seed, featuresCol="features", predictionCol="cell").fit(v)
    cells = model.transform(v).select(F.col("id"), "cell")
    joined = df.join(cells, F.col(key).cast("long") == F.col("id")).drop("id")
    return stratified(joined, "cell", key, size, seed).drop("cell")


def subsample(df: DataFrame, label: str, key: str, size: int, columns: Sequence[str], strategy: str = "auto", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pick a strategy (by class if the label has few values, or the table more than ``most`` rows), sample, and compare the class shares before and after."""
    n = df.count()
    if size >= n:
        out, strategy = df, "none"
    else:
        if strategy == "auto":
            strategy = "stratified" if distinct_counts(df, [label])[label] <= 20 or (most is not None and n > most) else "diversity"
        out = (stratified(df, label, key, size) if strategy == "stratified" else boundary(df, label, key, columns, size).drop("part")
               if strategy == "boundary" else diverse(df, key, columns, size))
    a = df.groupBy(col(label).cast("string").alias("label")).agg((F.count("*") / n).alias("before"))
    m = out.count()
    b = out.groupBy(col(label).cast("string").alias("label")).agg((F.count("*") / m).alias("after"))
    shares = a.join(b, "label", "full").fillna(0.0, ["before", "after"]).withColumn("strategy", F.lit(strategy))
    return out, shares


def split(df: DataFrame, label: str, key: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``split``: a stratified test part chosen in hash order."""
    held = take_by_class(df.select(key, label), label, key, F.round(F.col("_n") * test), seed).select(key, F.lit("test").alias("split"))
    return df.join(held, key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def quick_split(df: DataFrame, key: str, test: float = 0.25, seed: int = 42) -> DataFrame:
    """Add ``split`` by the row hash alone: no count, no shuffle, shares right on average."""
    return df.withColumn("split", F.when(hash_uniform(key, seed) < test, "test").otherwise("train"))


def undersample(df: DataFrame, label: str, key: str, ratio: float = 10.0, least: int = 0, seed: int = 42) -> DataFrame:
    """Cut every class to the smallest one, when the table is very uneven (and has more than ``least`` rows)."""
    c = class_counts(df, label).agg(F.max("_n").alias("hi"), F.min("_n").alias("lo"), F.sum("_n").alias("n")).first()
    if c["n"] <= least or c["hi"] / c["lo"] <= ratio:
        return df
    return take_by_class(df, label, key, F.lit(c["lo"]), seed)


def copies(df: DataFrame, key: str, need: int, rows: int, seed: int) -> DataFrame:
    """Repeat rows so that ``need`` come out in total: every row floor(need / rows) times, the rest in hash order."""
    every, extra = divmod(need, rows)
    data = df.withColumn("_u", hash_uniform(key, seed, 5))
    more = smallest_rows(data, "_u", key, extra).select(F.col(key).alias("_k"))
    data = data.join(more, F.col(key) == F.col("_k"), "left").withColumn("_c", F.when(F.col("_k").isNotNull(), every + 1).otherwise(every))
    return data.where("_c > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_c").cast("int")))).drop("_u", "_k", "_c")


def between(seeds: DataFrame, minority: DataFrame, key: str, columns: Sequence[str], k: int, seed: int) -> DataFrame:
    """New rows on the line from each seed row to one of its k nearest minority rows."""
    near = knn(vectors(minority, key, columns), vectors(minority, key, columns), k, same=True).select(F.col("id").alias("_id"), F.col("rank").alias("_rank"), F.col("neighbor").alias("_nb")).persist()
    found = near.groupBy("_id").agg(F.max("_rank").alias("_found"))
    s = seeds.withColumn("_id", F.col(key).cast("long")).join(found, "_id")
    s = s.withColumn("_rank", (F.floor(hash_uniform(key, "_copy", seed, 1) * F.col("_found")) + 1).cast("int")).join(near, ["_id", "_rank"])
    other = minority.select(F.col(key).cast("long").alias("_nb"), *[number(c).alias(f"_o{i}") for i, c in enumerate(columns)])
    u = hash_uniform(key, "_copy", seed, 2)
    return s.join(other, "_nb").withColumn("_t", u).select(*[(number(c) + F.col("_t") * (F.col(f"_o{i}") - number(c))).alias(c) for i, c in enumerate(columns)])


def _rebalanced(df, label, columns, made, value):
    real = df.select(*[number(c).alias(c) for c in columns], col(label), F.lit(False).alias("synthetic"))
    return real.union(made.select(*columns, F.lit(value).cast(dict(df.dtypes)[label]).alias(label), F.lit(True)))


def class_need(df: DataFrame, label: str):
    """The smallest class, its size, and the rows it lacks to reach the largest."""
    c = sorted(class_counts(df, label).collect(), key=lambda r: (r["_n"], str(r[label])))
    return c[0][label], c[0]["_n"], c[-1]["_n"] - c[0]["_n"], sum(r["_n"] for r in c)


def smote(df: DataFrame, label: str, key: str, columns: Sequence[str], k: int = 5, seed: int = 42, ratio: float = 2.0, least: int = 0) -> DataFrame:
    """Raise the smallest class to the largest with interpolated rows, when uneven (and the table has more than ``least`` rows); one row has no neighbour to meet."""
    value, n, need, total = class_need(df, label)
    if (n + need) / n <= ratio or total <= least or n < 2:
        return df.select(*[number(c).alias(c) for c in columns], col(label), F.lit(False).alias("synthetic"))
    small = df.where(col(label) == value)
    return _rebalanced(df, label, columns, between(copies(small, key, need, n, seed), small, key, columns, k, seed), value)


def crowding(df: DataFrame, label: str, key: str, columns: Sequence[str], value, k: int) -> DataFrame:
    """(id, away): share of the k nearest rows of each minority row that belong to other classes."""
    all_rows = vectors(df, key, columns)
    small = df.where(col(label) == value).select(F.col(key).cast("long").alias("id"))
    near = knn(all_rows.join(small, "id", "left_semi"), all_rows, k, same=True)
    away = df.select(F.col(key).cast("long").alias("neighbor"), (col(label) != value).cast("double").alias("far"))
    return near.join(away, "neighbor").groupBy("id").agg(F.avg("far").alias("away"))


def adasyn(df: DataFrame, label: str, key: str, columns: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE with more new rows where the neighbours belong to other classes."""
    value, n, need, _ = class_need(df, label)
    small = df.where(col(label) == value)
    away = crowding(df, label, key, columns, value, k).persist()
    total = away.agg(F.sum("away")).first()[0] or 0.0
    if total == 0:
        return smote(df, label, key, columns, k, seed)
    seeds = small.join(away, F.col(key).cast("long") == F.col("id")).withColumn("_c", F.round(F.col("away") / total * need).cast("int")).drop("id", "away")
    seeds = seeds.where("_c > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_c")))).drop("_c")
    return _rebalanced(df, label, columns, between(seeds, small, key, columns, k, seed), value)


def borderline_smote(df: DataFrame, label: str, key: str, columns: Sequence[str], k: int = 5, around: int = 10, seed: int = 42) -> DataFrame:
    """SMOTE from the minority rows with half or more, but not all, neighbours in other classes."""
    value, _, need, _ = class_need(df, label)
    small = df.where(col(label) == value)
    danger = crowding(df, label, key, columns, value, around).where("away >= 0.5 and away < 1").select("id")
    seeds = small.join(danger, F.col(key).cast("long") == F.col("id")).drop("id").persist()
    m = seeds.count()
    if m == 0:
        return smote(df, label, key, columns, k, seed)
    return _rebalanced(df, label, columns, between(copies(seeds, key, need, m, seed), small, key, columns, k, seed), value)


def synthetic_numbers(df: DataFrame, columns: Sequence[str], n: int, seed: int = 42, grid: int = 200) -> DataFrame:
    """n rows with the marginals (a quantile grid) and correlations (of normal scores) of the table, 1% noise."""
    probs = [i / grid for i in range(grid + 1)]
    row = measure(df, **{f"q{i}": F.percentile_approx(number(c), probs, 20_000) for i, c in enumerate(columns)}, **{f"s{i}": F.stddev_samp(number(c)) for i, c in enumerate(columns)})
    scores = [normal_quantile((i + 0.5) / grid) for i in range(grid)]
    data = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(columns)]).dropna()
    for i in range(len(columns)):
        inner = sorted(set(row[f"q{i}"][1:-1]))
        at = [row[f"q{i}"][1:-1].index(v) for v in inner]  # first grid step of each distinct edge
        data = Bucketizer(splits=[-np.inf, *inner, np.inf], inputCol=f"x{i}", outputCol=f"b{i}").transform(data)
        data = data.withColumn(f"z{i}", F.element_at(F.array(*[F.lit(scores[j]) for j in [0] + [a + 1 for a in at]]), F.col(f"b{i}").cast("int") + 1))
    d = len(columns)
    cors = measure(data, **{f"r{i}_{j}": correlation(F.col(f"z{i}"), F.col(f"z{j}")) for i in range(d) for j in range(i)}) if d > 1 else {}
    m = np.eye(d)
    for i in range(d):
        for j in range(i):
            m[i, j] = m[j, i] = cors[f"r{i}_{j}"] or 0.0
    vals, vecs = np.linalg.eigh(m)
    m = vecs @ np.diag(np.maximum(vals, 1e-8)) @ vecs.T
    scale = np.sqrt(np.diag(m))
    low = np.linalg.cholesky(m / np.outer(scale, scale) + 1e-10 * np.eye(d))
    edges = [normal_quantile(p) for p in probs[1:-1]]
    out = df.sparkSession.range(n).withColumns({f"n{j}": hash_normal("id", seed, j) for j in range(d)})
    for i, c in enumerate(columns):
        out = out.withColumn("_z", sum((F.col(f"n{j}") * float(low[i, j]) for j in range(i + 1)), F.lit(0.0)))
        out = Bucketizer(splits=[-np.inf, *edges, np.inf], inputCol="_z", outputCol="_b").transform(out)
        q = F.array(*[F.lit(float(v)) for v in row[f"q{i}"]])
        at = F.col("_b").cast("int") + 1
        u = hash_uniform("id", seed, 50 + i)
        value = F.element_at(q, at) + u * (F.element_at(q, at + 1) - F.element_at(q, at)) + hash_normal("id", seed, 90 + i) * (0.01 * max(row[f"s{i}"] or 0.0, 1e-4))
        kind = dict(df.dtypes)[c]
        out = out.withColumn(c, F.round(value).cast(kind) if kind in ("int", "bigint", "smallint") else value).drop("_z", "_b")
    return out.select("id", *columns)


def synthetic_categories(df: DataFrame, columns: Sequence[str], n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows whose text values are drawn, column by column, from the rows of the table (nulls included).

    A draw is a row number, so every observed share is kept and the lookup is an equi-join.
    """
    total = df.count()
    placed = positions(df.select(number(key).alias("_o"), *columns), [], "_o", "_pos").drop("_o")
    out = df.sparkSession.range(n)
    for i, c in enumerate(columns):
        pick = out.select("id", *columns[:i], F.floor(hash_uniform("id", seed, 200 + i) * total).cast("long").alias("_pos"))
        out = pick.join(placed.select("_pos", c), "_pos").drop("_pos")
    return out


def enforce_shares(df: DataFrame, label: str, key: str, shares: Mapping, n: int, seed: int = 42) -> DataFrame:
    """n rows with the wanted class shares: fewer by hash order, more by repeating rows."""
    have = {r[label]: r["_n"] for r in class_counts(df.where(col(label).isin(list(shares))), label).collect()}
    parts = []
    for value, share_ in shares.items():
        want, rows = int(n * share_), df.where(col(label) == value)
        if not have.get(value):
            continue
        if want <= have[value]:
            parts.append(smallest_rows(rows.withColumn("_u", hash_uniform(key, seed)), "_u", key, want).drop("_u"))
        else:
            parts.append(copies(rows, key, want, have[value], seed).drop("_copy"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def synthetic_quality(real: DataFrame, made: DataFrame, numeric: Sequence[str], texts: Sequence[str]) -> DataFrame:
    """1 - KS per numeric column, 1 - mean share gap per text column, and the overall grade."""
    rows = [(r["column"], "numeric", half_up(1 - r["statistic"])) for r in ks(real, made, numeric).collect()] if numeric else []
    if texts:
        a, b = frequencies(real, texts), frequencies(made, texts)
        na, nb = (f.groupBy("column").agg(F.sum("n").alias("t")) for f in (a, b))
        a = a.join(na, "column").select("column", "value", (F.col("n") / F.col("t")).alias("pa"))
        b = b.join(nb, "column").select("column", "value", (F.col("n") / F.col("t")).alias("pb"))
        gap = a.join(b, ["column", "value"]).groupBy("column").agg(F.avg(F.abs(F.col("pa") - F.col("pb"))).alias("g"))
        rows += [(r["column"], "categorical", half_up(1 - r["g"])) for r in gap.collect()]
    total = half_up(100 * sum(r[2] for r in rows) / max(1, len(rows)), 1)
    rows.append(("overall", "A" if total >= 90 else "B" if total >= 75 else "C" if total >= 60 else "D", total / 100))
    return report(real, rows, "column string, kind string, similarity double")
