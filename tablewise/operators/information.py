"""Mutual information of columns with a target, from binned contingency counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.operators.measures import bins_right_closed, col, distinct_counts, number, numeric_columns, quantiles, report, text_columns
from tablewise.operators.profile import kind_of


def binned_edges(df: DataFrame, features: Mapping[str, Column], bins: int = 10) -> dict[str, list[float]]:
    q = quantiles(df, features, [i / bins for i in range(bins + 1)])
    return {c: sorted({v for v in vals if v is not None}) for c, vals in q.items()}


def binned(value: Column, edges: list[float]) -> Column:
    return bins_right_closed(value, edges) if len(edges) > 1 else F.when(value.isNotNull(), F.lit(0))


def mutual_information(df: DataFrame, target: str, features: Mapping[str, Column] | None = None, bins: int = 10) -> DataFrame:
    """(feature, mi) in nats over quantile bins; a numeric target with over 20 values is binned too.

    All features are counted in one melted aggregate of at most bins x classes rows per feature.
    """
    features = dict(features or {c: number(c) for c in numeric_columns(df, [target])})
    y = col(target).cast("string")
    if kind_of(df, target) == "numeric" and distinct_counts(df, [target])[target] > 20:
        y = binned(number(target), binned_edges(df, {target: number(target)}, bins)[target]).cast("string")
    edges = binned_edges(df, features, bins)
    cells = df.select(
        y.alias("y"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), binned(x.cast("double"), edges[c]).alias("bin")) for c, x in features.items()])).alias("f"),
    ).select("y", "f.feature", "f.bin").where("y is not null and bin is not null")
    joint = cells.groupBy("feature", "bin", "y").agg(F.count("*").cast("double").alias("n"))
    # MI = ln N + (sum n ln n - sum nx ln nx - sum ny ln ny) / N: three sums per feature, no window and no wide join
    def spread(counts: DataFrame, name: str) -> DataFrame:
        return counts.groupBy("feature").agg(F.sum(F.col("n") * F.log("n")).alias(name), F.sum("n").alias(f"{name}_n"))

    cells_ = spread(joint, "c")
    across = spread(joint.groupBy("feature", "bin").agg(F.sum("n").alias("n")), "x")
    down = spread(joint.groupBy("feature", "y").agg(F.sum("n").alias("n")), "y")
    mi = F.log("c_n") + (F.col("c") - F.col("x") - F.col("y")) / F.col("c_n")
    return cells_.join(across, "feature").join(down, "feature").select("feature", F.greatest(F.lit(0.0), mi).alias("mi"))


def scaled_importance(df: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """Mutual information scaled to the top column; text columns get 0.3, 0.1 or 0 by cardinality."""
    mi = mutual_information(df, target, bins=bins)
    top = mi.agg(F.max("mi")).first()[0] or 1.0
    texts = [c for c in text_columns(df) if c != target]
    uniq = distinct_counts(df, texts)
    fixed = [(c, 0.0 if uniq[c] <= 1 else 0.3 if uniq[c] <= 20 else 0.1) for c in texts]
    scaled = mi.select(F.col("feature").alias("column"), F.round(F.col("mi") / (top if top > 0 else 1.0), 4).alias("importance"))
    return scaled.union(report(df, fixed, "column string, importance double")) if fixed else scaled
