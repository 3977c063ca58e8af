"""Group rates, fairness gaps and bias amplification of 0/1 predictions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as fixed
from tablewise.functions.moments import rounded
from tablewise.operators.measures import distinct_counts, melt, report


def sensitive_columns(df: DataFrame) -> DataFrame:
    """Columns named like a protected attribute with their number of groups."""
    hits = {c: next((k for k, p in fixed.SENSITIVE_NAMES.items() if re.search(p, c)), None) for c in df.columns}
    hits = {c: k for c, k in hits.items() if k}
    uniq = distinct_counts(df, list(hits))
    return report(df, [(c, k, uniq[c]) for c, k in hits.items()], "column string, category string, groups long")


def group_counts(df: DataFrame, columns: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Exact confusion counts per (column, group); attributes with 2 to 20 groups, groups of at least 5 rows."""
    y, p = F.col("y"), F.col("p")
    long = melt(df.withColumns({"y": F.col(label), "p": F.col(prediction)}), columns, "string", ["y", "p"]).where("value is not null")
    groups = long.groupBy("column", F.col("value").alias("group")).agg(
        F.count("*").alias("size"), F.count_if(p == 1).alias("pos"), F.count_if(y == 1).alias("real"), F.count_if(y == p).alias("hit"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 0) & (p == 0)).alias("tn"))
    uniq = distinct_counts(df, columns)
    return groups.where(F.col("column").isin([c for c in columns if 2 <= uniq[c] <= 20]) & (F.col("size") >= 5))


def rates(counts: DataFrame) -> DataFrame:
    one = F.lit(1)
    return counts.select(
        "column", "group", "size", (F.col("pos") / F.col("size")).alias("positive_rate"), (F.col("hit") / F.col("size")).alias("accuracy"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one)).alias("tpr"), (F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), one)).alias("fpr"),
        (F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one)).alias("precision"))


def group_rates(df: DataFrame, columns: Sequence[str], label: str, prediction: str) -> DataFrame:
    out = rates(group_counts(df, columns, label, prediction))
    return out.withColumns({c: rounded(F.col(c)) for c in ("positive_rate", "accuracy", "tpr", "fpr", "precision")})


def fairness_audit(df: DataFrame, columns: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Parity gap, disparate impact, equalised-odds gaps, score and grade per attribute."""
    r = rates(group_counts(df, columns, label, prediction))
    floor = lambda c: F.when(c > 0, c).otherwise(0.001)
    gaps = r.groupBy("column").agg(
        F.count("*").alias("groups"), (F.max("positive_rate") - F.min("positive_rate")).alias("parity_gap"),
        (floor(F.min("positive_rate")) / floor(F.max("positive_rate"))).alias("disparate_impact"),
        (F.max("tpr") - F.min("tpr")).alias("tpr_gap"), (F.max("fpr") - F.min("fpr")).alias("fpr_gap")).where("groups >= 2")
    cut = lambda test, n: F.when(test, n).otherwise(0)
    score = F.greatest(F.lit(0), 100 - cut(F.col("parity_gap") > 0.1, 25) - cut(F.col("parity_gap") > 0.2, 25) - cut(F.col("disparate_impact") < 0.8, 20)
                       - cut(F.col("tpr_gap") > 0.1, 15) - cut(F.col("fpr_gap") > 0.1, 15))
    s = F.col("score")
    return gaps.withColumn("score", score).select(
        "column", "groups", *[rounded(F.col(c)).alias(c) for c in ("parity_gap", "disparate_impact", "tpr_gap", "fpr_gap")], "score",
        F.when(s >= 90, "A").when(s >= 75, "B").when(s >= 60, "C").when(s >= 40, "D").otherwise("F").alias("grade"),
        F.concat_ws(",", F.when(F.col("parity_gap") > 0.1, "reweight"), F.when(F.col("disparate_impact") < 0.8, "remove_proxies"), F.when(F.col("tpr_gap") > 0.15, "equalize_odds")).alias("mitigations"))


def attach_sensitive(scored: DataFrame, source: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Bring sensitive columns back to the scored rows by key."""
    return scored.join(source.select(key, *columns), key)


def bias_amplification(df: DataFrame, columns: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Gap of predicted positive rates over the gap of real ones per attribute."""
    g = group_counts(df, columns, label, prediction).select(
        "column", "group", F.round(F.col("real") / F.col("size"), 4).alias("data_rate"), F.round(F.col("pos") / F.col("size"), 4).alias("pred_rate"))
    moved = F.round(F.col("pred_rate") - F.col("data_rate"), 6)
    a = g.groupBy("column").agg(
        F.count("*").alias("groups"), F.round(F.max("data_rate") - F.min("data_rate"), 4).alias("data_gap"), F.round(F.max("pred_rate") - F.min("pred_rate"), 4).alias("prediction_gap"),
        F.min(F.struct((-moved).alias("m"), "group"))["group"].alias("most_gained"), F.min(F.struct(moved.alias("m"), "group"))["group"].alias("most_lost")).where("groups >= 2")
    factor = F.when(F.col("data_gap") > 0.01, F.col("prediction_gap") / F.col("data_gap")).when(F.col("prediction_gap") > 0.01, 999.0).otherwise(1.0)
    x = F.col("factor")
    return a.withColumn("factor", factor).select(
        "column", "groups", "data_gap", "prediction_gap", rounded(x).alias("factor"),
        F.when(x > 1.5, "critical").when(x > 1.1, "warning").when(x >= 0.9, "neutral").otherwise("good").alias("severity"), "most_gained", "most_lost")
