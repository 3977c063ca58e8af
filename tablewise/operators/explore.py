"""Exploratory measures: distributions, correlations, missing patterns, outliers, target, insights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.moments import bias_corrected_kurtosis, bias_corrected_skew, half_up
from tablewise.operators.measures import (
    col, correlation, distinct_counts, frequencies, histogram, measure, null_counts, number, numeric_columns,
    pair_correlations, pick, quantiles, report, text_columns, top_values,
)
from tablewise.operators.profile import column_histograms, duplicate_rows, kind_of


def overview(df: DataFrame) -> DataFrame:
    kinds = [kind_of(df, c) for c in df.columns]
    miss = null_counts(df, df.columns)
    n, cells, dup = miss["*"], sum(miss[c] for c in df.columns), duplicate_rows(df)
    return report(
        df,
        [(n, len(kinds), kinds.count("numeric"), kinds.count("text"), kinds.count("datetime"), cells,
          half_up(100.0 * cells / max(1, n * len(kinds)), 2), dup, half_up(100.0 * dup / max(1, n), 2))],
        "n_rows long, n_columns int, n_numeric int, n_text int, n_datetime int, missing_cells long, missing_pct double, duplicate_rows long, duplicate_pct double",
    )


def distributions(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean, median, std, min, max, skewness, kurtosis and quartiles of numeric columns."""
    columns = list(columns or numeric_columns(df))
    fns = {"n": F.count, "a": F.avg, "s": F.stddev_samp, "lo": F.min, "hi": F.max, "g": bias_corrected_skew, "k": bias_corrected_kurtosis}
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in fns.items()})
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = [
        (c, row[f"n{i}"], half_up(row[f"a{i}"]), half_up(q[c][1]), half_up(row[f"s{i}"]), half_up(row[f"lo{i}"]), half_up(row[f"hi{i}"]),
         half_up(row[f"g{i}"]), half_up(row[f"k{i}"]), half_up(q[c][0]), half_up(q[c][2]))
        for i, c in enumerate(columns)
    ]
    return report(df, rows, "column string, n long, mean double, median double, std double, min double, max double, skewness double, kurtosis double, q25 double, q75 double")


def normality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """D'Agostino-Pearson K2 and its p-value, from the count, skewness and kurtosis of each column."""
    columns = list(columns or numeric_columns(df))
    exprs = {}
    for i, c in enumerate(columns):
        exprs |= {f"n{i}": F.count(number(c)), f"g{i}": F.skewness(number(c)), f"k{i}": F.kurtosis(number(c))}
    row = measure(df, **exprs)
    rows = []
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n >= 20 and row[f"g{i}"] is not None:
            k2 = k_squared(n, row[f"g{i}"], row[f"k{i}"] + 3.0)
            p = 2.718281828459045 ** (-k2 / 2)
            rows.append((c, n, half_up(k2), half_up(p, 6), p > 0.05))
    return report(df, rows, "column string, n long, k2 double, p_value double, is_normal boolean")


def k_squared(n: int, g1: float, b2: float) -> float:
    """Sum of the squared normal scores of skewness (D'Agostino 1970) and kurtosis (Anscombe-Glynn 1983)."""
    import math

    y = g1 * math.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))
    w2 = math.sqrt(2 * (beta - 1)) - 1
    alpha = math.sqrt(2.0 / (w2 - 1))
    z1 = math.asinh(y / alpha) / math.sqrt(0.5 * math.log(w2))
    mean = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (b2 - mean) / math.sqrt(var)
    root = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * math.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    d = 1 + x * math.sqrt(2 / (a - 4))
    third = math.copysign((abs(1 - 2 / a) / abs(d)) ** (1 / 3), d) if d else 0.0
    z2 = (1 - 2 / (9 * a) - third) / math.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


def modality(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 20) -> DataFrame:
    """Near-zero variance and the number of local peaks of a 20-bin histogram."""
    columns = list(columns or numeric_columns(df))
    exprs = {}
    for i, c in enumerate(columns):
        exprs |= {f"s{i}": F.stddev_samp(number(c)), f"lo{i}": F.min(number(c)), f"hi{i}": F.max(number(c)), f"n{i}": F.count(number(c))}
    row = measure(df, **exprs)
    wide = {c: (row[f"lo{i}"], row[f"hi{i}"], bins) for i, c in enumerate(columns) if row[f"n{i}"] > 50}
    flat = report(df, [(c, bool((row[f"s{i}"] or 0.0) < 1e-6)) for i, c in enumerate(columns)], "column string, near_zero_variance boolean")
    if not wide:
        return flat.select("*", F.lit(0).cast("long").alias("n_modes"), F.lit(False).alias("is_multimodal"))
    w = Window.partitionBy("column").orderBy("bin")
    peaks = (
        histogram(df, wide)
        .select("column", "n", F.lag("n").over(w).alias("p"), F.lead("n").over(w).alias("q"))
        .groupBy("column").agg(F.count_if((F.col("n") > F.col("p")) & (F.col("n") > F.col("q"))).alias("n_modes"))
    )
    return flat.join(peaks, "column", "left").select(
        "column", "near_zero_variance", F.coalesce("n_modes", F.lit(0)).cast("long").alias("n_modes"),
        (F.coalesce("n_modes", F.lit(0)) >= 2).alias("is_multimodal"))


def text_distribution(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """15 most frequent values with their share, and the cardinality flags of the column."""
    columns = list(columns or text_columns(df))
    miss, uniq = null_counts(df, columns), distinct_counts(df, columns)
    dates = measure(df, **{f"d{i}": F.avg(parses_as_date(col(c)).cast("double")) for i, c in enumerate(columns)})
    n = max(1, miss["*"])
    flags = report(
        df, [(c, uniq[c], uniq[c] > 50, uniq[c] == miss["*"], (dates[f"d{i}"] or 0.0) > 0.75) for i, c in enumerate(columns)],
        "column string, distinct long, high_cardinality boolean, potential_id boolean, potential_datetime boolean")
    top = top_values(frequencies(df, columns), 15)
    return top.join(flags, "column").select(
        "column", "value", "n", F.round(100.0 * F.col("n") / n, 2).alias("pct"), "distinct", "high_cardinality", "potential_id", "potential_datetime")


def parses_as_date(c):
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(p)) for p in DATE_FORMATS]).isNotNull()


# Date layouts tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every pair of numeric columns with its correlation and strength."""
    columns = list(columns or numeric_columns(df))
    rows = [
        (a, b, half_up(r), None if r is None else "strong" if abs(r) > 0.7 else "moderate" if abs(r) > 0.3 else "weak")
        for (a, b), r in pair_correlations(df, columns).items()
    ]
    return report(df, rows, "feature_1 string, feature_2 string, correlation double, strength string")


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, n: int | None = 20) -> DataFrame:
    """The ``n`` strongest pairs above 0.3; all if null."""
    found = (
        correlation_matrix(df, columns).where("abs(correlation) > 0.3")
        .orderBy(F.desc(F.abs("correlation")), "feature_1", "feature_2")
    )
    return found if n is None else found.limit(n)


def missing_by_column(df: DataFrame, n: int | None = None) -> DataFrame:
    """Columns with nulls, most first; ``n`` of them if given."""
    miss = null_counts(df, df.columns)
    rows = sorted(((c, miss[c], half_up(100.0 * miss[c] / max(1, miss["*"]), 2)) for c in df.columns if miss[c]), key=lambda r: (-r[1], r[0]))
    return report(df, rows[:n], "column string, missing long, pct double")


def co_missing(df: DataFrame, worst: int | None = None) -> DataFrame:
    """Pairs of columns (of the ``worst`` ones, if given) whose nulls overlap by more than half."""
    miss = null_counts(df, df.columns)
    gaps = sorted((c for c in df.columns if miss[c]), key=lambda c: (-miss[c], c))[:worst]
    pairs = [(a, b) for i, a in enumerate(gaps) for b in gaps[i + 1 :]]
    if not pairs:
        return report(df, [], "column_1 string, column_2 string, overlap double, both_missing long")
    exprs = {}
    for i, (a, b) in enumerate(pairs):
        exprs |= {f"b{i}": F.count_if(col(a).isNull() & col(b).isNull()), f"e{i}": F.count_if(col(a).isNull() | col(b).isNull())}
    row = measure(df, **exprs)
    rows = [(a, b, half_up(row[f"b{i}"] / row[f"e{i}"], 3), row[f"b{i}"]) for i, (a, b) in enumerate(pairs)
            if row[f"e{i}"] and row[f"b{i}"] / row[f"e{i}"] > 0.5]
    return report(df, rows, "column_1 string, column_2 string, overlap double, both_missing long")


def outlier_measures(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> list[dict]:
    """Fences, counts and range per column with at least 10 values and a positive IQR."""
    q = quantiles(df, columns, [0.25, 0.75])
    fences = {c: (a - factor * (b - a), b + factor * (b - a)) for c, (a, b) in q.items() if a is not None and b > a}
    if not fences:
        return []
    exprs = {}
    for i, (c, (lo, hi)) in enumerate(fences.items()):
        x = number(c)
        exprs |= {f"o{i}": F.count_if((x < lo) | (x > hi)), f"n{i}": F.count(x), f"lo{i}": F.min(x), f"hi{i}": F.max(x)}
    row = measure(df, **exprs)
    return [
        dict(column=c, n_outliers=row[f"o{i}"], n=row[f"n{i}"], pct=100.0 * row[f"o{i}"] / row[f"n{i}"], lower=lo, upper=hi,
             min=row[f"lo{i}"], max=row[f"hi{i}"], q1=q[c][0], q3=q[c][1])
        for i, (c, (lo, hi)) in enumerate(fences.items()) if row[f"n{i}"] >= 10
    ]


def outlier_table(df: DataFrame, columns: Sequence[str] | None = None, n: int | None = None) -> DataFrame:
    found = [m for m in outlier_measures(df, list(columns or numeric_columns(df))) if m["n_outliers"]]
    found.sort(key=lambda m: (-m["n_outliers"], m["column"]))
    rows = [(m["column"], m["n_outliers"], half_up(m["pct"], 2), half_up(m["lower"]), half_up(m["upper"]), half_up(m["min"]), half_up(m["max"])) for m in found[:n]]
    return report(df, rows, "column string, n_outliers long, pct double, lower_bound double, upper_bound double, min double, max double")


def target_classes(df: DataFrame, target: str) -> DataFrame:
    """Class counts and shares of a target with the largest-to-smallest ratio."""
    counts = df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("top"), F.min("n").alias("low")).first()
    ratio = half_up((total["top"] or 0) / max(1, total["low"] or 0), 2)
    return counts.select(
        "label", "n", F.round(100.0 * F.col("n") / (total["rows"] or 1), 2).alias("pct"),
        F.lit(ratio).alias("imbalance_ratio"), F.lit(bool((total["top"] or 0) > 3 * (total["low"] or 0))).alias("is_imbalanced"))


def target_correlations(df: DataFrame, target: str, n: int = 15) -> DataFrame:
    """Correlation of each numeric column with the target, strongest first, with a leakage flag."""
    cols = numeric_columns(df, [target])
    row = measure(df, **{f"r{i}": correlation(number(target), number(c)) for i, c in enumerate(cols)})
    got = sorted(((c, row[f"r{i}"]) for i, c in enumerate(cols) if row[f"r{i}"] is not None and row[f"r{i}"] == row[f"r{i}"]), key=lambda p: (-abs(p[1]), p[0]))
    return report(df, [(c, half_up(r), abs(r) > 0.95) for c, r in got[:n]], "feature string, correlation double, leakage boolean")


def insights(df: DataFrame, target: str | None = None) -> DataFrame:
    """Findings as rows (rule, severity, column, value)."""
    out: list[tuple] = []
    miss = missing_by_column(df).collect()
    if miss and miss[0]["pct"] > 30:
        out.append(("missing", "high", miss[0]["column"], miss[0]["pct"]))
    if len(miss) > 1:
        pairs = co_missing(df).collect()
        if pairs:
            out.append(("co_missing", "medium", f"{pairs[0][0]},{pairs[0][1]}", pairs[0]["overlap"]))
    top = top_correlations(df, n=1).collect()
    if top and abs(top[0]["correlation"]) > 0.9:
        out.append(("multicollinearity", "high", f"{top[0][0]},{top[0][1]}", top[0]["correlation"]))
    for r in distributions(df).collect():
        if r["skewness"] is not None and abs(r["skewness"]) > 2:
            out.append(("skewed", "medium", r["column"], r["skewness"]))
    for r in modality(df).collect():
        if r["near_zero_variance"]:
            out.append(("near_zero_variance", "medium", r["column"], 0.0))
        if r["is_multimodal"]:
            out.append(("multimodal", "low", r["column"], float(r["n_modes"])))
    over = overview(df).first()
    uniq = distinct_counts(df, text_columns(df))
    for c, u in uniq.items():
        if u > 50:
            out.append(("high_cardinality", "medium", c, float(u)))
        if u == over["n_rows"]:
            out.append(("potential_id", "high", c, float(u)))
    for r in outlier_table(df).where("pct > 5").collect():
        if r["pct"] > 5:
            out.append(("outliers", "medium", r["column"], r["pct"]))
    if target:
        if distinct_counts(df, [target])[target] <= 20:
            t = target_classes(df, target).first()
            if t["is_imbalanced"]:
                out.append(("class_imbalance", "high", target, t["imbalance_ratio"]))
        if kind_of(df, target) == "numeric":
            lead = target_correlations(df, target, 1).collect()
            if lead and lead[0]["leakage"]:
                out.append(("leakage", "critical", lead[0]["feature"], lead[0]["correlation"]))
    if over["n_rows"] < 100:
        out.append(("small_table", "medium", "", float(over["n_rows"])))
    if over["duplicate_pct"] > 5:
        out.append(("duplicates", "medium", "", over["duplicate_pct"]))
    return report(df, out, "rule string, severity string, column string, value double")


def recommendations(df: DataFrame, target: str | None = None) -> DataFrame:
    """Actions as rows (priority, category, action, column, value)."""
    out: list[tuple] = []
    for r in missing_by_column(df).collect():
        if r["pct"] > 60:
            out.append(("high", "Missing Data", "drop", r["column"], r["pct"]))
        elif r["pct"] > 5:
            out.append(("medium", "Missing Data", "impute", r["column"], r["pct"]))
    for r in top_correlations(df, n=None).collect():
        if abs(r["correlation"]) > 0.95:
            out.append(("high", "Multicollinearity", "drop", r["feature_2"], r["correlation"]))
        elif abs(r["correlation"]) > 0.8:
            out.append(("medium", "Multicollinearity", "review", r["feature_2"], r["correlation"]))
    for r in outlier_table(df).where("pct > 5").collect():
        if r["pct"] > 5:
            out.append(("medium", "Outliers", "cap", r["column"], r["pct"]))
    for r in distributions(df).collect():
        if r["skewness"] is not None and abs(r["skewness"]) > 2:
            out.append(("low", "Distribution", "log", r["column"], r["skewness"]))
    if target and distinct_counts(df, [target])[target] <= 20:
        t = target_classes(df, target).first()
        if t["is_imbalanced"]:
            out.append(("high", "Class Imbalance", "rebalance", target, t["imbalance_ratio"]))
    return report(df, out, "priority string, category string, action string, column string, value double")
