"""Cleaning: duplicates, types, gaps, outliers, suggestions, repairs and column fates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import bias_corrected_skew, half_up, share
from tablewise.operators.explore import outlier_measures
from tablewise.operators.information import scaled_importance
from tablewise.operators.measures import (
    col, distinct_counts, measure, modes, null_counts, number, numeric_columns,
    pair_correlations, quantiles, report, text_columns,
)
from tablewise.operators.profile import duplicate_rows, kind_of

REPORT = "step string, column string, action string, value double"


def drop_duplicates(df: DataFrame, key: str | None = None) -> DataFrame:
    """One row of each group of equal rows; with a key column the smallest key is kept."""
    if key is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != key]
    return df.groupBy(*[col(c) for c in others]).agg(F.min(col(key)).alias(key)).select(*[col(c) for c in df.columns])


def as_number(c: str) -> Column:
    return F.expr("try_cast(trim(`%s`) as double)" % c.replace("`", "``"))


def numeric_text(df: DataFrame, threshold: float = 0.7) -> list[str]:
    """Text columns where more than ``threshold`` of all rows read as a number."""
    texts = text_columns(df)
    if not texts:
        return []
    row = measure(df, **{f"p{i}": share(as_number(c).isNotNull()) for i, c in enumerate(texts)})
    return [c for i, c in enumerate(texts) if (row[f"p{i}"] or 0) > threshold]


def fix_types(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    hits = numeric_text(df, threshold)
    return df.withColumns({c: as_number(c) for c in hits}) if hits else df


def mostly_missing(df: DataFrame, threshold: float = 0.7) -> list[str]:
    miss = null_counts(df, df.columns)
    return [c for c in df.columns if miss[c] > threshold * max(1, miss["*"])]


def drop_missing_columns(df: DataFrame, threshold: float = 0.7) -> DataFrame:
    return df.drop(*mostly_missing(df, threshold))


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill numeric gaps with the exact median; whole-number columns with gaps become double."""
    columns = list(columns or numeric_columns(df))
    miss = null_counts(df, columns)
    gaps = [c for c in columns if miss[c]]
    q = quantiles(df, gaps, [0.5])
    return df.withColumns({c: F.coalesce(number(c), F.lit(q[c][0])) for c in gaps if q[c][0] is not None}) if gaps else df


def fill_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill text gaps with the most frequent value, or 'Unknown' when there is none."""
    columns = list(columns or text_columns(df))
    miss = null_counts(df, columns)
    gaps = [c for c in columns if miss[c]]
    best = modes(df, gaps)
    return df.withColumns({c: F.coalesce(col(c), F.lit(best[c] if best[c] is not None else "Unknown")) for c in gaps}) if gaps else df


def outlier_plan(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> list[tuple]:
    """(column, strategy, low, high, outliers) for the columns worth capping."""
    columns = [c for c in (columns or numeric_columns(df)) if c != target]
    uniq, n = distinct_counts(df, columns), df.count()
    columns = [c for c in columns if uniq[c] > 5 and not (uniq[c] > 0.9 * n and n > 50)]
    found = [m for m in outlier_measures(df, columns) if m["n_outliers"] >= 0.02 * max(1, n)]
    if not found:
        return []
    names = [m["column"] for m in found]
    skews = measure(df, **{f"g{i}": bias_corrected_skew(number(c)) for i, c in enumerate(names)})
    wild = [c for i, c in enumerate(names) if abs(skews[f"g{i}"] or 0.0) > 2]
    tails = quantiles(df, wild, [0.01, 0.99])
    return [
        (m["column"], "winsorize_1_99", *tails[m["column"]], m["n_outliers"]) if m["column"] in wild
        else (m["column"], "iqr_cap", m["lower"], m["upper"], m["n_outliers"])
        for m in found
    ]


def cap_outliers(df: DataFrame, columns: Sequence[str] | None = None, target: str | None = None) -> DataFrame:
    """Clamp each chosen column to its 1.5 IQR fences, or to p1/p99 when heavily skewed."""
    caps = {c: F.when(number(c).isNotNull(), F.least(F.greatest(number(c), F.lit(lo)), F.lit(hi)))
            for c, _, lo, hi, _ in outlier_plan(df, columns, target)}
    return df.withColumns(caps) if caps else df


def clean_table(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Duplicates, types, sparse columns, gaps and outliers in that order, with a step report."""
    rows: list[tuple] = [("input", "", "rows", float(df.count())), ("input", "", "columns", float(len(df.columns)))]
    out = drop_duplicates(df)
    rows.append(("duplicates", "", "removed", float(rows[0][3] - out.count())))
    hits = numeric_text(out)
    rows += [("types", c, "to_number", 1.0) for c in hits]
    out = fix_types(out)
    sparse = [c for c in mostly_missing(out) if c != target]
    rows += [("sparse", c, "dropped", 1.0) for c in sparse]
    out = out.drop(*sparse)
    miss = null_counts(out, out.columns)
    rows += [("missing", c, "median" if kind_of(out, c) == "numeric" else "mode", float(miss[c]))
             for c in out.columns if miss[c] and kind_of(out, c) in ("numeric", "text")]
    out = fill_mode(fill_median(out))
    plan = outlier_plan(out, target=target)
    rows += [("outliers", c, how, float(n)) for c, how, _, _, n in plan]
    caps = {c: F.least(F.greatest(number(c), F.lit(lo)), F.lit(hi)) for c, _, lo, hi, _ in plan}
    out = out.withColumns(caps) if caps else out
    rows += [("output", "", "rows", rows[0][3] - rows[2][3]), ("output", "", "columns", float(len(out.columns)))]
    return out, report(df, rows, REPORT)


def suggestions(df: DataFrame) -> DataFrame:
    """Cleaning suggestions (type, column, impact, strategy, low, high), numbered in order."""
    out: list[tuple] = []
    miss = null_counts(df, df.columns)
    n = max(1, miss["*"])
    dup = duplicate_rows(df)
    if dup:
        out.append(("duplicates", "__all__", "high" if 100 * dup / n > 5 else "medium", None, None, None))
    nums, texts = numeric_columns(df), text_columns(df)
    skews = measure(df, **{f"g{i}": bias_corrected_skew(number(c)) for i, c in enumerate(nums)}) if nums else None
    uniq = distinct_counts(df, df.columns)
    for c in df.columns:
        pct = half_up(100.0 * miss[c] / n, 1)
        if pct > 60:
            out.append(("drop_column", c, "high", None, None, None))
        elif pct > 0:
            how = "mode"
            if c in nums:
                how = "median" if uniq[c] > 2 and abs(skews[f"g{nums.index(c)}"] or 0) > 1 else "mean"
            out.append(("fill_missing", c, "high" if pct > 20 else "medium" if pct > 5 else "low", how, None, None))
    for m in outlier_measures(df, nums):
        pct = half_up(m["pct"], 1)
        if pct > 0.5:
            out.append(("remove_outliers", m["column"], "medium" if pct < 5 else "high", None, half_up(m["lower"]), half_up(m["upper"])))
    for c in df.columns:
        if uniq[c] <= 1 or (c in texts and uniq[c] == n):
            out.append(("drop_column", c, "medium", "constant" if uniq[c] <= 1 else "identifier", None, None))
    out += [("fix_type", c, "medium", None, None, None) for c in numeric_text(df, 0.9)]
    pairs = [(b, a) for (a, b), r in sorted(pair_correlations(df, nums).items(), key=lambda p: (nums.index(p[0][1]), nums.index(p[0][0]))) if r is not None and abs(r) > 0.95]
    out += [("drop_correlated", b, "medium", a, None, None) for b, a in pairs]
    return report(df, [(i, *r) for i, r in enumerate(out)], "id int, type string, column string, impact string, strategy string, low double, high double")


def apply_suggestions(df: DataFrame, chosen: DataFrame, ids: Sequence[int] | None = None) -> DataFrame:
    """Apply the chosen suggestions in order. Range filters drop rows without a value too."""
    wanted = [r for r in chosen.orderBy("id").collect() if ids is None or r["id"] in ids]  # one row per suggestion
    for r in wanted:
        c = r["column"]
        if r["type"] == "duplicates":
            df = df.dropDuplicates()
        elif c not in df.columns:
            continue
        elif r["type"] in ("drop_column", "drop_correlated"):
            df = df.drop(c)
        elif r["type"] == "fill_missing":
            if r["strategy"] == "median":
                df = fill_median(df, [c])
            elif r["strategy"] == "mean":
                df = df.withColumn(c, F.coalesce(number(c), F.lit(measure(df, a=F.avg(number(c)))["a"])))
            else:
                df = fill_mode(df, [c])
        elif r["type"] == "remove_outliers":
            df = df.where(number(c).between(r["low"], r["high"]))
        elif r["type"] == "fix_type":
            df = df.withColumn(c, as_number(c))
    return df


def column_fates(df: DataFrame, transformed: Sequence[str], target: str, dropped: Mapping[str, str] = {}, encoded: Mapping[str, str] = {}, scaled: Sequence[str] = ()) -> DataFrame:
    """What became of each original column, with its importance and whether it can be brought back."""
    miss = null_counts(df, df.columns)
    rows = []
    for c in df.columns:
        if c == target:
            fate, why = "target", "prediction target"
        elif c in dropped:
            fate, why = "dropped", dropped[c]
        elif c in encoded:
            fate, why = "encoded", encoded[c]
        elif c in transformed:
            fate, why = ("scaled", "standard scaling") if c in scaled else ("kept", "unchanged")
        else:
            made = [x for x in transformed if x.startswith(c + "_")]
            fate, why = ("encoded", f"one-hot into {len(made)}") if made else ("dropped", "unknown")
        rows.append((c, fate, why, fate == "dropped", half_up(100.0 * miss[c] / max(1, miss["*"]), 2)))
    fates = report(df, rows, "column string, fate string, reason string, restorable boolean, missing_pct double")
    return fates.join(scaled_importance(df, target), "column", "left").fillna(0.0, ["importance"])


def fate_summary(fates: DataFrame) -> DataFrame:
    return fates.groupBy("fate").agg(F.count("*").alias("n"), F.count_if("restorable").alias("restorable"))


def repair_nonfinite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null, NaN and infinite numbers become the median of the finite values."""
    columns = list(columns or numeric_columns(df))
    inf = float("inf")
    finite = {c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) != inf), number(c)) for c in columns}
    q = quantiles(df, finite, [0.5])
    return df.withColumns({c: F.coalesce(finite[c], F.lit(q[c][0])) for c in columns})


def diagnose_scores(df: DataFrame, target: str, features: Sequence[str], best: float, train: float, test: float, problem: str = "classification") -> DataFrame:
    """Why scores are weak: constant target, continuous target, constant features, overfitting."""
    out = []
    if best < (0.55 if problem == "classification" else 0.1):
        uniq = distinct_counts(df, [target])[target]
        row = measure(df, n=F.count(col(target)), **{f"s{i}": F.stddev_pop(number(c)) for i, c in enumerate(features)})
        if uniq == 1:
            out.append(("constant_target", "critical", 1.0))
        elif problem == "classification" and uniq > 0.5 * row["n"]:
            out.append(("continuous_target", "high", float(uniq)))
        flat = sum((row[f"s{i}"] or 0.0) < 1e-8 for i in range(len(features)))
        if flat > 0.5 * len(features):
            out.append(("constant_features", "high", float(flat)))
    if train - test > 0.15:
        out.append(("overfitting", "high", half_up(train - test)))
    return report(df, out, "issue string, severity string, value double")
