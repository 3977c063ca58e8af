"""Drift between a reference table and a current table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up
from tablewise.functions.tails import chi2_sf, ks_sf
from tablewise.operators.information import binned_edges
from tablewise.operators.measures import (
    measure, melt, number, numeric_columns, quantiles, report, running_sums,
)

FLOOR = 0.0001  # share given to an empty bin or a missing category


def both_sides(reference: DataFrame, current: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """(side, column, value) of both tables, nulls removed."""
    a = melt(reference.withColumn("side", F.lit(0)), columns, kind, ["side"])
    b = melt(current.withColumn("side", F.lit(1)), columns, kind, ["side"])
    return a.union(b).where("value is not null")


def psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10) -> dict[str, float]:
    """Population stability index over the reference deciles; values outside their range are ignored.

    numpy bins are left-closed with a closed last bin, so a value on an inner edge opens the next bin.
    """
    edges = binned_edges(reference, {c: number(c) for c in columns}, bins)

    def bin_of(c):
        e, x = edges[c], number(c)
        if len(e) < 2:
            return F.lit(None).cast("int")
        out = F.when(x.isNull() | (x < e[0]) | (x > e[-1]), F.lit(None).cast("int"))
        for i, b in enumerate(e[1:-1]):
            out = out.when(x < b, F.lit(i))
        return out.otherwise(len(e) - 2)

    def cells(df, side):
        return df.select(F.lit(side).alias("side"), F.explode(F.array(*[F.struct(F.lit(c).alias("column"), bin_of(c).alias("bin"), number(c).isNotNull().alias("known")) for c in columns])).alias("x")).select("side", "x.*")

    counts = cells(reference, 0).union(cells(current, 1)).where("known").groupBy("column", "bin").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b")).collect()  # bins + 1 rows per column
    out = {}
    for c in columns:
        rows = {r["bin"]: r for r in counts if r["column"] == c}
        na, nb = sum(r["a"] for r in rows.values()), sum(r["b"] for r in rows.values())
        total = 0.0
        for i in range(max(0, len(edges[c]) - 1)):
            p = max(FLOOR, (rows[i]["a"] if i in rows else 0) / max(1, na))
            q = max(FLOOR, (rows[i]["b"] if i in rows else 0) / max(1, nb))
            total += (q - p) * math.log(q / p)
        out[c] = total
    return out


def ks(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n_reference, n_current, statistic): largest gap of the two distribution functions.

    Values are counted per side first; the running counts go over range buckets, so no
    column is ordered in a single task.
    """
    counts = both_sides(reference, current, columns, "double").groupBy("column", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    cum = running_sums(counts, ["column"], "value", {"ca": "a", "cb": "b"})
    return cum.join(totals, "column").groupBy("column").agg(
        F.max("na").alias("n_reference"), F.max("nb").alias("n_current"), F.max(F.abs(F.col("ca") / F.col("na") - F.col("cb") / F.col("nb"))).alias("statistic"))


def shifts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    """Means and population stds of both sides and the mean shift in reference stds."""
    exprs = {f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("a", F.avg), ("s", F.stddev_pop))}
    r, n = measure(reference, **exprs), measure(current, **exprs)
    return {c: (r[f"a{i}"], n[f"a{i}"], r[f"s{i}"], n[f"s{i}"], abs(n[f"a{i}"] - r[f"a{i}"]) / max(r[f"s{i}"], 1e-10)) for i, c in enumerate(columns)}


def numeric_status(score: float, p: float) -> str:
    return "high_drift" if score > 0.25 or p < 0.001 else "moderate_drift" if score > 0.1 or p < 0.05 else "no_drift"


def numeric_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    scores, moved = psi(reference, current, columns), shifts(reference, current, columns)
    rows = []
    for r in ks(reference, current, columns).collect():  # one row per column
        if r["n_reference"] >= 10 and r["n_current"] >= 5:
            c, p = r["column"], ks_sf(r["statistic"], r["n_reference"], r["n_current"])
            rows.append((c, half_up(scores[c]), half_up(r["statistic"]), half_up(p, 6), half_up(moved[c][4]), half_up(moved[c][0]), half_up(moved[c][1]),
                         half_up(moved[c][2]), half_up(moved[c][3]), numeric_status(scores[c], p)))
    return report(reference, rows, "column string, psi double, ks double, p_value double, mean_shift double, reference_mean double, current_mean double, reference_std double, current_std double, status string")


def category_counts(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    return both_sides(reference, current, columns, "string").groupBy("column", "value").agg(
        F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))


def categorical_drift(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PSI, chi-square, Cramer's V and the number of new and lost categories per text column."""
    counts = category_counts(reference, current, columns)
    totals = counts.groupBy("column").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, q = F.greatest(F.col("a") / F.col("na"), F.lit(FLOOR)), F.greatest(F.col("b") / F.col("nb"), F.lit(FLOOR))
    seen, want = F.greatest(F.col("b").cast("double"), F.lit(0.1)), F.greatest(F.col("a").cast("double"), F.lit(0.1)) * F.col("nb") / F.col("na")
    sums = counts.join(totals.where("na >= 10 and nb >= 5"), "column").groupBy("column").agg(
        F.max("nb").alias("nb"), F.count("*").alias("k"), F.sum((q - p) * F.log(q / p)).alias("psi"), F.sum((seen - want) * (seen - want) / want).alias("chi2"),
        F.count_if(F.col("a") == 0).alias("new"), F.count_if(F.col("b") == 0).alias("lost"))
    rows = []
    for r in sums.collect():  # one row per column
        p_value = chi2_sf(r["chi2"], r["k"] - 1)
        v = (r["chi2"] / (r["nb"] * max(r["k"] - 1, 1))) ** 0.5
        status = ("high_drift" if r["psi"] > 0.25 or p_value < 0.001 or v > 0.3 else "moderate_drift" if r["psi"] > 0.1 or p_value < 0.05 or v > 0.15 else "no_drift")
        rows.append((r["column"], half_up(abs(r["psi"])), half_up(r["chi2"]), half_up(p_value, 6), half_up(v), r["new"], r["lost"], status))
    return report(reference, rows, "column string, psi double, chi2 double, p_value double, cramers_v double, new_categories long, lost_categories long, status string")


def changed_categories(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Categories found on one side only."""
    return category_counts(reference, current, columns).where("a = 0 or b = 0").select(
        "column", "value", F.when(F.col("a") == 0, "new").otherwise("lost").alias("change"), F.greatest("a", "b").alias("n"))


def drift_status(reference: DataFrame, current: DataFrame, numeric: Sequence[str] | None = None, texts: Sequence[str] | None = None) -> DataFrame:
    """One row per common column: score, p-value and status."""
    common = [c for c in reference.columns if c in current.columns]
    numeric = [c for c in (numeric if numeric is not None else numeric_columns(reference)) if c in common]
    texts = [c for c in (texts if texts is not None else [c for c in common if dict(reference.dtypes)[c] == "string"]) if c in common]
    parts = []
    if numeric:
        parts.append(numeric_drift(reference, current, numeric).select("column", F.lit("numerical").alias("kind"), "psi", "p_value", "status"))
    if texts:
        parts.append(categorical_drift(reference, current, texts).select("column", F.lit("categorical").alias("kind"), "psi", "p_value", "status"))
    return parts[0].union(parts[1]) if len(parts) == 2 else parts[0]


def overall_status(status: DataFrame) -> DataFrame:
    """Mean score, counts by status, the overall level and whether to retrain."""
    s = status.agg(F.count("*").alias("columns"), F.round(F.avg("psi"), 4).alias("mean_psi"), F.count_if(F.col("status") == "high_drift").alias("high"),
                   F.count_if(F.col("status") == "moderate_drift").alias("moderate"))
    level = F.when((F.col("mean_psi") > 0.25) | (F.col("high") > 0.3 * F.col("columns")), "critical").when((F.col("mean_psi") > 0.1) | (F.col("high") > 0), "warning").otherwise("healthy")
    return s.withColumn("overall", level).withColumn("retrain", F.col("overall") == "critical")


def comparison(reference: DataFrame, current: DataFrame, numeric: Sequence[str], texts: Sequence[str] = ()) -> DataFrame:
    """Reference against current per column, most drifted first, with the retrain flag of the whole table."""
    parts = []
    if numeric:
        d = numeric_drift(reference, current, numeric)
        parts.append(d.select("column", F.lit("KS").alias("test"), "psi", "p_value", F.col("reference_mean").alias("reference"), F.col("current_mean").alias("current"), "status"))
    if texts:
        d = categorical_drift(reference, current, texts)
        none = F.lit(None).cast("double")
        parts.append(d.select("column", F.lit("chi-square").alias("test"), "psi", "p_value", none.alias("reference"), none.alias("current"), "status"))
    out = parts[0].union(parts[1]) if len(parts) == 2 else parts[0]
    flag = overall_status(out).first()["retrain"]
    return out.withColumn("retrain", F.lit(flag)).orderBy(F.desc("psi"), "column")


def prediction_drift(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """PSI, KS and the moments of a prediction column on both sides."""
    d = numeric_drift(reference, current, [column]).first()
    a, b = quantiles(reference, [column], [0.5])[column][0], quantiles(current, [column], [0.5])[column][0]
    status = "critical" if d["psi"] > 0.25 else "warning" if d["psi"] > 0.1 else "healthy"
    return report(reference, [(d["psi"], d["ks"], d["p_value"], d["reference_mean"], d["reference_std"], half_up(a), d["current_mean"], d["current_std"], half_up(b), status)],
                  "psi double, ks double, p_value double, reference_mean double, reference_std double, reference_median double, current_mean double, current_std double, current_median double, status string")


def score_drop(baseline: float, score: float) -> str:
    """Severity of a score drop on new labelled rows."""
    drop = baseline - score
    return "critical" if drop > 0.15 else "warning" if drop > 0.05 else "minor" if drop > 0 else "healthy"


def health(df: DataFrame, accuracy: float, drift: float, missing: float) -> DataFrame:
    """Health score of a model in use, its level and the actions due."""
    score = half_up(100 * (0.5 * accuracy + 0.3 * (1 - min(drift, 0.3)) + 0.2 * (1 - min(missing, 0.3))), 2)
    actions = ["optimize_model"] * (accuracy < 0.8) + ["retrain_model"] * (drift > 0.1)
    level = "Critical" if score < 60 else "Warning" if score < 80 else "Healthy"
    return report(df, [(score, level, ",".join(actions))], "health double, level string, actions string")
