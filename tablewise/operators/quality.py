"""Quality scores, sufficiency checks and reframing hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import bias_corrected_skew, half_up, share
from tablewise.operators.measures import (
    col, correlation, distinct_counts, measure, null_counts, number, numeric_columns, quantiles, report, text_columns,
)
from tablewise.operators.profile import duplicate_rows, kind_of


def grade(score: float) -> str:
    return "A" if score >= 90 else "B" if score >= 80 else "C" if score >= 70 else "D" if score >= 50 else "F"


def column_measures(df: DataFrame, target: str | None = None) -> list[dict]:
    """Everything the column scores need, in three aggregates for the whole table."""
    columns = [c for c in df.columns if c != target]
    nums = [c for c in columns if kind_of(df, c) == "numeric"]
    q = quantiles(df, nums, [0.25, 0.5, 0.75])
    exprs = {"n": F.count("*")}
    for i, c in enumerate(columns):
        exprs[f"k{i}"] = F.count(col(c))
        if kind_of(df, c) == "text":
            exprs[f"t{i}"] = F.count_if(F.expr("try_cast(replace(trim(`%s`), ',', '') as double)" % c).isNotNull())
        elif c in nums and q[c][0] is not None:
            x, (q1, _, q3) = number(c), q[c]
            iqr = q3 - q1
            exprs |= {
                f"e{i}": F.count_if((x < q1 - 3 * iqr) | (x > q3 + 3 * iqr)), f"o{i}": F.count_if((x < q1 - 1.5 * iqr) | (x > q3 + 1.5 * iqr)),
                f"g{i}": bias_corrected_skew(x), f"z{i}": F.count_if(x < 0),
            }
    row, uniq = measure(df, **exprs).asDict(), distinct_counts(df, columns)
    out = []
    for i, c in enumerate(columns):
        n, known = row["n"], row[f"k{i}"]
        m = dict(column=c, kind=kind_of(df, c), n=n, known=known, distinct=uniq[c], numeric_text=row.get(f"t{i}"))
        m["skew"] = half_up(row.get(f"g{i}"), 3) if known > 10 else None
        iqr = (q[c][2] - q[c][0]) if c in nums and q[c][0] is not None else 0
        m["extreme"] = row.get(f"e{i}", 0) if iqr > 0 and known > 10 else 0
        m["outlier_pct"] = half_up(100.0 * row.get(f"o{i}", 0) / max(1, known), 2) if iqr > 0 and known > 10 else 0.0
        m["negatives"] = row.get(f"z{i}", 0) if c in nums and known > 10 and q[c][1] is not None and q[c][1] > 0 else 0
        out.append(m)
    return out


def quality_parts(m: dict) -> dict:
    n = max(1, m["n"])
    complete = 100.0 * m["known"] / n
    ratio = m["distinct"] / n
    if m["kind"] == "numeric":
        unique = min(100.0, ratio * 200)
    else:
        unique = 30.0 if ratio > 0.95 else 40.0 if ratio < 0.001 and m["n"] > 100 else 80.0
    mixed = m["kind"] == "text" and m["known"] and 0.2 < m["numeric_text"] / m["known"] < 0.8
    consistent = 40.0 if mixed else 100.0
    valid = 80.0 if m["extreme"] / max(1, m["known"]) > 0.05 else 100.0
    score = 0.35 * complete + 0.25 * consistent + 0.25 * valid + 0.15 * unique
    return dict(completeness=complete, consistency=consistent, validity=valid, uniqueness=unique, score=score)


def column_quality(df: DataFrame, target: str | None = None) -> DataFrame:
    """Quality score and grade per column. Text consistency looks at all values, not the first 50."""
    rows = []
    for m in column_measures(df, target):
        p = quality_parts(m)
        rows.append((m["column"], half_up(p["score"], 1), grade(p["score"]), half_up(p["completeness"], 1), half_up(p["consistency"], 1), half_up(p["validity"], 1), half_up(p["uniqueness"], 1)))
    return report(df, rows, "column string, score double, grade string, completeness double, consistency double, validity double, uniqueness double")


def validity_findings(df: DataFrame, target: str | None = None) -> DataFrame:
    """Extreme values beyond 3 IQR and rare negatives per numeric column."""
    rows = [
        (m["column"], m["extreme"], half_up(100.0 * m["extreme"] / max(1, m["known"]), 2), m["extreme"] / max(1, m["known"]) > 0.05,
         m["negatives"], 0 < m["negatives"] < 0.05 * m["known"])
        for m in column_measures(df, target) if m["kind"] == "numeric"
    ]
    return report(df, rows, "column string, extreme long, extreme_pct double, penalised boolean, negatives long, suspicious_negatives boolean")


def shape_label(skew: float | None) -> str | None:
    if skew is None:
        return None
    if abs(skew) < 0.5:
        return "normal"
    if skew > 0:
        return "highly_right_skewed" if skew > 1.5 else "right_skewed"
    return "highly_left_skewed" if skew < -1.5 else "left_skewed"


def quality_actions(df: DataFrame, target: str | None = None) -> DataFrame:
    """Distribution label and recommended actions per column."""
    rows = []
    for m in column_measures(df, target):
        p = quality_parts(m)
        acts = ["drop_or_impute"] if p["completeness"] < 70 else ["impute"] if p["completeness"] < 95 else []
        acts += ["clip_outliers"] * (m["outlier_pct"] > 5)
        acts += ["log_transform"] * (m["skew"] is not None and abs(m["skew"]) > 1.5)
        acts += ["review_column"] * (m["kind"] == "text" and p["uniqueness"] < 40)
        rows.append((m["column"], m["skew"], shape_label(m["skew"]), m["outlier_pct"], ",".join(acts)))
    return report(df, rows, "column string, skewness double, distribution string, outlier_pct double, actions string")


def table_quality(df: DataFrame, target: str | None = None) -> DataFrame:
    scores = [quality_parts(m)["score"] for m in column_measures(df, target)]
    total = sum(scores) / len(scores) if scores else 100.0
    row = (half_up(total, 1), grade(total), len(scores), sum(s >= 80 for s in scores), sum(50 <= s < 80 for s in scores), sum(s < 50 for s in scores))
    return report(df, [row], "overall_score double, overall_grade string, n_columns int, high int, medium int, low int")


def sufficiency(df: DataFrame, target: str | None = None, problem: str = "classification") -> DataFrame:
    """Is the table large enough: one row per check plus the verdict."""
    miss = null_counts(df, df.columns)
    n, width = miss["*"], len(df.columns)
    features = width - 1 if target else width
    checks: list[tuple] = []

    def add(name, value, good, fair):
        checks.append((name, half_up(value, 2), "pass" if good else "warning" if fair else "fail"))

    ratio = n / max(features, 1)
    add("rows_per_feature", ratio, ratio >= 20, ratio >= 10)
    if problem == "classification" and target:
        c = (df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias("n"))
             .agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.floor(F.avg("n")).alias("mean")).first())
        lo, hi, mean = c["lo"] or 0, c["hi"] or 0, c["mean"] or 0
        add("min_class", lo, lo >= 50, lo >= 20)
        add("mean_class", mean, mean >= 100, mean >= 30)
        balance = half_up(hi / max(lo, 1), 1)
        add("class_balance", balance, balance <= 2, balance <= 5)
    if problem == "regression" and target:
        add("regression_size", n, n >= max(50, features * 10), False)
    gaps = half_up(100.0 * sum(miss[c] for c in df.columns) / max(1, n * width), 2)
    add("missing_pct", gaps, gaps <= 5, gaps <= 20)
    nums = len(numeric_columns(df, [target] if target else []))
    add("feature_diversity", features, nums >= 3 and features >= 5, features >= 2)
    dup = half_up(100.0 * duplicate_rows(df) / max(1, n), 2)
    add("duplicate_pct", dup, dup <= 1, dup <= 10)
    states = [c[2] for c in checks]
    fails, warns = states.count("fail"), states.count("warning")
    verdict = "insufficient" if fails >= 2 else "marginal" if fails == 1 or warns >= 2 else "sufficient"
    checks.append(("verdict", float(fails), verdict))
    return report(df, checks, "check string, value double, status string")


def reframings(df: DataFrame, target: str, problem: str) -> DataFrame:
    """Other ways to pose the problem, as rows (hint, column, value)."""
    kind, out = kind_of(df, target), []
    uniq = distinct_counts(df, [target])[target]
    for c in df.columns:
        if c != target and (kind_of(df, c) == "datetime" or any(w in c.lower() for w in ("date", "time", "timestamp"))):
            out.append(("temporal", c, 0.0))
    if kind == "numeric" and problem == "classification" and 3 <= uniq <= 10:
        out.append(("ordinal", target, float(uniq)))
    if kind == "numeric" and problem == "regression":
        if uniq <= 10:
            out.append(("few_values", target, float(uniq)))
        skew = measure(df, g=bias_corrected_skew(number(target)))["g"] or 0.0
        if abs(skew) > 2:
            q = quantiles(df, [target], [0.33, 0.66])[target]
            out += [("bin_low_edge", target, half_up(q[0])), ("bin_high_edge", target, half_up(q[1]))]
        others = numeric_columns(df, [target])
        if others:
            row = measure(df, **{f"r{i}": correlation(number(target), number(c)) for i, c in enumerate(others)})
            best = max((abs(v) for v in row.asDict().values() if v is not None and v == v), default=0.0)
            if best < 0.1:
                out.append(("weak_signal", target, half_up(best)))
    if problem == "classification" and uniq:
        low = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias("n")).agg(F.min("n"), F.sum("n")).first()
        if low[0] / low[1] < 0.05:
            out.append(("rare_class", target, half_up(low[0] / low[1])))
    if kind == "text":
        rate = measure(df, r=share(col(target).rlike(r"[,;|]")))["r"] or 0.0
        if rate > 0.3:
            out.append(("multi_label", target, half_up(rate)))
    return report(df, out, "hint string, column string, value double")
