"""User-written features: expressions, preview, suggestions, crossings and powers."""

from __future__ import annotations

import re
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import bias_corrected_skew, half_up
from tablewise.operators.information import mutual_information
from tablewise.operators.measures import col, correlation, date_columns, distinct_counts, histogram, measure, number, numeric_columns, report

# Names usable in an expression and the Spark function each means.
FUNCTIONS = {
    "log": "log1p", "sqrt": "sqrt", "abs": "abs", "square": "_square", "exp": "exp", "round": "bround",
    "day_of_week": "weekday", "month": "month", "year": "year", "hour": "hour",
}
FORBIDDEN = re.compile(r"\b(import|exec|eval|open|select|from|where|reflect|java_method|__\w+)\b|;", re.I)


def spark_expression(text: str) -> str:
    """A feature expression as a Spark SQL expression: function names mapped, ``**`` and ``/`` made safe."""
    if FORBIDDEN.search(text):
        raise ValueError("expression uses a forbidden word")

    def named(m: re.Match) -> str:
        name = FUNCTIONS.get(m.group(1).lower())
        if name is None:
            raise ValueError(f"unknown function {m.group(1)}")
        return f"{name}("

    out = re.sub(r"([A-Za-z_]\w*)\s*\(", named, text)
    out = re.sub(r"_square\(([^()]*)\)", r"power(\1, 2)", out)
    out = re.sub(r"([\w.]+|\([^()]*\))\s*\*\*\s*([\w.]+|\([^()]*\))", r"power(\1, \2)", out)
    return out


def check_expression(df: DataFrame, text: str) -> str | None:
    """The reason an expression cannot be used, or None; tried on 5 rows."""
    try:
        df.limit(5).select(F.expr(spark_expression(text))).collect()
    except Exception as e:  # noqa: BLE001 - the message is the result
        return str(e).splitlines()[0]
    return None


def add_feature(df: DataFrame, name: str, text: str) -> DataFrame:
    return df.withColumn(name, F.expr(spark_expression(text)))


def preview(df: DataFrame, text: str, target: str | None = None, bins: int = 20) -> tuple[DataFrame, DataFrame]:
    """Moments, gaps, distinct values and correlation label of a feature, and its histogram."""
    data = df.select(F.expr(spark_expression(text)).cast("double").alias("feature"), *([number(target).alias("target")] if target else []))
    x = F.col("feature")
    row = measure(data, n=F.count("*"), k=F.count(x), a=F.avg(x), s=F.stddev_samp(x), lo=F.min(x), hi=F.max(x),
                  r=correlation(x, F.col("target")) if target else F.max(F.lit(None).cast("double")))
    uniq = distinct_counts(data, ["feature"])["feature"]
    r = row["r"]
    label = None if r is None else "strong" if abs(r) > 0.3 else "moderate" if abs(r) > 0.1 else "weak"
    stats = report(df, [(row["n"] - row["k"], uniq, half_up(row["a"]), half_up(row["s"]), half_up(row["lo"]), half_up(row["hi"]), half_up(r), label)],
                   "missing long, distinct long, mean double, std double, min double, max double, correlation double, signal string")
    return stats, histogram(data, {"feature": (row["lo"], row["hi"], bins)})


def suggest(df: DataFrame, target: str | None = None, ratios: int | None = None) -> DataFrame:
    """Suggested features: log where skewed, ratios without a zero divisor (the first ``ratios``, if given), date parts."""
    nums = numeric_columns(df, [target] if target else [])
    exprs = {}
    for i, c in enumerate(nums):
        exprs |= {f"lo{i}": F.min(number(c)), f"g{i}": bias_corrected_skew(number(c)), f"z{i}": F.count_if(number(c) == 0)}
    row = measure(df, **exprs) if exprs else {}
    out = [("log", f"{c}_log", f"log({c})") for i, c in enumerate(nums) if row[f"lo{i}"] is not None and row[f"lo{i}"] >= 0 and (row[f"g{i}"] or 0) > 1]
    out += [("ratio", f"{a}_per_{b}", f"{a} / {b}") for a, b in combinations(nums, 2) if row[f"z{nums.index(b)}"] == 0][:ratios]
    for c in date_columns(df):
        out += [("date", f"{c}_{p}", f"{p}({c})") for p in ("month", "day_of_week")]
    return report(df, out, "kind string, name string, expression string")


def crossings(df: DataFrame, target: str, keep: int = 10, widest: int | None = None) -> DataFrame:
    """The ``keep`` best products of pairs of columns (of the ``widest`` by variance, if given) by mutual information with the target."""
    nums = numeric_columns(df, [target])
    row = measure(df, **{f"v{i}": F.var_samp(number(c)) for i, c in enumerate(nums)})
    top = sorted(nums, key=lambda c: -(row[f"v{nums.index(c)}"] or 0.0))[:widest]
    made = {f"{a}_x_{b}": number(a) * number(b) for a, b in combinations(top, 2)}
    return _best(mutual_information(df, target, made), keep)


def powers(df: DataFrame, target: str, degree: int = 2, keep: int = 10, columns: Sequence[str] | None = None) -> DataFrame:
    """The ``keep`` best powers 2..degree of the columns by mutual information with the target."""
    nums = list(columns or numeric_columns(df, [target]))
    made = {f"{c}_pow{d}": F.power(number(c), F.lit(d)) for c in nums for d in range(2, degree + 1)}
    return _best(mutual_information(df, target, made), keep)


def _best(scores: DataFrame, keep: int) -> DataFrame:
    return scores.select("feature", F.round("mi", 4).alias("mi")).orderBy(F.desc("mi"), "feature").limit(keep)
