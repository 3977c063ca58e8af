"""Rules learned from a table and checked on another."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up
from tablewise.operators.measures import col, distinct_counts, frequencies, measure, melt, number, numeric_columns, report, text_columns

RULES = "type string, column string, low double, high double, values array<string>, condition_column string, condition_value string"


def learn(df: DataFrame, max_conditional: int | None = None) -> list[dict]:
    """All rules: not null, range, whole number, non-negative, allowed values, unique, conditional not null."""
    nums, texts = numeric_columns(df), text_columns(df)
    exprs = {"n": F.count("*")} | {f"m{i}": F.count_if(col(c).isNull()) for i, c in enumerate(df.columns)}
    for i, c in enumerate(nums):
        exprs |= {f"lo{i}": F.min(number(c)), f"hi{i}": F.max(number(c)), f"w{i}": F.min(number(c) == F.floor(number(c)))}
    row, uniq = measure(df, **exprs), distinct_counts(df, df.columns)
    n = row["n"]
    few = [c for c in texts if 0 < uniq[c] <= 50]
    values: dict[str, list[str]] = {c: [] for c in few}
    for r in frequencies(df, few).collect() if few else []:  # at most 50 values per column
        values[r["column"]].append(r["value"])
    rules = []
    for i, c in enumerate(df.columns):
        missing = row[f"m{i}"]
        if missing == n:
            continue
        if missing == 0:
            rules.append(dict(type="not_null", column=c))
        if c in nums:
            j = nums.index(c)
            rules.append(dict(type="range", column=c, low=row[f"lo{j}"], high=row[f"hi{j}"]))
            if row[f"w{j}"]:
                rules.append(dict(type="integer_only", column=c))
            if row[f"lo{j}"] >= 0:
                rules.append(dict(type="non_negative", column=c))
        elif c in few:
            rules.append(dict(type="allowed_values", column=c, values=sorted(values[c])))
        if missing == 0 and uniq[c] == n:
            rules.append(dict(type="unique", column=c))
    gaps = [c for i, c in enumerate(df.columns) if 0 < row[f"m{i}"] < n]
    return rules + conditional(df, gaps, texts, max_conditional)


def conditional(df: DataFrame, gaps: list[str], texts: list[str], limit: int | None = None) -> list[dict]:
    """``column`` is never null when ``condition_column`` has a value seen at least 10 times.

    The 5 most frequent values of each text column are tried.
    """
    if not gaps or not texts:
        return []
    flags = df.select(*[col(t) for t in texts], *[col(g).isNull().cast("int").alias(f"_g{i}") for i, g in enumerate(gaps)])
    counts = melt(flags, texts, "string", [f"_g{i}" for i in range(len(gaps))]).where("value is not null").groupBy("column", "value").agg(
        F.count("*").alias("n"), *[F.sum(f"_g{i}").alias(f"k{i}") for i in range(len(gaps))])
    from tablewise.operators.measures import top_values

    top = top_values(counts, 5).collect()  # 5 values per text column
    out = []
    for i, g in enumerate(gaps):
        for t in texts:
            for r in sorted((r for r in top if r["column"] == t), key=lambda r: r["rank"]):
                if t != g and r["n"] >= 10 and r[f"k{i}"] == 0:
                    out.append(dict(type="conditional_not_null", column=g, condition_column=t, condition_value=r["value"]))
    return out[:limit]


def rules_frame(df: DataFrame, rules: Iterable[dict]) -> DataFrame:
    keys = ["type", "column", "low", "high", "values", "condition_column", "condition_value"]
    return report(df, [tuple(r.get(k) for k in keys) for r in rules], RULES)


def violations(df: DataFrame, rules: Iterable[dict], key: str) -> DataFrame:
    """One row per broken rule (key, column, rule, value, severity); all row rules in one projection."""
    rules = [r for r in rules if r["column"] in df.columns]
    cells = []

    def add(rule, column, broken, severity):
        cells.append(F.when(broken, F.struct(
            F.lit(column).alias("column"), F.lit(rule).alias("rule"), col(column).cast("string").alias("value"), severity.alias("severity"))))

    for r in rules:
        c, x = r["column"], number(r["column"]) if r["column"] in numeric_columns(df) else col(r["column"])
        if r["type"] == "not_null":
            add("not_null", c, x.isNull(), F.lit("high"))
        elif r["type"] == "range":
            far = (x < 0.5 * r["low"]) | (x > 2 * r["high"])
            add("range", c, (x < r["low"]) | (x > r["high"]), F.when(far, "high").otherwise("medium"))
        elif r["type"] == "integer_only":
            add("integer_only", c, x != F.floor(x), F.lit("low"))
        elif r["type"] == "non_negative":
            add("non_negative", c, x < 0, F.lit("high"))
        elif r["type"] == "allowed_values":
            add("allowed_values", c, ~col(c).cast("string").isin(r["values"]), F.lit("medium"))
        elif r["type"] == "conditional_not_null":
            add(f"not_null_when_{r['condition_column']}={r['condition_value']}", c,
                x.isNull() & (col(r["condition_column"]).cast("string") == r["condition_value"]), F.lit("medium"))
    shape = "array<struct<column:string,rule:string,value:string,severity:string>>"
    found = df.select(col(key).alias("key"), F.explode(F.array_compact(F.array(*cells).cast(shape))).alias("v")).select("key", "v.*")
    for r in rules:
        if r["type"] == "unique":
            c = r["column"]
            repeated = df.where(col(c).isNotNull()).groupBy(col(c).alias("_v")).agg(F.count("*").alias("_n")).where("_n > 1").select("_v")
            found = found.union(df.join(repeated, col(c) == F.col("_v")).select(
                col(key).alias("key"), F.lit(c).alias("column"), F.lit("unique").alias("rule"), col(c).cast("string").alias("value"), F.lit("high").alias("severity")))
    return found


def violation_summary(found: DataFrame, n_rows: int) -> DataFrame:
    """Violations and rows hit per column, and the share of rows hit over the whole table."""
    hit = found.select("key").distinct().count()
    return found.groupBy("column").agg(F.count("*").alias("violations"), F.count_distinct("key").alias("rows")).select(
        "*", F.lit(half_up(100.0 * hit / max(1, n_rows), 2)).alias("violation_rate"))
