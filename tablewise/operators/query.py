"""Projection, filter, aggregate, sort and limit over one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up as r
from tablewise.functions.moments import rounded
from tablewise.operators.measures import col, measure, numeric_columns, quantiles, report, text_columns


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Rows where a SQL boolean expression holds."""
    return df.where(F.expr(expression))


def resolve_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Match names without case, then as substrings; none found (or ``*``) means all."""
    if list(names) == ["*"]:
        return df.columns
    lower = {c.lower(): c for c in reversed(df.columns)}
    out: list[str] = []
    for n in names:
        hit = lower.get(n.strip().lower()) or next(
            (c for c in df.columns if n.strip().lower() in c.lower() or c.lower() in n.strip().lower()), None
        )
        if hit and hit not in out:
            out.append(hit)
    return out or df.columns


def select_columns(df: DataFrame, names: Sequence[str], where: str | None = None) -> DataFrame:
    """Projection of the named columns, optionally filtered."""
    if where:
        df = df.where(F.expr(where))
    return df.select(*[col(c) for c in resolve_columns(df, names)])


def comparison(column: str, op: str, literal: str) -> Column:
    """One comparison; the literal is a number when it reads as one, else text."""
    c = col(column)
    try:
        value = F.lit(float(literal))
    except ValueError:
        value = F.lit(literal.strip("'\""))
    return {
        ">": c > value, "<": c < value, ">=": c >= value, "<=": c <= value,
        "==": c == value, "=": c == value, "!=": ~c.eqNullSafe(value),
    }[op]


def compare_rows(df: DataFrame, column: str, op: str, literal: str) -> DataFrame:
    return df.where(comparison(column, op, literal))


def top_rows(df: DataFrame, column: str, key: str, n: int = 10) -> DataFrame:
    """The n rows with the largest values; a text or unknown column gives the first n by key."""
    if column not in numeric_columns(df):
        return df.orderBy(key).limit(n)
    return df.where(col(column).isNotNull()).orderBy(F.desc(column), key).limit(n)


def count_matching(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.count_if(condition).alias("matching"), F.count("*").alias("total")).select(
        "matching", "total", rounded(100.0 * F.col("matching") / F.greatest("total", F.lit(1)), 2).alias("percent")
    )


def value_counts(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return (
        df.where(col(column).isNotNull())
        .groupBy(col(column).alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(n)
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"))


def group_by(df: DataFrame, key: str, function: str = "mean", columns: Sequence[str] | None = None) -> DataFrame:
    """One aggregate of every numeric column per group; the null group is dropped."""
    fn = {"mean": F.avg, "sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[function]
    columns = list(columns) if columns else numeric_columns(df, [key])
    grouped = df.where(col(key).isNotNull()).groupBy(col(key))
    if not columns:
        return grouped.agg(F.count("*").alias("n"))
    return grouped.agg(
        *[(rounded(fn(col(c))) if function in ("mean", "sum") else fn(col(c))).alias(c) for c in columns]
    )


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max per numeric column."""
    columns = list(columns) if columns else numeric_columns(df)
    row = measure(
        df,
        **{f"{m}{i}": f(col(c)) for i, c in enumerate(columns)
           for m, f in (("n", F.count), ("a", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))},
    )
    q = quantiles(df, columns, [0.25, 0.5, 0.75])

    rows = [
        (c, row[f"n{i}"], r(row[f"a{i}"]), r(row[f"s{i}"]), r(row[f"lo{i}"]), *map(r, q[c]), r(row[f"hi{i}"]))
        for i, c in enumerate(columns)
    ]
    return report(df, rows, "column string, count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, most frequent value and its count per text column."""
    from tablewise.operators.measures import frequencies

    columns = list(columns) if columns else text_columns(df)
    f = frequencies(df, columns)
    return f.groupBy("column").agg(
        F.sum("n").alias("count"), F.count("*").alias("unique"),
        F.min(F.struct((-F.col("n")).alias("neg"), "value")).alias("b"),
    ).select("column", "count", "unique", F.col("b.value").alias("top"), (-F.col("b.neg")).alias("freq"))


def scalar(df: DataFrame, column: str, function: str) -> DataFrame:
    """Mean, sum, max, min or exact median of one column."""
    if function == "median":
        return report(df, [(r(quantiles(df, [column], [0.5])[column][0]),)], "value double")
    fn = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[function]
    return df.agg(rounded(fn(col(column)).cast("double")).alias("value"))


def cut_result(df: DataFrame, limit: int = 200, with_total: bool = False) -> tuple[DataFrame, bool, int | None]:
    """At most ``limit`` rows, whether more exist, and on request the full count."""
    more = len(df.select(F.lit(1)).limit(limit + 1).take(limit + 1)) > limit
    return df.limit(limit), more, df.count() if with_total else None
