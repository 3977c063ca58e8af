"""Automatic features: dates, logs, products, ratios, cycles, frequencies, bins, text lengths."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions.moments import bias_corrected_skew
from tablewise.operators.coercion import date_value, text_shares
from tablewise.operators.information import binned_edges
from tablewise.operators.measures import bins_right_closed, col, date_columns, distinct_counts, measure, number, numeric_columns, report, text_columns


def date_like(df: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    """Typed date columns, and text columns where at least 80% of the values parse."""
    shares = text_shares(df, d=lambda c: date_value(c).isNotNull())
    return [c for c in df.columns if c not in skip and (c in date_columns(df) or shares.get(c, {"d": 0})["d"] >= 0.8)]


def date_parts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Year, month, day, weekday (Monday 0), quarter, weekend and, if any time part, hour; the source goes."""
    columns = list(columns if columns is not None else date_like(df))
    texts = text_columns(df)
    value = {c: date_value(col(c)) if c in texts else col(c) for c in columns}
    timed = [c for c in columns if not isinstance(df.schema[c].dataType, T.DateType)]
    row = measure(df, **{f"t{i}": F.max((F.hour(value[c]) != 0) | (F.minute(value[c]) != 0)) for i, c in enumerate(timed)}) if timed else {}
    made: dict[str, Column] = {}
    for c in columns:
        d = value[c]
        made |= {f"{c}_year": F.year(d), f"{c}_month": F.month(d), f"{c}_day": F.dayofmonth(d), f"{c}_day_of_week": F.weekday(d), f"{c}_quarter": F.quarter(d)}
        if c in timed and row[f"t{timed.index(c)}"]:
            made[f"{c}_hour"] = F.hour(d)
        made[f"{c}_is_weekend"] = F.weekday(d).isin(5, 6).cast("int")
    return df.withColumns(made).drop(*columns) if made else df


def log_skewed(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``_log`` of the non-negative columns with skewness over 2."""
    columns = list(columns or numeric_columns(df))
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("lo", F.min), ("g", bias_corrected_skew))})
    hits = [c for i, c in enumerate(columns) if row[f"lo{i}"] is not None and row[f"lo{i}"] >= 0 and (row[f"g{i}"] or 0) > 2]
    return df.withColumns({f"{c}_log": F.log1p(number(c)) for c in hits}) if hits else df


def products(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None, pairs: int | None = None) -> DataFrame:
    """Products of pairs of columns, by falling std / mean: of the ``top`` columns only, and the first ``pairs`` only, if given."""
    columns = list(columns or numeric_columns(df))
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("s", F.stddev_samp), ("a", F.avg))})
    score = {c: abs(row[f"s{i}"] / row[f"a{i}"]) for i, c in enumerate(columns) if row[f"a{i}"] and row[f"s{i}"] is not None}
    best = sorted(score, key=lambda c: -score[c])[:top]
    return df.withColumns({f"{a}_x_{b}": number(a) * number(b) for a, b in list(combinations(best, 2))[:pairs]}) if len(best) > 1 else df


def ratios(df: DataFrame, columns: Sequence[str] | None = None, top: int | None = None, pairs: int | None = None) -> DataFrame:
    """a / (b + 1e-8) for pairs of columns, by falling variance: of the ``top`` columns only, and the first ``pairs`` only, if given."""
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return df
    row = measure(df, **{f"v{i}": F.var_samp(number(c)) for i, c in enumerate(columns)})
    var = {c: row[f"v{i}"] for i, c in enumerate(columns) if row[f"v{i}"] is not None}
    best = sorted(var, key=lambda c: -var[c])[:top]
    return df.withColumns({f"{a}_div_{b}": F.try_divide(number(a), number(b) + 1e-8) for a, b in list(combinations(best, 2))[:pairs]})


# Column name endings and their periods.
PERIODS = {"_month": 12, "_day_of_week": 7, "_hour": 24, "_day": 31}


def cycles(df: DataFrame) -> DataFrame:
    made = {}
    for c in df.columns:
        period = next((p for end, p in PERIODS.items() if c.endswith(end)), None)
        if period:
            angle = number(c) * (2 * math.pi / period)
            made |= {f"{c}_sin": F.sin(angle), f"{c}_cos": F.cos(angle)}
    return df.withColumns(made) if made else df


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join to a table with one row per key; a large table is joined by shuffle with AQE splitting hot keys."""
    return df.join(table, list(on), "left")


def frequency_encode(df: DataFrame, columns: Sequence[str] | None = None, replace: bool = False) -> DataFrame:
    """Share of each value of the text columns with more than 5 values; null is 0."""
    if columns is None:
        uniq = distinct_counts(df, text_columns(df))
        columns = [c for c in uniq if uniq[c] > 5]
    n, order = df.count(), df.columns
    for c in columns:
        f = df.where(col(c).isNotNull()).groupBy(col(c)).agg((F.count("*") / n).alias(f"{c}_freq"))
        df = lookup(df, f, [c]).fillna(0.0, [f"{c}_freq"])
    df = df.select(*[col(c) for c in order], *[col(f"{c}_freq") for c in columns])
    return df.withColumns({c: col(f"{c}_freq") for c in columns}).drop(*[f"{c}_freq" for c in columns]) if replace else df


def quantile_bins(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 5, min_distinct: int = 50) -> DataFrame:
    """``_binned``: right-closed exact quantile bins of the numeric columns with enough values."""
    columns = list(columns or numeric_columns(df))
    uniq = distinct_counts(df, columns)
    columns = [c for c in columns if uniq[c] > min_distinct]
    edges = binned_edges(df, {c: number(c) for c in columns}, bins)
    return df.withColumns({f"{c}_binned": bins_right_closed(number(c), edges[c]).cast("int") for c in columns}) if columns else df


def word_count(c: Column) -> Column:
    t = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.when(c.isNull() | (t == ""), 0).otherwise(F.size(F.split(t, r"\s+")))


def text_lengths(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``_word_count`` and ``_char_count`` of the text columns with mean length over 20; a null counts 0."""
    if columns is None:
        texts = text_columns(df)
        row = measure(df, **{f"l{i}": F.avg(F.length(col(c))) for i, c in enumerate(texts)}) if texts else {}
        columns = [c for i, c in enumerate(texts) if (row[f"l{i}"] or 0) > 20]
    made: dict[str, Column] = {}
    for c in columns:
        made |= {f"{c}_word_count": word_count(col(c)).cast("int"), f"{c}_char_count": F.coalesce(F.length(col(c)), F.lit(0))}
    return df.withColumns(made) if made else df


def engineer(df: DataFrame, target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All steps in a fixed order, each on the original numeric and text columns, with the features made."""
    nums, texts = numeric_columns(df, [target] if target else []), text_columns(df)
    dates = date_like(df, [target] if target else [])
    steps = [
        ("dates", lambda d: date_parts(d, dates)), ("cycles", cycles), ("logs", lambda d: log_skewed(d, nums)),
        ("products", lambda d: products(d, nums, top=5, pairs=3)), ("ratios", lambda d: ratios(d, nums, top=5, pairs=10)),
        ("frequencies", lambda d: frequency_encode(d, [c for c, u in distinct_counts(d, [t for t in texts if t not in dates and t != target]).items() if u > 5])),
        ("bins", lambda d: quantile_bins(d, nums)), ("lengths", lambda d: text_lengths(d)),
    ]
    out, rows = df, []
    for name, step in steps:
        before = set(out.columns)
        out = step(out)
        rows += [(name, c) for c in out.columns if c not in before]
    return out, report(df, rows, "step string, feature string")
