"""Time series: detection, calendar features, lags, rolling windows, seasonal split, holdout."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as fixed
from tablewise.functions.moments import half_up
from tablewise.operators.coercion import drop_constants
from tablewise.operators.features import date_like
from tablewise.operators.measures import (
    col, measure, number, numeric_columns, order_number, over_rows, positions, quantiles, report,
)


def detect(df: DataFrame, statement: str = "") -> DataFrame:
    """Is this a time series: its date column, frequency, trend and range."""
    dates = date_like(df)
    if not dates:
        hinted = any(w in statement.lower() for w in fixed.SERIES_WORDS)
        return report(df, [(hinted, None, None, None, None)], "is_timeseries boolean, date_column string, frequency string, trend string, range_days long")
    c = dates[0]
    days = measure(df, d=F.datediff(F.max(col(c)), F.min(col(c))))["d"]
    freq = frequency(df, c).first()["frequency"]
    nums = numeric_columns(df)
    direction = trend(df, c, nums[-1]).first()["trend"] if nums else "unknown"
    return report(df, [(True, c, freq, direction, days)], "is_timeseries boolean, date_column string, frequency string, trend string, range_days long")


def frequency_label(seconds: float | None) -> str:
    if seconds is None:
        return "unknown"
    days = int(seconds // 86400)
    if seconds < 3600:
        return "minutely"
    if seconds < 86400:
        return "hourly"
    if days <= 1:
        return "daily"
    for low, high, name in ((5, 9, "weekly"), (25, 35, "monthly"), (85, 95, "quarterly"), (350, 380, "yearly")):
        if low <= days <= high:
            return name
    return f"{days}-day intervals"


def frequency(df: DataFrame, date: str, by: Sequence[str] = ()) -> DataFrame:
    """Median gap between the distinct times of a series, and its name."""
    seconds = (order_number(df, date) * (86400.0 if dict(df.dtypes)[date] == "date" else 1e-6)).alias("t")
    times = df.where(col(date).isNotNull()).select(*by, seconds).distinct()
    gaps = over_rows(times, list(by), "t", lambda w: {"gap": F.col("t") - F.lag("t", 1).over(w)}, back=1)
    gap = quantiles(gaps, {"gap": F.col("gap")}, [0.5])["gap"][0]
    return report(df, [(half_up(gap, 2), frequency_label(gap))], "median_gap_seconds double, frequency string")


def trend(df: DataFrame, date: str, value: str, by: Sequence[str] = (), tie: str | None = None) -> DataFrame:
    """Mean of the first quarter of the rows against the last quarter, +-10%."""
    data = positions(df.select(*by, number(value).alias("v"), order_number(df, date).alias("t"), *([col(tie)] if tie else [])), list(by), "t", "pos", tie)
    n = data.groupBy(*by).agg(F.count("*").alias("n"))
    placed = data.join(n, list(by)) if by else data.withColumn("n", F.lit(n.first()["n"]))
    means = placed.groupBy(*by).agg(
        F.avg(F.when(F.col("pos") < F.floor(F.col("n") / 4), F.col("v"))).alias("first"),
        F.avg(F.when(F.col("pos") >= F.col("n") - F.ceil(F.col("n") / 4), F.col("v"))).alias("last"), F.max("n").alias("n"))
    change = (F.col("last") - F.col("first")) / F.greatest(F.abs("first"), F.lit(1e-10))
    label = F.when(F.col("n") < 10, "unknown").when(change > 0.1, "upward").when(change < -0.1, "downward").otherwise("stable")
    return means.select(*by, F.col("first").alias("first_mean"), F.col("last").alias("last_mean"), label.alias("trend"))


def calendar(df: DataFrame, date: str) -> DataFrame:
    """Calendar and cyclical features of a date; the constant ones are dropped."""
    d = col(date)
    made = {
        "_year": F.year(d), "_month": F.month(d), "_day": F.dayofmonth(d), "_dayofweek": F.weekday(d), "_dayofyear": F.dayofyear(d),
        "_quarter": F.quarter(d), "_weekofyear": F.weekofyear(d), "_hour": F.hour(d.cast("timestamp")),
        "_month_sin": F.sin(F.month(d) * (2 * math.pi / 12)), "_month_cos": F.cos(F.month(d) * (2 * math.pi / 12)),
        "_dow_sin": F.sin(F.weekday(d) * (2 * math.pi / 7)), "_dow_cos": F.cos(F.weekday(d) * (2 * math.pi / 7)),
        "_is_weekend": (F.weekday(d) >= 5).cast("int"),
    }
    full = df.withColumns(made)
    kept = drop_constants(full.select(*made))[0].columns
    return full.drop(*[c for c in made if c not in kept])


def usable(df: DataFrame, by: Sequence[str], lags: Sequence[int], windows: Sequence[int]) -> tuple[list[int], list[int], int]:
    """Lags up to a quarter and windows up to a third of the longest series."""
    n = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return [k for k in lags if 0 < k <= min(max(lags), n // 4)], [w for w in windows if 1 < w <= min(max(windows), n // 3)], n


def lag_columns(target: str, lags: Sequence[int]):
    return lambda w: {f"{target}_lag_{k}": F.lag(col(target), k).over(w) for k in lags}


def rolling_columns(target: str, windows: Sequence[int], names: dict[str, str] | None = None):
    """Mean, std, min and max of the previous k rows; null until there are k of them."""
    names = names or {"rolling_mean": "avg", "rolling_std": "std", "rolling_min": "min", "rolling_max": "max"}
    fns = {"avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}

    def make(w):
        out = {}
        for k in windows:
            frame = w.rowsBetween(-k, -1)
            full = F.count(col(target)).over(frame) == k
            out |= {f"{target}_{label}_{k}": F.when(full, fns[f](col(target)).over(frame)) for label, f in names.items()}
        return out

    return make


def diff_columns(target: str, steps: Sequence[int] = (1, 7)):
    return lambda w: {f"{target}_diff_{k}": col(target) - F.lag(col(target), k).over(w) for k in steps}


def lag_features(df: DataFrame, by: Sequence[str], date: str, target: str, lags: Sequence[int] = (1, 2, 3, 7, 14, 30),
                 windows: Sequence[int] = (3, 7, 14, 30), drop_gaps: bool = True) -> DataFrame:
    """Lags, rolling statistics and differences in one pass over each series; rows with gaps are dropped."""
    lags, windows, n = usable(df, by, lags, windows)
    steps = [1] + ([7] if n > 7 else [])
    out = over_rows(df, list(by), date, lambda w: lag_columns(target, lags)(w) | rolling_columns(target, windows)(w) | diff_columns(target, steps)(w),
                    back=max([*lags, *windows, *steps]))
    return out.dropna("any") if drop_gaps else out


def auto_lags(df: DataFrame, by: Sequence[str], date: str, target: str, max_lags: int = 10) -> tuple[DataFrame, DataFrame]:
    """Lags 1..n with rolling means and stds, and a report of the rows lost."""
    n = df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    windows = [w for w in (3, 7, 14) if w < n // 3]
    lags = list(range(1, max_lags + 1))
    make = rolling_columns(target, windows, {"roll_mean": "avg", "roll_std": "std"})
    out = over_rows(df, list(by), date, lambda w: lag_columns(target, lags)(w) | make(w), back=max(lags + windows)).dropna("any")
    lost = df.count() - out.count()
    return out, report(df, [(len(lags) + 2 * len(windows), lost)], "features int, rows_lost long")


def seasonal_split(df: DataFrame, by: Sequence[str], date: str, target: str, period: int) -> DataFrame:
    """Additive trend, seasonal index and residual.

    The trend is a centred moving average (half weights at both ends for an even period),
    the seasonal index the mean detrended value per phase, centred to zero per series.
    """
    half = period // 2

    def make(w):
        y = number(target)
        if period % 2:
            frame = w.rowsBetween(-half, half)
            mean = F.sum(y).over(frame) / period
        else:
            frame = w.rowsBetween(-half, half)
            mean = (F.sum(y).over(frame) - 0.5 * F.lag(y, half).over(w) - 0.5 * F.lead(y, half).over(w)) / period
        return {"trend": F.when(F.count(y).over(frame) == 2 * half + 1, mean)}

    data = positions(df.withColumn("_t", order_number(df, date)), list(by), "_t", "_pos").drop("_t")
    data = over_rows(data, list(by), "_pos", make, back=half, ahead=half).withColumn("_phase", F.col("_pos") % period)
    index = data.groupBy(*by, "_phase").agg(F.avg(number(target) - F.col("trend")).alias("_s"))
    centre = index.groupBy(*by).agg(F.avg("_s").alias("_m"))
    index = (index.join(centre, list(by)) if by else index.withColumn("_m", F.lit(centre.first()["_m"]))).select(
        *by, "_phase", (F.col("_s") - F.col("_m")).alias("seasonal"))
    return (
        data.join(index, [*by, "_phase"])
        .withColumn("residual", number(target) - F.col("trend") - F.col("seasonal"))
        .select(*df.columns, "trend", "seasonal", "residual")
    )


def holdout(df: DataFrame, by: Sequence[str], date: str, horizon: int) -> DataFrame:
    """Add ``split``: the last ``horizon`` rows of each series are the test part."""
    data = positions(df.withColumn("_t", order_number(df, date)), list(by), "_t", "_pos").drop("_t")
    n = df.groupBy(*by).agg(F.count("*").alias("_n"))
    data = data.join(n, list(by)) if by else data.withColumn("_n", F.lit(n.first()["_n"]))
    return data.withColumn("split", F.when(F.col("_pos") >= F.col("_n") - horizon, "test").otherwise("train")).drop("_pos", "_n")
