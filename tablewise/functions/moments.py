"""Aggregate expressions whose definition differs between Spark and the data-frame world."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = Context(prec=60)


def bias_corrected_skew(c: Column) -> Column:
    """Sample skewness G1; null below three values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g1 = F.coalesce(F.nanvl(F.skewness(c), F.lit(None)), F.lit(0.0))
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def bias_corrected_kurtosis(c: Column) -> Column:
    """Sample excess kurtosis G2; null below four values, 0 for a constant column."""
    n = F.count(c).cast("double")
    g2 = F.nanvl(F.kurtosis(c), F.lit(None))
    return F.when(n >= 4, F.coalesce(((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)), F.lit(0.0)))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds (null counts as no)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def rounded(c: Column, places: int = 4) -> Column:
    """Round, with no negative zero."""
    return F.round(c, places) + F.lit(0.0)


def half_up(v, places: int = 4) -> float | None:
    """Driver-side rounding of a measure, ties away from zero on the printed value, no negative zero."""
    if v is None or v != v:
        return None
    v = float(v)
    if v in (float("inf"), float("-inf")):
        return v
    return float(Decimal(repr(v)).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP, context=WIDE)) + 0.0
