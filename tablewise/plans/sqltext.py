"""Small builders for oracle statements."""

from __future__ import annotations


def rnd(x: str, places: int = 4) -> str:
    return f"(round(CAST({x} AS DOUBLE), {places}) + 0.0)"


def union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def long_form(table: str, columns, kind: str = "DOUBLE", keep: str = "") -> str:
    """(keep, column, value) rows of several columns."""
    k = keep + ", " if keep else ""
    return union(f"SELECT {k}'{c}' AS \"column\", CAST({c} AS {kind}) AS value FROM {table}" for c in columns)


def skew(x: str) -> str:
    return f"skewness({x})"


def quant(x: str, p: float) -> str:
    return f"quantile_cont(CAST({x} AS DOUBLE), {p})"
