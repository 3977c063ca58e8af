"""Column and table profiles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import fixed_values as fixed
from tablewise.functions.moments import half_up as r4
from tablewise.functions.moments import share
from tablewise.operators.measures import (
    col, distinct_counts, frequencies, histogram, measure, melt, modes, null_counts, number,
    numeric_columns, quantiles, report, text_columns, top_values,
)


def kind_of(df: DataFrame, column: str) -> str:
    t = df.schema[column].dataType
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    return "boolean" if isinstance(t, T.BooleanType) else "text"


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: kind, missing, distinct, moments of numeric columns.

    One wide aggregate for counts and moments and one melted aggregate for the distinct counts.
    """
    columns = list(columns or df.columns)
    nums = [c for c in columns if kind_of(df, c) == "numeric"]
    exprs = {"n": F.count("*")} | {f"m{i}": F.count_if(col(c).isNull()) for i, c in enumerate(columns)}
    for i, c in enumerate(nums):
        exprs |= {f"a{i}": F.avg(number(c)), f"s{i}": F.stddev_samp(number(c)), f"lo{i}": F.min(number(c)), f"hi{i}": F.max(number(c))}
    row = measure(df, **exprs)
    uniq = distinct_counts(df, columns)
    n = max(1, row["n"])
    rows = []
    for i, c in enumerate(columns):
        stats = [None] * 4
        if c in nums:
            j = nums.index(c)
            stats = [r4(row[f"{k}{j}"]) for k in ("a", "s", "lo", "hi")]
        rows.append((c, kind_of(df, c), row[f"m{i}"], r4(100.0 * row[f"m{i}"] / n, 2), uniq[c], r4(100.0 * uniq[c] / n, 2), *stats))
    return report(df, rows, "column string, kind string, missing long, missing_pct double, distinct long, distinct_pct double, mean double, std double, min double, max double")


def top_value_profile(df: DataFrame, columns: Sequence[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values of each text column."""
    return top_values(frequencies(df, list(columns or text_columns(df))), k).select("column", "value", "n", "rank")


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first of each group of equal rows."""
    groups = df.groupBy(*[col(c) for c in df.columns]).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]


def table_totals(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and duplicate rows of the table."""
    miss = null_counts(df, df.columns)
    n, cells = miss["*"], sum(miss[c] for c in df.columns)
    dup = duplicate_rows(df)
    return report(
        df,
        [(n, len(df.columns), cells, r4(100.0 * cells / max(1, n * len(df.columns)), 2), dup, r4(100.0 * dup / max(1, n), 2))],
        "n_rows long, n_columns int, missing_cells long, missing_pct double, duplicate_rows long, duplicate_pct double",
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull()).groupBy(col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))


def detect_target(df: DataFrame, statement: str = "") -> str:
    """Column named in the statement, else by name pattern, else the last."""
    text = statement.lower()
    for c in df.columns:
        if len(c.strip()) > 1 and c.lower().strip() in text:
            return c
    for c in df.columns:
        if any(re.match(p, c.lower().strip()) for p in fixed.TARGET_NAME_PATTERNS):
            return c
    return df.columns[-1]


def detect_problem_type(df: DataFrame, target: str, statement: str = "") -> DataFrame:
    """classification, regression or multilabel, with the measures behind the answer."""
    text = statement.lower()
    row = measure(
        df, n=F.count("*"), lo=F.min(col(target).cast("string") if kind_of(df, target) != "numeric" else number(target)),
        hi=F.max(col(target).cast("string") if kind_of(df, target) != "numeric" else number(target)),
        delimited=F.avg(col(target).cast("string").rlike(r"[|,;]").cast("double")),
    )
    uniq = distinct_counts(df, [target])[target]
    kind, whole = kind_of(df, target), not isinstance(df.schema[target].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
    says = {k: sum(w in text for w in words) for k, words in
            (("classification", fixed.CLASSIFICATION_WORDS), ("regression", fixed.REGRESSION_WORDS))}
    if any(w in text for w in fixed.MULTILABEL_WORDS):
        answer = "multilabel"
    elif says["classification"] != says["regression"]:
        answer = max(says, key=says.get)
    elif kind == "text":
        answer = "multilabel" if (row["delimited"] or 0) > 0.3 else "classification"
    elif kind != "numeric" or uniq <= 2:
        answer = "classification"
    elif not whole:
        answer = "regression"
    elif uniq <= 20 and uniq / max(1, row["n"]) < 0.05:
        answer = "classification"
    elif uniq > 20 or row["hi"] - row["lo"] > 20:
        answer = "regression"
    else:
        answer = "classification"
    return report(df, [(target, answer, uniq, row["n"])], "target string, problem_type string, distinct long, n_rows long")


def text_shape(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Length, words, spaces and distinct share per text column, and whether it is natural text."""
    columns = list(columns or text_columns(df))
    exprs = {}
    for i, c in enumerate(columns):
        x = col(c)
        words = F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), r"\s+")))
        exprs |= {f"n{i}": F.count(x), f"l{i}": F.avg(F.length(x)), f"w{i}": F.avg(F.when(x.isNotNull(), words)),
                  f"s{i}": F.avg(x.rlike(r"\s").cast("double"))}
    row, uniq = measure(df, **exprs), distinct_counts(df, columns)
    rows = []
    for i, c in enumerate(columns):
        n, length, words, spaces = (row[f"{k}{i}"] or 0 for k in "nlws")
        ratio = uniq[c] / max(1, n)
        natural = (length > 20 and ratio > 0.3 and words > 3 and spaces > 0.5) or (length > 50 and words > 5)
        rows.append((c, r4(length), r4(words), r4(spaces), r4(ratio), bool(natural)))
    return report(df, rows, "column string, mean_length double, mean_words double, space_share double, distinct_ratio double, is_text boolean")


def semantic_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Semantic type, confidence and suggested encoding of every column, by fixed rules in order."""
    columns = list(columns or df.columns)
    exprs = {"n": F.count("*")}
    for i, c in enumerate(columns):
        t = F.trim(col(c).cast("string"))
        exprs |= {
            f"d{i}": share(t.rlike(fixed.DATE_TEXT)), f"c{i}": share(t.rlike(fixed.CURRENCY_TEXT)),
            f"p{i}": share(t.rlike(fixed.PERCENT_TEXT)), f"k{i}": F.count(col(c)),
            f"w{i}": F.avg(F.size(F.split(t, r"\s+"))),
        }
        if kind_of(df, c) == "numeric":
            exprs |= {f"lo{i}": F.min(number(c)), f"hi{i}": F.max(number(c)), f"o{i}": share(number(c) != F.floor(number(c)))}
    row, uniq = measure(df, **exprs), distinct_counts(df, columns)
    few = [c for c in columns if 0 < uniq[c] <= 10]
    values: dict[str, set] = {c: set() for c in few}
    if few:
        for r in frequencies(df, few).collect():  # at most 10 values per column
            values[r["column"]].add(r["value"].lower().strip())
    n, rows = row["n"], []
    for i, c in enumerate(columns):
        name, kind, u = c.lower().strip().replace(" ", "_"), kind_of(df, c), uniq[c]
        known = max(1, row[f"k{i}"])
        of = {k: row[f"{k}{i}"] * n / known for k in "dcp"}
        vals = {v[:-2] if v.endswith(".0") else v for v in values.get(c, ())}
        if name in fixed.ID_NAMES or name.endswith("_id") or (u == n and n > 100):
            got = ("id", 0.9, "drop")
        elif u == 2 and vals in fixed.BOOLEAN_SETS:
            got = ("boolean", 0.95, "binary_encode")
        elif any(h in name for h in fixed.ORDINAL_NAMES) or (kind == "text" and u <= 10 and len(vals & set(fixed.ORDINAL_VALUES)) >= 2):
            got = ("ordinal", 0.8, "ordinal_encode")
        elif any(h in name for h in fixed.CYCLIC_NAMES) or (
            kind == "numeric" and 0 < u <= 31 and row[f"lo{i}"] >= 0 and row[f"hi{i}"] <= 31 and row[f"o{i}"] == 0
        ):
            got = ("cyclical", 0.85, "sin_cos_encode")
        elif kind == "text" and of["d"] > 0.5:
            got = ("date_string", 0.9, "parse_datetime")
        elif kind == "text" and of["c"] > 0.5:
            got = ("currency", 0.85, "strip_to_float")
        elif kind == "text" and of["p"] > 0.5:
            got = ("percentage", 0.85, "strip_to_decimal")
        elif kind == "numeric" and name in fixed.GEO_NAMES:
            got = ("geo_coordinate", 0.8, "keep_numeric")
        elif kind == "text":
            got = (("free_text", 0.8, "nlp_tfidf") if (row[f"w{i}"] or 0) > 5
                   else ("low_cardinality_categorical", 0.9, "one_hot_encode") if u <= 20
                   else ("high_cardinality_categorical", 0.8, "frequency_encode"))
        elif kind == "numeric":
            got = (("binary_numeric", 0.9, "keep_as_is") if u == 2
                   else ("discrete_numeric", 0.7, "consider_categorical") if u <= 10
                   else ("continuous_numeric", 0.9, "scale"))
        else:
            got = ("unknown", 0.0, "keep_as_is")
        rows.append((c, *got, u))
    return report(df, rows, "column string, semantic_type string, confidence double, encoding string, distinct long")


def column_histograms(df: DataFrame, columns: Sequence[str], bins=None) -> DataFrame:
    """Equal-width histograms; by default min(30, max(5, n / 10)) bins per column."""
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max), ("n", F.count))})
    bounds = {}
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n:
            bounds[c] = (row[f"lo{i}"], row[f"hi{i}"], bins(n) if bins else min(30, max(5, n // 10)))
    return histogram(df, bounds)


def box_plots(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR cut to the data range, and the mean."""
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("lo", F.min), ("hi", F.max), ("a", F.avg))})
    q = quantiles(df, columns, [0.25, 0.5, 0.75])
    rows = []
    for i, c in enumerate(columns):
        q1, q2, q3 = q[c]
        if q1 is None:
            continue
        iqr = q3 - q1
        rows.append((c, r4(max(row[f"lo{i}"], q1 - 1.5 * iqr)), r4(q1), r4(q2), r4(q3), r4(min(row[f"hi{i}"], q3 + 1.5 * iqr)), r4(row[f"a{i}"])))
    return report(df, rows, "column string, whisker_low double, q1 double, median double, q3 double, whisker_high double, mean double")


def scatter_sample(df: DataFrame, columns: Sequence[str], key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows."""
    from tablewise.operators.measures import hash_uniform

    return (
        df.select(key, *[c for c in columns if c != key], hash_uniform(key, seed).alias("_u"))
        .orderBy("_u", key).limit(n).drop("_u")
    )


def input_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Range, mean, median and step of numeric columns; options and mode of text columns."""
    columns = list(columns or df.columns)
    nums = [c for c in columns if kind_of(df, c) == "numeric"]
    texts = [c for c in columns if kind_of(df, c) == "text"]
    row = measure(df, **({f"{k}{i}": f(number(c)) for i, c in enumerate(nums) for k, f in (("lo", F.min), ("hi", F.max), ("a", F.avg))} or {"n": F.count("*")}))
    q, best = quantiles(df, nums, [0.5]), modes(df, texts)
    rows = [
        (c, r4(row[f"lo{i}"]), r4(row[f"hi{i}"]), r4(row[f"a{i}"]), r4(q[c][0]), r4((row[f"hi{i}"] - row[f"lo{i}"]) / 100.0, 6), None)
        for i, c in enumerate(nums)
    ] + [(c, None, None, None, None, None, best[c]) for c in texts]
    return report(df, rows, "column string, min double, max double, mean double, median double, step double, mode string")
