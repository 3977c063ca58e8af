"""Column coercions applied to any incoming table. Each step gives (frame, list of changes)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewise.functions import fixed_values as fixed
from tablewise.operators.explore import DATE_FORMATS
from tablewise.operators.measures import (
    col, distinct_counts, frequencies, measure, null_counts, number, numeric_columns,
    quantiles, report, text_columns,
)

Step = tuple[DataFrame, list[tuple[str, str, str]]]


def text_shares(df: DataFrame, **tests) -> dict[str, dict[str, float]]:
    """Share of the non-null values of each text column that pass each test, in one pass."""
    texts = text_columns(df)
    exprs = {f"{k}_{i}": F.avg(F.when(col(c).isNotNull(), f(col(c)).cast("int"))) for i, c in enumerate(texts) for k, f in tests.items()}
    row = measure(df, **exprs) if exprs else {}
    return {c: {k: row[f"{k}_{i}"] or 0.0 for k in tests} for i, c in enumerate(texts)}


def clean_names(df: DataFrame) -> Step:
    """Column names in snake case; a repeated name gets a number."""
    used: dict[str, int] = {}
    names = []
    for i, c in enumerate(df.columns):
        s = re.sub(r"_+", "_", re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "_", c.strip()))).strip("_").lower() or f"col_{i}"
        used[s] = used.get(s, -1) + 1
        names.append(f"{s}_{used[s]}" if used[s] else s)
    changes = [("names", a, b) for a, b in zip(df.columns, names) if a != b]
    return df.toDF(*names), changes


def flatten_json(df: DataFrame) -> Step:
    """JSON object columns become one column per leaf; the schema comes from all values."""
    def parsed(c: Column) -> Column:
        return F.try_parse_json(c)

    hits = [c for c, s in text_shares(df, j=lambda c: c.rlike(r"^\s*\{") & parsed(c).isNotNull()).items() if s["j"] > 0.5]
    if not hits:
        return df, []
    row = measure(df, **{f"s{i}": F.schema_of_variant_agg(parsed(col(c))) for i, c in enumerate(hits)})
    changes = []
    for i, c in enumerate(hits):
        ddl = row[f"s{i}"].replace("OBJECT<", "STRUCT<").replace("VARIANT", "STRING").replace("VOID", "STRING")
        schema = T._parse_datatype_string(ddl)
        if not isinstance(schema, T.StructType) or not schema.fields:
            continue
        df = df.withColumn("_j", F.from_json(col(c), schema)).drop(c)
        leaves = list(_leaves(schema, "_j", c))
        df = df.withColumns({name: F.col(path) for path, name in leaves}).drop("_j")
        changes.append(("flatten", c, ",".join(n for _, n in leaves)))
    return df, changes


def _leaves(schema: T.StructType, path: str, name: str):
    for f in schema.fields:
        here = f"{path}.`{f.name}`"
        if isinstance(f.dataType, T.StructType):
            yield from _leaves(f.dataType, here, f"{name}_{f.name}")
        else:
            yield here, f"{name}_{f.name}"


def strip_markup(df: DataFrame) -> Step:
    hits = [c for c, s in text_shares(df, m=lambda c: c.rlike(fixed.MARKUP_TAG)).items() if s["m"] > 0.3]
    plain = {c: F.trim(F.regexp_replace(F.regexp_replace(col(c), fixed.MARKUP_TAG, " "), r"\s+", " ")) for c in hits}
    return (df.withColumns(plain) if hits else df), [("markup", c, "stripped") for c in hits]


def drop_encoded(df: DataFrame) -> Step:
    """Drop base64 columns."""
    def is_base64(c):
        t = F.trim(c)
        return (F.length(t) > 20) & t.rlike(fixed.BASE64_TEXT) & F.try_to_binary(t, F.lit("base64")).isNotNull()

    hits = [c for c, s in text_shares(df, b=is_base64).items() if s["b"] > 0.5]
    return df.drop(*hits), [("encoded", c, "dropped") for c in hits]


def handle_contacts(df: DataFrame) -> Step:
    """E-mail columns become their domain; URL and phone columns are dropped."""
    changes = []
    shares = text_shares(df, e=lambda c: F.trim(c).rlike(fixed.EMAIL_VALUE), u=lambda c: F.trim(c).rlike(fixed.URL_VALUE), p=lambda c: F.trim(c).rlike(fixed.PHONE_VALUE))
    for c, s in shares.items():
        if s["e"] > 0.5:
            df = df.withColumn(f"{c}_domain", F.nullif(F.regexp_extract(col(c), r"@([\w.]+)", 1), F.lit(""))).drop(c)
            changes.append(("contacts", c, "domain"))
        elif s["u"] > 0.5 or s["p"] > 0.5:
            df = df.drop(c)
            changes.append(("contacts", c, "dropped"))
    return df, changes


def currency_value(c: Column) -> Column:
    s = F.regexp_replace(c, fixed.CURRENCY_SYMBOLS, "")
    eu = F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    us = F.replace(s, F.lit(","), F.lit(""))
    return F.when(s.rlike(fixed.EU_NUMBER), eu).otherwise(us).try_cast("double")


def parse_currency(df: DataFrame) -> Step:
    hits = [c for c, s in text_shares(df, m=lambda c: c.rlike(fixed.CURRENCY_VALUE)).items() if s["m"] > 0.7]
    return (df.withColumns({c: currency_value(col(c)) for c in hits}) if hits else df), [("currency", c, "number") for c in hits]


def parse_percent(df: DataFrame) -> Step:
    hits = [c for c, s in text_shares(df, m=lambda c: c.rlike(fixed.PERCENT_VALUE)).items() if s["m"] > 0.7]
    made = {c: F.rtrim(F.regexp_replace(F.trim(col(c)), "%+$", "")).try_cast("double") / 100.0 for c in hits}
    return (df.withColumns(made) if hits else df), [("percent", c, "fraction") for c in hits]


def few_values(df: DataFrame, limit: int) -> dict[str, set[str]]:
    """Lower-case trimmed value sets of the text columns with at most ``limit`` distinct values."""
    lowered = df.select(*[F.lower(F.trim(col(c))).alias(c) for c in text_columns(df)])
    uniq = distinct_counts(lowered, lowered.columns)
    few = [c for c in lowered.columns if 0 < uniq[c] <= limit]
    out: dict[str, set[str]] = {c: set() for c in few}
    for r in frequencies(lowered, few).collect() if few else []:  # at most ``limit`` rows per column
        out[r["column"]].add(r["value"])
    return out


def unify_flags(df: DataFrame) -> Step:
    """Columns of 2 or 3 distinct yes/no words become 1/0."""
    known = set(fixed.TRUE_WORDS) | set(fixed.FALSE_WORDS)
    hits = [c for c, v in few_values(df, 3).items() if len(v) >= 2 and v - {""} <= known]
    made = {}
    for c in hits:
        w = F.lower(F.trim(col(c)))
        made[c] = F.when(w.isin(fixed.TRUE_WORDS), 1).when(w.isin(fixed.FALSE_WORDS), 0)
    return (df.withColumns(made) if hits else df), [("flags", c, "0/1") for c in hits]


def coerce_numbers(df: DataFrame, threshold: float = 0.8) -> Step:
    """Text to number where more than 80% parse; commas are stripped in the test and in the cast."""
    def num(c):
        return F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double")

    hits = [c for c, s in text_shares(df, m=lambda c: num(c).isNotNull()).items() if s["m"] > threshold]
    return (df.withColumns({c: num(col(c)) for c in hits}) if hits else df), [("numbers", c, "number") for c in hits]


def date_value(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(p)) for p in DATE_FORMATS])


def unify_dates(df: DataFrame) -> Step:
    """Date text to year, month and day of week (Monday 0)."""
    hits = [c for c, s in text_shares(df, m=lambda c: date_value(c).isNotNull()).items() if s["m"] > 0.8]
    for c in hits:
        d, stem = date_value(col(c)), c.replace(" ", "_")
        df = df.withColumns({f"{stem}_year": F.year(d), f"{stem}_month": F.month(d), f"{stem}_dayofweek": F.weekday(d)}).drop(c)
    return df, [("dates", c, "year,month,dayofweek") for c in hits]


def drop_ids(df: DataFrame) -> Step:
    """Drop identifiers: by name, all-distinct code-like text, gap-free distinct integers."""
    named = [c for c in df.columns if re.search(fixed.ID_COLUMN_NAME, c)]
    texts = [c for c in text_columns(df) if c not in named]
    whole = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType)) and f.name not in named]
    uniq = distinct_counts(df, texts + whole)
    exprs = {"n": F.count("*")}
    for i, c in enumerate(texts):
        words = F.regexp_replace(col(c), r"[., ]", "")
        exprs[f"t{i}"] = F.min((F.length(col(c)) > 8) & ~words.rlike(r"^\p{L}+$"))
    for i, c in enumerate(whole):
        exprs |= {f"w{i}": F.max(col(c)).cast("long") - F.min(col(c)).cast("long") + 1}
    row = measure(df, **exprs)
    n = row["n"]
    hits = set(named)
    hits |= {c for i, c in enumerate(texts) if n > 20 and uniq[c] == n and row[f"t{i}"]}
    hits |= {c for i, c in enumerate(whole) if uniq[c] == n and row[f"w{i}"] == n}
    hits = [c for c in df.columns if c in hits]
    return df.drop(*hits), [("ids", c, "dropped") for c in hits]


def drop_constants(df: DataFrame) -> Step:
    """Drop columns with one value; a null counts as a value."""
    uniq, miss = distinct_counts(df, df.columns), null_counts(df, df.columns)
    hits = [c for c in df.columns if uniq[c] + (miss[c] > 0) <= 1]
    return df.drop(*hits), [("constant", c, "dropped") for c in hits]


def drop_sparse(df: DataFrame, threshold: float = 0.9) -> Step:
    miss = null_counts(df, df.columns)
    hits = [c for c in df.columns if miss[c] > threshold * max(1, miss["*"])]
    return df.drop(*hits), [("sparse", c, "dropped") for c in hits]


def blank_sentinels(df: DataFrame) -> Step:
    """Placeholder numbers become null where they are rare (0.1%-15%) and beyond 3 IQR."""
    nums = numeric_columns(df)
    q = quantiles(df, nums, [0.25, 0.75])
    far = {}
    for c in nums:
        a, b = q[c]
        if a is not None:
            far[c] = [s for s in fixed.SENTINELS if s < a - 3 * (b - a) or s > b + 3 * (b - a)]
    exprs = {f"n{i}": F.count(col(c)) for i, c in enumerate(nums)}
    exprs |= {f"s{i}_{j}": F.count_if(number(c) == s) for i, c in enumerate(nums) for j, s in enumerate(far.get(c, []))}
    row = measure(df, **exprs) if exprs else {}
    made, changes = {}, []
    for i, c in enumerate(nums):
        n = row[f"n{i}"]
        hit = [s for j, s in enumerate(far.get(c, [])) if n >= 10 and 0.001 < row[f"s{i}_{j}"] / n < 0.15]
        if hit:
            made[c] = F.when(~number(c).isin([float(s) for s in hit]), col(c))
            changes += [("sentinel", c, str(s)) for s in hit]
    return (df.withColumns(made) if made else df), changes


def rank_ordered_words(df: DataFrame) -> Step:
    """Columns whose values belong to one ordered vocabulary become ranks from 1."""
    made, changes = {}, []
    for c, vals in few_values(df, max(map(len, fixed.ORDERED_WORDS))).items():
        words = next((w for w in fixed.ORDERED_WORDS if vals <= set(w)), None)
        if words:
            made[c] = F.nullif(F.array_position(F.array(*[F.lit(w) for w in words]), F.lower(F.trim(col(c)))), F.lit(0)).cast("int")
            changes.append(("ordinal", c, ",".join(words)))
    return (df.withColumns(made) if made else df), changes


def prune_width(df: DataFrame, keep: int | None = None) -> Step:
    """Keep the ``keep`` numeric columns with the highest variance; all if not given."""
    nums = numeric_columns(df)
    if keep is None or len(nums) <= keep:
        return df, []
    row = measure(df, **{f"v{i}": F.var_samp(number(c)) for i, c in enumerate(nums)})
    ranked = sorted(range(len(nums)), key=lambda i: (-(row[f"v{i}"] or 0.0), i))
    gone = [nums[i] for i in sorted(ranked[keep:])]
    return df.drop(*gone), [("width", c, "dropped") for c in gone]


STEPS = [
    clean_names, drop_constants, drop_sparse, drop_ids, parse_currency, parse_percent, unify_flags, unify_dates,
    strip_markup, flatten_json, blank_sentinels, rank_ordered_words, coerce_numbers, prune_width, handle_contacts, drop_encoded,
]


def transform_any(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All steps in their fixed order, with the list of changes."""
    changes: list[tuple[str, str, str]] = []
    source = df
    for step in STEPS:
        df, made = step(df)
        changes += made
    return df, report(source, changes, "step string, column string, change string")
