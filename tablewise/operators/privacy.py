"""Finding and masking personal data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions import fixed_values as fixed
from tablewise.functions.moments import half_up
from tablewise.operators.measures import col, distinct_counts, measure, report, text_columns

SCAN = "column string, kind string, confidence double, match_pct double, risk string"


def has_check_digit(c: Column) -> Column:
    """Card numbers of 13 to 19 digits whose check digit is right."""
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def scan(df: DataFrame) -> DataFrame:
    """Best kind of personal data per column, from its name and the share of matching values.

    All kinds and columns are tested in one aggregate over all rows.
    """
    texts = text_columns(df)
    exprs = {}
    for i, c in enumerate(texts):
        known = F.when(col(c).isNotNull(), col(c))
        for k, (kind, pattern, _, _) in enumerate(fixed.PERSONAL_KINDS):
            if pattern:
                exprs[f"p{i}_{k}"] = F.avg(known.rlike(pattern).cast("double"))
            if kind == "credit_card":
                exprs[f"l{i}"] = F.avg(has_check_digit(known).cast("double"))
        exprs[f"t{i}"] = F.avg(((F.initcap(F.lower(known)) == known) | (F.upper(known) == known)).cast("double"))
        exprs[f"n{i}"] = F.count(col(c))
    row = measure(df, n=F.count("*"), **exprs)
    uniq = distinct_counts(df, texts)
    rows = []
    for c in df.columns:
        i = texts.index(c) if c in texts else None
        if i is not None and row[f"n{i}"] == 0:
            continue
        name, best = c.lower().strip().replace(" ", "_"), (0.0, None, 0.0, None)
        for k, (kind, pattern, hints, risk) in enumerate(fixed.PERSONAL_KINDS):
            named = any(h in name for h in hints)
            score, hit = 0.5 * named, 0.0
            if pattern and i is not None:
                hit = row[f"p{i}_{k}"] or 0.0
                score += 0.4 if hit > 0.3 else 0.2 if hit > 0.1 else 0.1 if hit > 0.01 else 0.0
                if kind == "credit_card" and hit > 0 and (row[f"l{i}"] or 0.0) < 0.5 * hit:
                    score *= 0.3
            if kind == "name" and named and i is not None and (row[f"t{i}"] or 0) > 0.5 and uniq[c] / max(1, row["n"]) > 0.3:
                score, hit = score + 0.3, row[f"t{i}"]
            if score > best[0]:
                best = (score, kind, hit, risk)
        if best[0] >= 0.4:
            rows.append((c, best[1], half_up(best[0], 2), half_up(100.0 * best[2], 1), best[3]))
    return report(df, rows, SCAN)


def name_columns(df: DataFrame) -> DataFrame:
    """Share of title-case or upper-case values and distinct ratio per text column named like a person."""
    hints = next(h for k, _, h, _ in fixed.PERSONAL_KINDS if k == "name")
    texts = [c for c in text_columns(df) if any(h in c.lower() for h in hints)]
    row = measure(df, n=F.count("*"), **{f"t{i}": F.avg(((F.initcap(F.lower(col(c))) == col(c)) | (F.upper(col(c)) == col(c))).cast("double")) for i, c in enumerate(texts)})
    uniq = distinct_counts(df, texts)
    rows = [(c, half_up(row[f"t{i}"]), half_up(uniq[c] / max(1, row["n"])), (row[f"t{i}"] or 0) > 0.5 and uniq[c] / max(1, row["n"]) > 0.3) for i, c in enumerate(texts)]
    return report(df, rows, "column string, title_share double, distinct_ratio double, looks_like_names boolean")


def card_check(df: DataFrame, column: str) -> DataFrame:
    """Matches of the card pattern, how many pass the check digit, and the confidence factor."""
    pattern = next(p for k, p, _, _ in fixed.PERSONAL_KINDS if k == "credit_card")
    return df.agg(F.count_if(col(column).rlike(pattern)).alias("matches"), F.count_if(has_check_digit(col(column))).alias("valid")).select(
        "*", F.when(F.col("valid") < 0.5 * F.col("matches"), 0.3).otherwise(1.0).alias("factor"))


def mask_hash(df: DataFrame, columns: Sequence[str], salt: str) -> DataFrame:
    """16 hex digits of a salted SHA-256; equal values stay equal."""
    return df.withColumns({c: F.when(col(c).isNotNull(), F.substring(F.sha2(F.concat(F.lit(salt + ":"), col(c).cast("string")), 256), 1, 16)) for c in columns})


def mask_token(df: DataFrame, columns: Sequence[str], secret: str) -> DataFrame:
    """A token per distinct value. The keyed hash is the token, so no token table has to be joined or kept."""
    return df.withColumns({c: F.when(col(c).isNotNull(), F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat(F.lit(f"{secret}|{c}|"), col(c).cast("string")), 256), 1, 24))) for c in columns})


def mask_redact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(col(c).isNotNull(), F.lit("[REDACTED]")) for c in columns})


def partial(c: Column, kind: str) -> Column:
    """A value with most of it hidden, by kind."""
    parts = F.split(c, "@")
    shown = F.concat(F.substring(c, 1, 2), F.lit("***"))
    if kind == "email":
        shown = F.when(F.size(parts) == 2, F.concat(F.substring(parts[0], 1, 2), F.lit("***@"), parts[1])).otherwise(shown)
    elif kind in ("phone", "ssn", "credit_card", "aadhaar"):
        shown = F.concat(F.lit("***"), F.right(c, F.lit(4)))
    elif kind == "name":
        shown = F.concat(F.substring(c, 1, 1), F.lit("***"))
    return F.when(F.length(c) < 3, "***").otherwise(shown)


def risk_summary(found: DataFrame) -> DataFrame:
    """Columns by risk and the overall level."""
    by = [F.count_if(F.col("risk") == r).alias(r) for r in ("critical", "high", "medium", "low")]
    return found.agg(*by).withColumn(
        "overall", F.when(F.col("critical") > 0, "critical").when(F.col("high") > 0, "high").when(F.col("medium") > 0, "medium").otherwise("none"))


def mask_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    a, b = distinct_counts(before, columns), distinct_counts(after, columns)
    return report(before, [(c, a[c], b[c]) for c in columns], "column string, distinct_before long, distinct_after long")
