"""Table fingerprints, similarity, dataset DNA and advice from earlier results."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import bias_corrected_kurtosis, bias_corrected_skew, half_up, rounded
from tablewise.operators.explore import outlier_measures
from tablewise.operators.measures import col, distinct_counts, measure, null_counts, number, numeric_columns, pair_correlations, report, text_columns
from tablewise.operators.profile import duplicate_rows, kind_of


def mean(values) -> float:
    values = [v for v in values if v is not None and v == v]
    return sum(values) / len(values) if values else 0.0


def upper_mean(pairs: Mapping[tuple[str, str], float | None], columns) -> float:
    """Mean over columns of the mean absolute correlation with the columns before."""
    per = [mean(abs(pairs[a, b]) for a in columns[:j] if pairs[a, b] is not None) for j, b in enumerate(columns) if j]
    return mean(per)


def shape_measures(df: DataFrame, columns) -> tuple[list, list, list, list]:
    """Skewness, kurtosis, std and mean of the numeric columns in one aggregate."""
    fns = {"g": bias_corrected_skew, "k": bias_corrected_kurtosis, "s": F.stddev_samp, "a": F.avg}
    row = measure(df, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in fns.items()}) if columns else {}
    return tuple([row[f"{k}{i}"] for i in range(len(columns))] for k in fns)


def table_fingerprint(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row describing the table."""
    nums, texts = numeric_columns(df), text_columns(df)
    miss, uniq = null_counts(df, df.columns), distinct_counts(df, df.columns)
    n, k = miss["*"], len(df.columns)
    skew, kurt, _, _ = shape_measures(df, nums)
    kind, classes, balance = "unknown", None, None
    if target:
        if kind_of(df, target) == "numeric" and uniq[target] > 20:
            kind = "regression"
        else:
            kind, classes = "classification", uniq[target]
            c = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias("n")).agg(F.max("n").alias("hi"), F.min("n").alias("lo"), F.sum("n").alias("all")).first()
            balance = half_up((c["hi"] / c["all"]) / max(c["lo"] / c["all"], 0.01), 2)
    size = "tiny" if n < 500 else "small" if n < 5000 else "medium" if n < 50000 else "large"
    row = (n, k, half_up(len(nums) / max(k, 1)), half_up(len(texts) / max(k, 1)), half_up(mean(100.0 * miss[c] / max(1, n) for c in df.columns), 2),
           half_up(mean(uniq.values()) / max(1, n)), half_up(100.0 * duplicate_rows(df) / max(1, n), 2), half_up(mean(abs(v) for v in skew if v is not None)),
           half_up(mean(abs(v) for v in kurt if v is not None)), half_up(upper_mean(pair_correlations(df, nums), nums)) if len(nums) > 1 else 0.0, kind, classes, balance, size)
    return report(df, [row], "n_rows long, n_cols int, numeric_ratio double, text_ratio double, missing_pct double, cardinality_ratio double, duplicate_pct double, skewness double, kurtosis double, correlation double, target_type string, n_classes long, imbalance double, size string")


VECTOR = ["n_rows", "n_cols", "numeric_ratio", "text_ratio", "missing_pct", "cardinality_ratio", "skewness", "kurtosis", "correlation"]


def fingerprint_vector() -> Column:
    """9 numbers of a fingerprint row, rows and columns on a log scale."""
    return F.array(*[(F.log1p(number(c)) if i < 2 else number(c)) for i, c in enumerate(VECTOR)])


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def most_similar(stored: DataFrame, key: str, vector: str, wanted: list[float], k: int = 3) -> DataFrame:
    """The k stored vectors closest to one vector by cosine, as a projection and a top-k."""
    target = F.array(*[F.lit(float(v)) for v in wanted])
    return stored.select(key, rounded(cosine(F.transform(vector, lambda x: x.cast("double")), target)).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def settings_advice(similar: DataFrame, experiments: DataFrame, key: str = "id", model: str = "best_model", score: str = "score") -> DataFrame:
    """The 3 most common best models among similar experiments and the mean score."""
    both = similar.select(key).join(experiments, key)
    m = measure(both, a=F.avg(number(score)), n=F.count("*"))
    return both.groupBy(col(model).alias("model")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model").limit(3).select(
        "model", "n", F.lit(half_up(m["a"])).alias("mean_score"), F.lit(m["n"]).cast("long").alias("based_on"))


def dna(df: DataFrame, target: str, problem: str = "classification") -> DataFrame:
    """Measures of a table as (measure, value) rows."""
    nums, texts = numeric_columns(df, [target]), [c for c in text_columns(df) if c != target]
    miss, uniq = null_counts(df, df.columns), distinct_counts(df, df.columns)
    n, features = miss["*"], len(df.columns) - 1
    m: dict[str, float] = {
        "n_rows": n, "n_features": features, "n_numeric": len(nums), "n_categorical": len(texts), "dimensionality_ratio": half_up(features / max(n, 1), 6),
        "log_n_rows": math.log1p(n), "missing_pct": mean(100.0 * miss[c] / max(1, n) for c in df.columns), "cols_with_missing": sum(miss[c] > 0 for c in df.columns),
        "duplicate_pct": 100.0 * duplicate_rows(df) / max(1, n),
    }
    if nums:
        skew, kurt, std, avg = shape_measures(df, nums)
        m |= {"mean_skewness": mean(abs(v) for v in skew if v is not None), "max_skewness": max((abs(v) for v in skew if v is not None), default=0.0),
              "mean_kurtosis": mean(abs(v) for v in kurt if v is not None), "mean_coefficient_of_variation": mean(s / max(abs(a), 1e-8) for s, a in zip(std, avg) if s is not None)}
        pairs = pair_correlations(df, nums)
        known = [abs(v) for v in pairs.values() if v is not None]
        m |= {"mean_abs_correlation": upper_mean(pairs, nums), "max_abs_correlation": max(known, default=0.0), "highly_correlated_pairs": sum(v > 0.8 for v in known)}
        m["outlier_density"] = sum(o["n_outliers"] for o in outlier_measures(df, nums)) / max(1, n * len(nums))
    if problem == "classification":
        c = df.where(col(target).isNotNull()).groupBy(col(target)).agg(F.count("*").alias("n"))
        t = c.agg(F.sum("n").alias("t"), F.max("n").alias("hi"), F.min("n").alias("lo"), F.count("*").alias("k"), F.sum(F.col("n") * F.log("n")).alias("e")).first()
        m |= {"n_classes": t["k"], "class_entropy": math.log(t["t"]) - t["e"] / t["t"], "imbalance_ratio": t["hi"] / max(1, t["lo"]), "minority_pct": 100.0 * t["lo"] / max(1, n)}
    else:
        skew, kurt, std, avg = shape_measures(df, [target])
        m |= {"target_skewness": skew[0], "target_kurtosis": kurt[0], "target_cv": std[0] / max(abs(avg[0]), 1e-8)}
    if texts:
        m |= {"mean_cardinality": mean(uniq[c] for c in texts), "max_cardinality": max(uniq[c] for c in texts), "categorical_ratio": len(texts) / max(1, features)}
    return report(df, [(k, half_up(v, 6 if k == "dimensionality_ratio" else 4)) for k, v in m.items()], "measure string, value double")


def contribute(dna_rows: DataFrame, experiment: str, model: str, score: float, problem: str) -> DataFrame:
    """A shared record: the measures with the result that was reached."""
    return dna_rows.select(F.lit(experiment).alias("id"), F.lit(problem).alias("problem_type"), F.lit(model).alias("best_model"), F.lit(score).alias("score"), "measure", "value")


def recommend(knowledge: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """Similarity-weighted vote of the k stored records closest to the wanted measures.

    ``knowledge`` has rows (id, best_model, score, measure, value); ``wanted`` (measure, value).
    """
    mine = {r["measure"]: float(r["value"]) for r in wanted.collect()}  # a few dozen measures
    want = F.create_map(*[x for kv in mine.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    other = F.try_element_at(want, F.col("measure"))
    close = F.greatest(F.lit(0.0), 1 - F.abs(F.col("value") - other) / F.greatest(F.abs("value"), F.abs(other), F.lit(1e-8)))
    near = knowledge.where(other.isNotNull()).groupBy("id").agg(F.avg(close).alias("similarity"), F.max("best_model").alias("best_model"), F.max("score").alias("score"))
    top = near.orderBy(F.desc("similarity"), "id").limit(k)
    votes = top.groupBy("best_model").agg(F.sum("similarity").alias("v"), F.count("*").alias("n"))
    total = votes.agg(F.sum("v")).first()[0] or 1.0
    return votes.select("best_model", "n", rounded(F.col("v")).alias("votes"), rounded(F.col("v") / max(total, 1.0), 2).alias("confidence"))


def knowledge_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("best_model").agg(F.count_distinct("id").alias("experiments"), rounded(F.avg("score")).alias("mean_score"))


def overview_row(df: DataFrame, target: str, best_model: str, best_score: float, quality: float, fairness: float, drift: str) -> DataFrame:
    """Everything worth knowing about one run in one row."""
    miss = null_counts(df, df.columns)
    gaps = 100.0 * sum(miss[c] for c in df.columns) / max(1, miss["*"] * len(df.columns))
    return report(df, [(miss["*"], len(df.columns), target, half_up(gaps, 2), best_model, half_up(best_score), half_up(quality, 1), half_up(fairness, 1), drift)],
                  "n_rows long, n_columns int, target string, missing_pct double, best_model string, best_score double, quality double, fairness double, drift string")
