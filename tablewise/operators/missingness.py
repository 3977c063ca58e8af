"""Why values are missing."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up
from tablewise.functions.tails import chi2_sf, correlation_p
from tablewise.operators import measures
from tablewise.operators.gap_patterns import centre_and_scale, folded, summed
from tablewise.operators.measures import col, correlation, measure, melt, null_counts, number, numeric_columns, quantiles, report, text_columns


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a x = b; the least one where columns depend on each other."""
    try:
        if np.linalg.cond(a) < 1e12:
            return np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        pass
    return np.linalg.pinv(a, hermitian=True) @ b


def likely_moments(table: DataFrame, width: int, tolerance: float = 1e-7, most: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood mean and covariance of normal rows with gaps, by EM over the folded table (standardised units).

    An iteration is one sum over the patterns: what a pattern's rows have, what the regression on it says of the rest, and the rest's own spread.
    """
    mean, cov = np.zeros(width), np.eye(width)
    for _ in range(most):

        def expected(has: np.ndarray, n: int, factor: np.ndarray, mean=mean, cov=cov) -> np.ndarray:
            if not len(has):
                return np.zeros((width + 1) ** 2)
            gone = np.setdiff1d(np.arange(width), has)
            full = np.zeros((width + 1, len(has) + 1))
            full[0, 0] = 1.0
            full[has + 1, np.arange(len(has)) + 1] = 1.0
            rest = np.zeros((width + 1, width + 1))
            if len(gone):
                slope = _solved(cov[np.ix_(has, has)], cov[np.ix_(has, gone)]).T
                full[gone + 1, 1:] = slope
                full[gone + 1, 0] = mean[gone] - slope @ mean[has]
                rest[np.ix_(gone + 1, gone + 1)] = n * (cov[np.ix_(gone, gone)] - slope @ cov[np.ix_(has, gone)])
            made = factor @ full.T
            return (made.T @ made + rest).ravel()

        sums = summed(table, width, (width + 1) ** 2, expected).reshape(width + 1, width + 1)
        if sums[0, 0] == 0:
            break
        old, new = (mean, cov), sums / sums[0, 0]
        mean, cov = new[0, 1:], new[1:, 1:] - np.outer(new[0, 1:], new[0, 1:])
        if max(np.abs(mean - old[0]).max(), np.abs(cov - old[1]).max()) < tolerance:
            break
    return mean, cov


def little_test(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Little's test that values are missing completely at random.

    The mean of every pattern is held against the maximum-likelihood mean, with the maximum-likelihood covariance of the columns it has. Rows collapse to one per pattern on
    the executors; covariance, statistic and degrees of freedom are sums over the patterns, none of which reaches the driver. Rows without any value don't count.
    """
    columns = list(columns or numeric_columns(df))
    width = len(columns)
    given = centre_and_scale(df, columns)
    table = folded(df, columns, *given)
    mean, cov = likely_moments(table, width)

    def gaps(has: np.ndarray, n: int, factor: np.ndarray) -> np.ndarray:
        if not len(has):
            return np.zeros(3)
        gap = (factor.T @ factor)[0, 1:] / n - mean[has]
        return np.array([n * gap @ _solved(cov[np.ix_(has, has)], gap), len(has), 1])

    stat, seen, patterns = summed(table, width, 3, gaps)
    dof = int(seen) - width
    p = chi2_sf(float(stat), dof) if dof > 0 else 1.0
    return report(df, [(half_up(float(stat)), dof, half_up(p, 6), p > 0.05, int(patterns))], "statistic double, dof int, p_value double, is_mcar boolean, patterns int")


def independence_tests(df: DataFrame) -> DataFrame:
    """For each column with gaps the Bonferroni-corrected smallest p of null flag against other columns."""
    miss = null_counts(df, df.columns)
    gaps = [c for c in df.columns if 0 < miss[c] < miss["*"]]
    nums, texts = numeric_columns(df), text_columns(df)
    exprs = {}
    for i, g in enumerate(gaps):
        for j, o in enumerate(nums):
            if o != g:
                exprs |= {f"r{i}_{j}": correlation(col(g).isNull().cast("double"), number(o)), f"n{i}_{j}": F.count(col(o))}
    row = measure(df, **exprs) if exprs else {}
    ps: dict[str, list[float]] = {g: [] for g in gaps}
    for i, g in enumerate(gaps):
        for j, o in enumerate(nums):
            if o != g and row[f"n{i}_{j}"] >= 10 and row[f"r{i}_{j}"] is not None and row[f"r{i}_{j}"] == row[f"r{i}_{j}"]:
                ps[g].append(correlation_p(row[f"r{i}_{j}"], row[f"n{i}_{j}"]))
    if texts and gaps:
        flags = df.select(*[col(t) for t in texts], *[col(g).isNull().cast("int").alias(f"_g{i}") for i, g in enumerate(gaps)])
        counts = melt(flags, texts, "string", [f"_g{i}" for i in range(len(gaps))]).where("value is not null").groupBy("column", "value").agg(
            F.count("*").alias("n"), *[F.sum(f"_g{i}").alias(f"k{i}") for i in range(len(gaps))])
        # chi-square of a 2 x values table needs sums only: sum (k - n p)^2 / (n p q)
        totals = {r["column"]: r for r in counts.groupBy("column").agg(F.sum("n").alias("n"), F.count("*").alias("v"), *[F.sum(f"k{i}").alias(f"k{i}") for i in range(len(gaps))]).collect()}
        sums = []
        for i in range(len(gaps)):
            rate = {t: totals[t][f"k{i}"] / totals[t]["n"] for t in totals}
            p = F.coalesce(*[F.when(F.col("column") == t, F.lit(float(v))) for t, v in rate.items()])
            dev = F.abs(F.col(f"k{i}") - F.col("n") * p)
            # Yates correction applies to 2 x 2 tables
            two = F.coalesce(*[F.when(F.col("column") == t, F.lit(totals[t]["v"] == 2)) for t in totals])
            dev = F.when(two, F.greatest(dev - 0.5, F.lit(0.0))).otherwise(dev)
            sums.append(F.sum(F.try_divide(dev * dev, F.col("n") * p * (1 - p))).alias(f"x{i}"))
        for r in counts.groupBy("column").agg(*sums).collect():
            for i, g in enumerate(gaps):
                t = r["column"]
                if t != g and totals[t]["v"] >= 2 and totals[t]["n"] >= 10 and r[f"x{i}"] is not None and 0 < totals[t][f"k{i}"] < totals[t]["n"]:
                    ps[g].append(chi2_sf(r[f"x{i}"], totals[t]["v"] - 1))
    rows = [(g, miss[g], len(ps[g]), half_up(min(1.0, min(ps[g]) * len(ps[g])) if ps[g] else 1.0, 6)) for g in gaps]
    return report(df, rows, "column string, missing long, tests int, mcar_p double")


def mar_scores(df: DataFrame) -> DataFrame:
    """How well the other numeric columns predict each null flag (AUC) and the strongest predictors."""
    miss, nums = null_counts(df, df.columns), numeric_columns(df)
    q = quantiles(df, nums, [0.5])
    filled = df.select(*[col(c).isNull().cast("double").alias(f"_y{i}") for i, c in enumerate(df.columns)],
                       *[F.coalesce(number(c), F.lit(q[c][0])).alias(c) for c in nums if q[c][0] is not None]).persist()
    found, margins, areas = [], {}, {}
    try:
        for i, c in enumerate(df.columns):
            if not 0 < miss[c] < miss["*"]:
                continue
            others = [o for o in nums if o != c and q[o][0] is not None]
            data = VectorAssembler(inputCols=others, outputCol="raw").transform(filled)
            scaler = StandardScaler(withMean=True, withStd=True, inputCol="raw", outputCol="features").fit(data)
            model = LogisticRegression(labelCol=f"_y{i}", featuresCol="features", regParam=1.0 / max(1, miss["*"]), maxIter=25).fit(scaler.transform(data))
            weights = model.coefficients.toArray()
            if miss["*"] <= measures.ROWS_PER_TASK:  # the plain form, whose curve has some 1,000 points
                areas[i] = BinaryClassificationEvaluator(labelCol=f"_y{i}").evaluate(model.transform(scaler.transform(data)))
            else:
                cells = [(col(o) - float(m)) * float(w / s if s else 0.0) for o, w, m, s in zip(others, weights, scaler.mean.toArray(), scaler.std.toArray())]
                margins[i] = sum(cells, F.lit(float(model.intercept)))
            ranked = sorted(zip(others, weights), key=lambda p: -abs(p[1]))[:3]
            found.append((i, c, ",".join(o for o, w in ranked if abs(w) > 0.1)))
        areas |= areas_under_curves(filled, {i: (col(f"_y{i}"), m) for i, m in margins.items()})
    finally:
        filled.unpersist()
    return report(df, [(c, half_up(areas[i]), names) for i, c, names in found], "column string, mar_score double, predictors string")


def areas_under_curves(df: DataFrame, asked: Mapping[int, tuple[Column, Column]]) -> dict[int, float]:
    """Exact area under the ROC curve of each (0/1 label, score), all from one range shuffle.

    Tasks count labels per score and batch first, so that a frequent score does not fill one task; a task then walks its range of scores in order and
    returns one row per curve.
    """
    if not asked:
        return {}
    curves = list(asked)
    wide = df.select(*[c.alias(f"{name}{i}") for i, (label, score) in asked.items() for name, c in (("y", label), ("s", score))])

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in curves:
                score, at = np.unique(pdf[f"s{i}"].to_numpy(dtype=float), return_inverse=True)
                pos = np.bincount(at, weights=pdf[f"y{i}"].to_numpy(dtype=float), minlength=len(score))
                yield pd.DataFrame({"i": np.int32(i), "score": score, "pos": pos, "neg": np.bincount(at, minlength=len(score)) - pos})

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, list[float]] = {}  # lowest score, positives, negatives, area

        def add(pdf: pd.DataFrame) -> None:
            for i, g in pdf.groupby("i", sort=False):
                score = g["score"].to_numpy()
                first = np.flatnonzero(np.append(True, score[1:] != score[:-1]))
                pos, neg = np.add.reduceat(g["pos"].to_numpy(), first), np.add.reduceat(g["neg"].to_numpy(), first)
                s = sums.setdefault(int(i), [score[0], 0.0, 0.0, 0.0])
                s[3] += float((pos * (s[2] + np.cumsum(neg) - neg / 2)).sum())
                s[1], s[2] = s[1] + pos.sum(), s[2] + neg.sum()

        held = None  # the last score so far, whose rows may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf])
            last = ((pdf["i"] == pdf["i"].iloc[-1]) & (pdf["score"] == pdf["score"].iloc[-1])).to_numpy()
            add(pdf[~last])
            held = pdf[last].groupby(["i", "score"], as_index=False).sum()
        if held is not None:
            add(held)
        yield pd.DataFrame([(i, *s) for i, s in sums.items()], columns=["i", "low", "pos", "neg", "area"])

    scores = wide.mapInPandas(counted, "i int, score double, pos double, neg double").repartitionByRange("i", "score").sortWithinPartitions("i", "score")
    totals = {i: [0.0, 0.0, 0.0] for i in curves}
    for r in sorted(scores.mapInPandas(walked, "i int, low double, pos double, neg double, area double").collect(), key=lambda r: (r["i"], r["low"])):  # a row per task and curve
        t = totals[r["i"]]
        t[2] += r["area"] + r["pos"] * t[1]
        t[0], t[1] = t[0] + r["pos"], t[1] + r["neg"]
    return {i: area / (pos * neg) for i, (pos, neg, area) in totals.items()}


def missing_labels(df: DataFrame) -> DataFrame:
    """MCAR, MAR or MNAR per column with gaps."""
    return independence_tests(df).join(mar_scores(df), "column").select(
        "*", F.when((F.col("mcar_p") > 0.05) & (F.col("mar_score") < 0.6), "MCAR").when(F.col("mar_score") >= 0.6, "MAR").otherwise("MNAR").alias("pattern"))


def null_correlations(df: DataFrame) -> DataFrame:
    """Correlation of null flags for every pair of columns with gaps."""
    miss = null_counts(df, df.columns)
    gaps = [c for c in df.columns if 0 < miss[c] < miss["*"]]
    pairs = [(a, b) for i, a in enumerate(gaps) for b in gaps[i + 1 :]]
    row = measure(df, **{f"r{i}": correlation(col(a).isNull().cast("double"), col(b).isNull().cast("double")) for i, (a, b) in enumerate(pairs)})
    return report(df, [(a, b, half_up(row[f"r{i}"])) for i, (a, b) in enumerate(pairs)], "column_1 string, column_2 string, correlation double")


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    miss = null_counts(df, columns)
    return df.withColumns({f"{c}_is_missing": col(c).isNull().cast("int") for c in columns if miss[c]})


def missing_summary(labels: DataFrame, mcar: DataFrame) -> DataFrame:
    """Counts by label and the overall pattern."""
    is_mcar = mcar.first()["is_mcar"]
    return labels.agg(
        F.count("*").alias("columns"), *[F.count_if(F.col("pattern") == p).alias(p.lower()) for p in ("MCAR", "MAR", "MNAR")]
    ).withColumn("overall", F.when(F.col("mnar") > 0, "contains_MNAR").otherwise("MCAR" if is_mcar else "mixed"))
