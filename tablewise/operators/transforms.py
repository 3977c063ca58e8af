"""Table transforms before training: encodings, filters, scaling, target transforms, collinearity."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, UnivariateFeatureSelector, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up
from tablewise.operators.explore import k_squared
from tablewise.operators.features import frequency_encode, lookup, quantile_bins
from tablewise.operators.measures import (
    col, distinct_counts, frequencies, hash_uniform, measure, number, numeric_columns,
    pair_correlations, report, text_columns,
)


def label_classes(df: DataFrame, target: str, limit: int = 10_000) -> list[str]:
    """Classes of a target in sorted order; a target with more than ``limit`` classes is refused."""
    if distinct_counts(df, [target])[target] > limit:
        raise ValueError(f"{target} has more than {limit} classes")
    return sorted(r["value"] for r in frequencies(df, [target]).select("value").collect())


def label_encode(df: DataFrame, target: str, into: str | None = None) -> tuple[DataFrame, dict[str, int]]:
    """Classes numbered from 0 in sorted order."""
    classes = label_classes(df, target)
    if len(classes) > 200:  # a lookup join instead of a long literal
        codes = report(df, [(c, i) for i, c in enumerate(classes)], "_value string, _code int")
        joined = df.withColumn("_value", col(target).cast("string")).join(codes, "_value", "left").withColumn(into or target, col("_code"))
        return joined.drop("_value", "_code").select(*[col(c) for c in df.columns], *([into] if into and into not in df.columns else [])), {c: i for i, c in enumerate(classes)}
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), col(target).cast("string")) - 1
    return df.withColumn(into or target, F.when(col(target).isNotNull(), at).cast("int")), {c: i for i, c in enumerate(classes)}


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """One 0/1 column per value but the first in sorted order; the source goes."""
    classes = label_classes(df, column, 1000)
    return df.withColumns({f"{column}_{v}": F.coalesce((col(column) == v).cast("int"), F.lit(0)) for v in classes[1:]}).drop(column)


def target_encode(df: DataFrame, column: str, target: str, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Cross-fitted smoothed mean of the target per value.

    One aggregate per (value, fold) gives the sums of the other folds by subtraction; the
    blend weight is n / (n + within variance / target variance), the empirical-Bayes form.
    """
    data = df.withColumn("_fold", F.floor(hash_uniform(key, seed) * folds).cast("int")).withColumn("_y", number(target))
    sums = [F.count("_y").alias("n"), F.sum("_y").alias("s"), F.sum(F.col("_y") * F.col("_y")).alias("q")]
    part = data.where(col(column).isNotNull()).groupBy(col(column), "_fold").agg(*sums)
    whole = {r["_fold"]: r for r in data.groupBy("_fold").agg(*sums).collect()}
    total = {k: sum(r[k] or 0 for r in whole.values()) for k in ("n", "s", "q")}
    rows = []
    for f in range(folds):
        n, s, q = (total[k] - (whole[f][k] or 0 if f in whole else 0) for k in ("n", "s", "q"))
        mean = s / n if n else 0.0
        rows.append((f, mean, max(0.0, q / n - mean * mean) if n else 0.0))
    prior = report(df, rows, "_fold int, _mean double, _var double")
    values = part.groupBy(col(column)).agg(
        F.collect_list(F.struct("_fold", "n", "s", "q")).alias("f"), F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))
    # per value at most ``folds`` entries: explode every fold, subtract its own sums
    each = values.select(col(column), F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("_fold"), "f", "tn", "ts", "tq")
    own = F.try_element_at(F.filter("f", lambda x: x["_fold"] == F.col("_fold")), F.lit(1))
    each = each.withColumn("o", own).select(
        col(column), "_fold", (F.col("tn") - F.coalesce("o.n", F.lit(0))).alias("n"),
        (F.col("ts") - F.coalesce("o.s", F.lit(0.0))).alias("s"), (F.col("tq") - F.coalesce("o.q", F.lit(0.0))).alias("q"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    within = F.greatest(F.lit(0.0), F.try_divide(F.col("q"), F.col("n")) - mean * mean)
    weight = F.try_divide(F.col("_var") * F.col("n"), F.col("_var") * F.col("n") + within)
    enc = each.join(prior, "_fold").select(
        col(column), "_fold", F.when(F.col("n") > 0, F.coalesce(weight, F.lit(0.0)) * mean + (1 - F.coalesce(weight, F.lit(0.0))) * F.col("_mean")).alias("_e"))
    out = lookup(lookup(data, enc, [column, "_fold"]), prior.select("_fold", "_mean"), ["_fold"])
    return out.withColumn(f"{column}_encoded", F.coalesce("_e", "_mean")).select(*[col(c) for c in df.columns], f"{column}_encoded")


def encode(df: DataFrame, target: str | None, key: str | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Two values to 0/1, up to 10 to one-hot, more to target means (or frequencies without a target)."""
    uniq, how = distinct_counts(df, [c for c in text_columns(df) if c != target]), {}
    for c, u in uniq.items():
        if u <= 2:
            df, how[c] = label_encode(df, c)[0], "label"
        elif u <= 10:
            df, how[c] = one_hot(df, c), "one_hot"
        elif target is not None and key is not None:
            df = target_encode(df, c, target, key)
            df, how[c] = df.withColumn(c, col(f"{c}_encoded")).drop(f"{c}_encoded"), "target"
        else:
            df, how[c] = frequency_encode(df, [c], replace=True), "frequency"
    return df, how


def low_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    row = measure(df, **{f"v{i}": F.var_pop(number(c)) for i, c in enumerate(columns)})
    return [c for i, c in enumerate(columns) if (row[f"v{i}"] or 0.0) <= threshold]


def drop_low_variance(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.01) -> DataFrame:
    return df.drop(*low_variance(df, list(columns or numeric_columns(df)), threshold))


def correlated(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Columns whose absolute correlation with an earlier column is above the threshold."""
    found = pair_correlations(df, columns)
    return [b for j, b in enumerate(columns) if any(abs(found[a, b] or 0.0) > threshold for a in columns[:j])]


def drop_correlated(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95) -> DataFrame:
    return df.drop(*correlated(df, list(columns or numeric_columns(df)), threshold))


def scale(df: DataFrame, columns: Sequence[str], train: Column | None = None) -> DataFrame:
    """Zero mean and unit population std, both taken from the train part only."""
    part = df.where(train) if train is not None else df
    row = measure(part, **{f"{k}{i}": f(number(c)) for i, c in enumerate(columns) for k, f in (("a", F.avg), ("s", F.stddev_pop))})
    return df.withColumns({c: (number(c) - row[f"a{i}"]) / (row[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def transform_table(df: DataFrame, target: str, key: str, train: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode, filter and scale, with a step report; everything is fitted on the train part."""
    rows: list[tuple] = []
    out = df
    if target in text_columns(df):
        out, _ = label_encode(out, target)
        rows.append(("target", target, "label"))
    out, how = encode(out, target, key)
    rows += [("encode", c, h) for c, h in how.items()]
    part = out.where(train) if train is not None else out
    nums = numeric_columns(out, [target, key])
    flat = low_variance(part, nums)
    high = correlated(part, [c for c in nums if c not in flat])
    out = out.drop(*flat, *high)
    rows += [("low_variance", c, "dropped") for c in flat] + [("correlation", c, "dropped") for c in high]
    kept = [c for c in nums if c not in flat and c not in high]
    rows += [("scale", c, "standard") for c in kept]
    return scale(out, kept, train), report(df, rows, "step string, column string, action string")


def mean_filled(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The frame with a copy of each column in which nulls and NaN are the mean of the others, and the copies' names."""
    there = {c: F.nanvl(number(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    mean = df.agg(*[F.avg(there[c]).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    names = [f"_filled{i}" for i in range(len(columns))]
    return df.withColumns({n: F.coalesce(there[c], F.lit(mean[f"m{i}"] or 0.0)) for i, (n, c) in enumerate(zip(names, columns))}), names


def principal_components(df: DataFrame, columns: Sequence[str], keep: int | None = None) -> tuple[DataFrame, list[float], np.ndarray]:
    """Scores of the leading components of the scaled columns, their variance shares and loadings. Gaps count as the mean."""
    keep = keep or max(1, int(0.8 * len(columns)))
    data, filled = mean_filled(df, columns)
    data = VectorAssembler(inputCols=filled, outputCol="_raw").transform(data)
    data = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(data).transform(data)
    model = PCA(k=keep, inputCol="_scaled", outputCol="components").fit(data)
    return model.transform(data).drop("_raw", "_scaled", *filled), list(model.explainedVariance.toArray()), model.pc.toArray()


def pair_products(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    return df.withColumns({f"{a}_x_{b}": number(a) * number(b) for a, b in combinations(list(columns)[:limit], 2)})


def pair_ratios(df: DataFrame, columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """a / (|b| + 1e-8) and a - b for pairs of features (of the first ``limit``, if given)."""
    made = {}
    for a, b in combinations(list(columns)[:limit], 2):
        made |= {f"{a}_over_{b}": number(a) / (F.abs(number(b)) + 1e-8), f"{a}_minus_{b}": number(a) - number(b)}
    return df.withColumns(made)


def decile_bins(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return quantile_bins(df, columns, bins=10, min_distinct=0)


def best_features(df: DataFrame, columns: Sequence[str], target: str, classification: bool = True, keep: int | None = None) -> list[str]:
    """The k features with the highest F score against the target, over all rows with a target. Gaps count as the mean."""
    keep = keep or max(1, len(columns) // 2)
    data, filled = mean_filled(df.withColumn("_y", number(target)).where("_y is not null"), columns)
    data = VectorAssembler(inputCols=filled, outputCol="_f").transform(data)
    sel = UnivariateFeatureSelector(featuresCol="_f", labelCol="_y", outputCol="_o", selectionMode="numTopFeatures")
    sel = sel.setFeatureType("continuous").setLabelType("categorical" if classification else "continuous").setSelectionThreshold(keep)
    return [columns[i] for i in sorted(sel.fit(data).selectedFeatures)]


def yeo_johnson(y: Column, lam: float) -> Column:
    pos = F.log1p(y) if abs(lam) < 1e-9 else (F.power(y + 1, F.lit(lam)) - 1) / lam
    neg = -F.log1p(-y) if abs(lam - 2) < 1e-9 else -(F.power(1 - y, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(y >= 0, pos).otherwise(neg)


def inverse_yeo_johnson(y: Column, lam: float) -> Column:
    pos = F.exp(y) - 1 if lam == 0 else F.power(y * lam + 1, F.lit(1 / lam)) - 1
    neg = 1 - F.exp(-y) if lam == 2 else 1 - F.power(1 - (2 - lam) * y, F.lit(1 / (2 - lam)))
    return F.when(y >= 0, pos).otherwise(neg)


def box_cox(y: Column, lam: float) -> Column:
    return F.log(y) if abs(lam) < 1e-9 else (F.power(y, F.lit(lam)) - 1) / lam


def best_lambda(df: DataFrame, y: Column, transform, log_term: Column, rounds: int = 3) -> float:
    """Maximum-likelihood power by a refined grid; each round is one aggregate over all candidates."""
    lo, hi = -2.0, 4.0
    for _ in range(rounds):
        grid = [float(v) for v in np.linspace(lo, hi, 25)]
        row = measure(df, n=F.count(y), g=F.sum(log_term), **{f"v{i}": F.var_pop(transform(y, lam)) for i, lam in enumerate(grid)})
        score = [-0.5 * row["n"] * np.log(row[f"v{i}"]) + (lam - 1) * row["g"] if row[f"v{i}"] and np.isfinite(row[f"v{i}"]) else -np.inf for i, lam in enumerate(grid)]
        best = grid[int(np.argmax(score))]
        step = grid[1] - grid[0]
        lo, hi = best - step, best + step
    return best


def target_transforms(df: DataFrame, target: str) -> dict[str, tuple[Column, float | None]]:
    """The transforms that fit the range of the target, with the fitted power where there is one."""
    y = number(target)
    low = measure(df, lo=F.min(y))["lo"]
    out: dict[str, tuple[Column, float | None]] = {"none": (y, None)}
    if low > 0:
        lam = best_lambda(df, y, box_cox, F.log(y))
        out |= {"log": (F.log(y), None), "log1p": (F.log1p(y), None), "boxcox": (box_cox(y, lam), lam)}
    if low >= 0:
        out["sqrt"] = (F.sqrt(y), None)
    lam = best_lambda(df, y, yeo_johnson, F.signum(y) * F.log1p(F.abs(y)))
    out["yeojohnson"] = (yeo_johnson(y, lam), lam)
    return out


def target_shape(df: DataFrame, target: str) -> DataFrame:
    """Moments, population skew and kurtosis, normality, sign flags and advice."""
    y = number(target)
    r = measure(df, n=F.count(y), a=F.avg(y), s=F.stddev_pop(y), lo=F.min(y), hi=F.max(y), g=F.skewness(y), k=F.kurtosis(y), z=F.count_if(y == 0))
    p = float(np.exp(-k_squared(r["n"], r["g"], r["k"] + 3) / 2)) if r["n"] >= 20 else 0.0
    normal = p > 0.05 and abs(r["g"]) < 0.5
    advice = ("none" if normal else "log_or_boxcox" if abs(r["g"]) > 2 and r["lo"] > 0 else "sqrt_or_yeojohnson" if abs(r["g"]) > 1 else "marginal")
    return report(df, [(target, r["n"], half_up(r["a"]), half_up(r["s"]), half_up(r["lo"]), half_up(r["hi"]), half_up(r["g"]), half_up(r["k"]), half_up(p, 6), normal, r["lo"] < 0, r["z"] > 0, advice)],
                  "target string, n long, mean double, std double, min double, max double, skewness double, kurtosis double, p_value double, is_normal boolean, has_negatives boolean, has_zeros boolean, advice string")


def vif(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Variance inflation per column: the diagonal of the inverse correlation matrix, from one pass."""
    columns = list(columns or numeric_columns(df))
    found = pair_correlations(df, columns)
    m = np.eye(len(columns))
    for (a, b), r in found.items():
        i, j = columns.index(a), columns.index(b)
        m[i, j] = m[j, i] = r or 0.0
    values = np.diag(np.linalg.pinv(m, rcond=1e-10))
    rows = [(c, half_up(max(1.0, v)), "critical" if v > 1000 else "high" if v > 10 else "moderate" if v > 5 else "low") for c, v in zip(columns, values)]
    return report(df, rows, "column string, vif double, severity string")


def vif_without_worst(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same table after dropping the column with the highest value."""
    columns = list(columns or numeric_columns(df))
    worst = vif(df, columns).orderBy(F.desc("vif"), "column").first()["column"]
    return vif(df, [c for c in columns if c != worst]).withColumn("dropped", F.lit(worst))
