"""Evaluation of a predictions table: key, label, prediction, probability, and for many models a model column."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import bias_corrected_skew, half_up, rounded, share
from tablewise.functions.tails import normal_quantile
from tablewise.operators.information import binned_edges
from tablewise.operators.measures import (
    bins_right_closed, col, frequencies, hash_uniform, histogram, measure, number, positions, quantiles,
    report, running_sums, top_values,
)
from tablewise.operators.profile import kind_of


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def per_class(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    c = confusion(df, label, prediction).persist()
    try:
        hit = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
        real = c.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), hit.alias("tp"))
        said = c.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("said"))
        p = F.coalesce(F.try_divide(F.col("tp"), F.col("said")), F.lit(0.0))
        r = F.coalesce(F.try_divide(F.col("tp"), F.col("support")), F.lit(0.0))
        both = real.join(said, "class", "full").fillna(0, ["support", "tp", "said"])
        out = both.select("class", p.alias("p"), r.alias("r"), "support").collect()  # one row per class
    finally:
        c.unpersist()
    kind = dict(df.dtypes)[label]
    rows = [(x["class"], half_up(x["p"]), half_up(x["r"]), half_up(2 * x["p"] * x["r"] / (x["p"] + x["r"]) if x["p"] + x["r"] else 0.0), x["support"]) for x in out]
    return report(df, rows, f"class {kind}, precision double, recall double, f1 double, support long")


def score_counts(df: DataFrame, by: Sequence[str], label: str, score: str, positive) -> DataFrame:
    """Positives and negatives per distinct score: the only input the curves need."""
    return df.groupBy(*by, number(score).alias("score")).agg(
        F.count_if(col(label) == positive).alias("pos"), F.count_if(col(label) != positive).alias("neg"))


def curve(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "prob", positive=1) -> DataFrame:
    """Cumulative counts and rates from the highest score down: one row per distinct score."""
    c = score_counts(df, by, label, score, positive)
    totals = c.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = running_sums(c, list(by), "score", {"tp": "pos", "fp": "neg"}, descending=True)
    if by:
        cum = cum.join(totals, list(by))
    else:
        t = totals.first()
        cum = cum.withColumns({"P": F.lit(t["P"]).cast("long"), "N": F.lit(t["N"]).cast("long")})
    return cum.select(*by, "score", "pos", "neg", "tp", "fp", "P", "N", F.try_divide("fp", "N").alias("fpr"), F.try_divide("tp", "P").alias("tpr"),
                      (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by trapezoids, as a sum over the distinct scores."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0)) / F.max(F.col("P").cast("double") * F.col("N"))  # the product fits no integer
    return points.groupBy(*by).agg(rounded(area).alias("auc"))


def average_precision(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by).agg(rounded(F.sum(F.col("pos") / F.col("P") * F.col("precision"))).alias("average_precision"))


def one_against_rest(df: DataFrame, label: str, probabilities: dict) -> DataFrame:
    """AUC of each class against the others, all classes in one pass; ``probabilities`` maps a class to its score column."""
    cells = F.array(*[F.struct(F.lit(str(k)).alias("class"), (col(label) == k).alias("hit"), number(c).alias("score")) for k, c in probabilities.items()])
    long = df.select(F.explode(cells).alias("x")).select("x.*")
    return roc_auc(curve(long, ["class"], "hit", "score", True), ["class"])


def thin(points: DataFrame, order: str, n: int, by: Sequence[str] = ()) -> DataFrame:
    """Keep n evenly spaced rows of a curve, both ends included."""
    data = positions(points, list(by), order, "_pos")
    size = data.groupBy(*by).agg(F.max("_pos").alias("_last"))
    data = data.join(size, list(by)) if by else data.withColumn("_last", F.lit(size.first()["_last"]))
    i = F.ceil(F.col("_pos") * (n - 1) / F.greatest(F.col("_last"), F.lit(1)))
    keep = (F.col("_last") < n) | (F.floor(i * F.col("_last") / (n - 1)) == F.col("_pos"))
    return data.where(keep).drop("_pos", "_last")


def residuals(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    e = number(label) - number(prediction)
    return df.agg(rounded(F.avg(e)).alias("mean"), rounded(F.stddev_pop(e)).alias("std"), rounded(bias_corrected_skew(e)).alias("skew"), F.count(e).alias("n"))


def residual_histogram(df: DataFrame, label: str = "label", prediction: str = "prediction", bins: int = 30) -> DataFrame:
    data = df.select((number(label) - number(prediction)).alias("residual"))
    row = measure(data, lo=F.min("residual"), hi=F.max("residual"))
    return histogram(data, {"residual": (row["lo"], row["hi"], bins)}).drop("column")


def qq_points(df: DataFrame, label: str = "label", prediction: str = "prediction", n: int = 100) -> DataFrame:
    """Observed residual order statistics against normal quantiles at up to n evenly spaced ranks."""
    data = df.select((number(label) - number(prediction)).alias("r"))
    total = measure(data, n=F.count("r"))["n"]
    ranks = sorted({int(i * (total - 1) / (n - 1)) for i in range(n)}) if total > n else list(range(total))
    seen = quantiles(data, ["r"], [k / max(1, total - 1) for k in ranks])["r"]
    rows = [(k, half_up(normal_quantile((k + 0.5) / total)), half_up(v)) for k, v in zip(ranks, seen)]
    return report(df, rows, "rank int, theoretical double, observed double")


def calibration(df: DataFrame, label: str = "label", prob: str = "prob", bins: int = 10) -> DataFrame:
    """Observed and predicted positive share per equal-width probability bin."""
    b = F.least(F.floor(number(prob) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(number(label)).alias("observed"), F.avg(number(prob)).alias("predicted"))


def calibration_summary(df: DataFrame, label: str = "label", prob: str = "prob", bins: int = 10) -> DataFrame:
    """Expected calibration error, Brier score, reliability and badge."""
    curve_ = calibration(df, label, prob, bins)
    ece = curve_.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("e")).first()["e"]
    brier = measure(df, b=F.avg((number(prob) - number(label)) * (number(prob) - number(label))))["b"]
    badge = "excellent" if ece < 0.03 else "good" if ece < 0.07 else "fair" if ece < 0.15 else "poor"
    return report(df, [(half_up(ece), half_up(brier), ece < 0.05, float(max(0, round(100 - ece * 1000))), badge)],
                  "ece double, brier double, well_calibrated boolean, reliability double, badge string")


def is_right(label: str, prediction: str, classification: bool, spread: float = 1.0, tolerance: float = 0.1) -> Column:
    if classification:
        return (col(label) == col(prediction)).cast("double")
    return (F.abs(number(label) - number(prediction)) / max(spread, 1e-8) < tolerance).cast("double")


def label_spread(df: DataFrame, label: str) -> float:
    r = measure(df, lo=F.min(number(label)), hi=F.max(number(label)))
    return max(r["hi"] - r["lo"], 1e-8)


def fold_stability(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction", classification: bool = True) -> DataFrame:
    """Share of repeated out-of-fold predictions that are right per row, and its band."""
    right = is_right(label, prediction, classification, 1.0 if classification else label_spread(df, label))
    s = F.col("stability")
    return df.groupBy(key).agg(F.avg(right).alias("stability"), F.count("*").alias("tests")).select(
        key, rounded(s).alias("stability"), "tests",
        F.when(s >= 0.8, "stable_correct").when(s >= 0.5, "unstable").when(s > 0, "mostly_wrong").otherwise("stable_incorrect").alias("band"))


def difficulty_band(s: Column) -> Column:
    return F.when(s >= 0.8, "easy").when(s >= 0.5, "medium").when(s >= 0.2, "hard").otherwise("very_hard")


def majority(df: DataFrame, key: str, prediction: str) -> DataFrame:
    """Most frequent prediction per key, lowest on ties."""
    votes = df.groupBy(key, col(prediction).alias("p")).agg(F.count("*").alias("n"))
    best = votes.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), "p")).alias("b"), F.sum("n").alias("votes"))
    return best.select(key, F.col("b.p").alias("majority"), (-F.col("b.m")).alias("agreeing"), "votes")


def difficulty(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of the models that are right per row, with the majority prediction."""
    s = df.groupBy(key).agg(F.avg(is_right(label, prediction, True)).alias("s"), F.sum(is_right(label, prediction, True)).cast("long").alias("right"), F.count("*").alias("models"))
    return s.join(majority(df, key, prediction).select(key, "majority"), key).select(
        key, rounded(F.col("s")).alias("score"), "right", "models", "majority", difficulty_band(F.col("s")).alias("band"))


def regression_difficulty(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """1 - mean absolute error over its 95th percentile, clipped to 0..1."""
    e = df.groupBy(key).agg(F.avg(F.abs(number(label) - number(prediction))).alias("e")).persist()
    top = max(quantiles(e, ["e"], [0.95])["e"][0] or 0.0, 1e-6)
    s = 1.0 - F.least(F.col("e") / top, F.lit(1.0))
    return e.select(key, rounded(s).alias("score"), difficulty_band(s).alias("band"))


def suspected_labels(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Rows that no model gets right, with at least 3 models."""
    s = df.groupBy(key).agg(F.count_if(col(label) == col(prediction)).alias("right"), F.count("*").alias("models"), F.max(col(label)).alias("label"))
    return s.where("right = 0 and models >= 3").join(majority(df, key, prediction).select(key, "majority"), key).select(key, "label", "majority")


def contrast(df: DataFrame, flag: Column, columns: Sequence[str], other: Column | None = None, least: float = 0.5) -> DataFrame:
    """Numeric columns whose mean differs between two sets of rows by more than ``least`` stds."""
    other = ~flag if other is None else other
    exprs = {}
    for i, c in enumerate(columns):
        exprs |= {f"h{i}": F.avg(F.when(flag, number(c))), f"e{i}": F.avg(F.when(other, number(c))), f"s{i}": F.stddev_samp(number(c))}
    row = measure(df, **exprs)
    rows = []
    for i, c in enumerate(columns):
        h, e, s = row[f"h{i}"], row[f"e{i}"], row[f"s{i}"]
        if h is None or e is None or not s or s < 1e-8:
            continue
        effect = abs(h - e) / s
        if effect > least:
            rows.append((c, half_up(h), half_up(e), half_up(effect), "higher" if h > e else "lower"))
    return report(df, rows, "feature string, hard_mean double, easy_mean double, effect double, direction string")


def wide_predictions(df: DataFrame, key: str, models: Sequence, model: str = "model", prediction: str = "prediction") -> DataFrame:
    """One row per key with one prediction column per model (no self-join)."""
    return df.groupBy(key).agg(*[F.max(F.when(col(model) == m, col(prediction))).alias(f"p{i}") for i, m in enumerate(models)])


def disagreement(df: DataFrame, key: str, models: Sequence, classification: bool = True, label: str = "label", model: str = "model", prediction: str = "prediction") -> DataFrame:
    """Share of rows where two models differ, per pair."""
    spread = 1.0 if classification else label_spread(df, label)
    w = wide_predictions(df, key, models, model, prediction)
    pairs = [(i, j) for i in range(len(models)) for j in range(i + 1, len(models))]

    def differs(i, j):
        a, b = F.col(f"p{i}"), F.col(f"p{j}")
        return (a != b) if classification else F.abs(a - b) / spread > 0.1

    row = measure(w, **{f"d{i}_{j}": share(differs(i, j)) for i, j in pairs})
    return report(df, [(str(models[i]), str(models[j]), half_up(100 * row[f"d{i}_{j}"], 1)) for i, j in pairs], "model_a string, model_b string, disagreement_pct double")


def most_contrary(pairs: DataFrame) -> DataFrame:
    """Mean disagreement of each model with the others, highest first."""
    long = pairs.select(F.col("model_a").alias("model"), "disagreement_pct").union(pairs.select("model_b", "disagreement_pct"))
    return long.groupBy("model").agg(rounded(F.avg("disagreement_pct"), 2).alias("mean_pct"))


def consensus_zones(df: DataFrame, key: str, prediction: str = "prediction") -> DataFrame:
    """Rows by the vote share of their top prediction."""
    share_ = F.col("agreeing") / F.col("votes")
    zone = F.when(share_ >= 0.8, "high_trust").when(share_ >= 0.5, "medium_trust").otherwise("danger_zone")
    return majority(df, key, prediction).withColumn("consensus", share_).withColumn("zone", zone)


def zone_summary(zones: DataFrame) -> DataFrame:
    n = zones.count()
    return zones.groupBy("zone").agg(F.count("*").alias("n")).withColumn("pct", F.round(100.0 * F.col("n") / n, 1))


def class_bands(df: DataFrame, key: str, prediction: str = "prediction", prob: str = "prob") -> DataFrame:
    """Majority class, vote share, mean probability and reliability per row."""
    p = df.groupBy(key).agg(F.avg(number(prob)).alias("p"))
    a = F.col("agreeing") / F.col("votes")
    return majority(df, key, prediction).join(p, key).select(
        key, F.col("majority").alias("point"), rounded(a).alias("agreement"), rounded(F.greatest(F.col("p"), 1 - F.col("p"))).alias("confidence"),
        F.when(a >= 0.8, "HIGH").when(a >= 0.5, "MEDIUM").otherwise("LOW").alias("reliability"))


def regression_bands(df: DataFrame, key: str, prediction: str = "prediction", places: int = 4) -> DataFrame:
    """Mean +- 2 population stds over the models, and reliability against the range of all predictions."""
    r = measure(df, lo=F.min(number(prediction)), hi=F.max(number(prediction)))
    spread = (r["hi"] - r["lo"]) or 1.0
    m, s = F.col("m"), F.col("s")
    a = F.greatest(F.lit(0.0), 1 - s / spread * 3)
    return df.groupBy(key).agg(F.avg(number(prediction)).alias("m"), F.stddev_pop(number(prediction)).alias("s")).select(
        key, rounded(m, places).alias("point"), rounded(m - 2 * s, places).alias("lower"), rounded(m + 2 * s, places).alias("upper"), rounded(a, places).alias("agreement"),
        F.when(a >= 0.7, "HIGH").when(a >= 0.4, "MEDIUM").otherwise("LOW").alias("reliability"))


def conformal_margin(df: DataFrame, label: str = "label", prediction: str = "prediction", confidence: float = 0.95) -> float:
    """Half width of a split-conformal interval from a calibration part."""
    return conformal_quantile(df, F.abs(number(label) - number(prediction)), confidence)


def conformal_threshold(df: DataFrame, label: str = "label", prob: str = "prob", confidence: float = 0.95) -> float:
    """Threshold on 1 - p[label] from a calibration part; ``prob`` is the probability of class 1."""
    return conformal_quantile(df, F.when(col(label) == 1, 1 - number(prob)).otherwise(number(prob)), confidence)


def conformal_quantile(df: DataFrame, score: Column, confidence: float) -> float:
    n = measure(df, n=F.count(score))["n"]
    level = min(math.ceil(round((n + 1) * confidence, 9)) / n, 1.0)
    return quantiles(df, {"s": score}, [level])["s"][0]


def conformal_intervals(df: DataFrame, margin: float, prediction: str = "prediction") -> DataFrame:
    return df.withColumns({"lower": number(prediction) - margin, "upper": number(prediction) + margin})


def conformal_sets(df: DataFrame, threshold: float, prob: str = "prob") -> DataFrame:
    """Classes whose probability passes the threshold, at least the most likely one."""
    p1 = number(prob)
    kept = F.array_compact(F.array(F.when(p1 <= threshold, 0), F.when(1 - p1 <= threshold, 1)))
    return df.withColumn("classes", F.when(F.size(kept) == 0, F.array(F.when(p1 >= 0.5, 1).otherwise(0))).otherwise(kept))


def set_summary(sets: DataFrame) -> DataFrame:
    return sets.agg(rounded(F.avg(F.size("classes")), 4).alias("mean_size"), rounded(100 * share(F.size("classes") == 1), 1).alias("single_pct"))


def slices(df: DataFrame, features: Sequence[str], label: str = "label", prediction: str = "prediction", classification: bool = True, values: int = 10) -> DataFrame:
    """(feature, slice, n, score, gap): quartile bins of numeric and the most frequent values of text features."""
    nums = [c for c in features if kind_of(df, c) == "numeric"]
    texts = [c for c in features if c not in nums]
    edges = binned_edges(df, {c: number(c) for c in nums}, 4)
    known: dict[str, list[str]] = {c: [] for c in texts}
    for r in top_values(frequencies(df, texts), values).collect() if texts else []:  # at most ``values`` per column
        known[r["column"]].append(r["value"])
    cells = [F.struct(F.lit(c).alias("feature"), F.concat(F.lit("q"), (bins_right_closed(number(c), edges[c]) + 1).cast("string")).alias("slice")) for c in nums]
    cells += [F.struct(F.lit(c).alias("feature"), F.when(col(c).isin(known[c]), col(c)).alias("slice")) for c in texts]
    y, p = number(label), number(prediction)
    long = df.select(y.alias("y"), p.alias("p"), F.explode(F.array(*cells)).alias("x")).select("y", "p", "x.*").where("slice is not null")

    def score():
        if classification:
            return F.avg((F.col("y") == F.col("p")).cast("double"))
        return 1 - F.try_divide(F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p"))), F.var_pop("y") * F.count("y"))

    overall = df.select(y.alias("y"), p.alias("p")).agg(score().alias("s")).first()["s"]
    return long.groupBy("feature", "slice").agg(F.count("*").alias("n"), score().alias("s")).where("n >= 10").select(
        "feature", "slice", "n", rounded(F.col("s")).alias("score"), rounded(F.col("s") - overall).alias("gap"))


def worst_and_best(found: DataFrame, n: int = 10) -> DataFrame:
    worst = found.orderBy("score", "feature", "slice").limit(n).withColumn("side", F.lit("worst"))
    return worst.union(found.orderBy(F.desc("score"), "feature", "slice").limit(n).withColumn("side", F.lit("best")))


def prescriptions(train: DataFrame, test: DataFrame, features: Sequence[str], label: str = "label", prediction: str = "prediction", limit: int | None = None) -> DataFrame:
    """What data to collect, ranked by impact: weak slices, weak classes, rows out of the train range, volume; the first ``limit`` if given."""
    n = test.count()
    overall = measure(test, a=share(col(label) == col(prediction)))["a"]
    rows = [("subgroup", f"{r['feature']}={r['slice']}", r["score"], half_up(-r["gap"] * r["n"] / n)) for r in slices(test, features, label, prediction).where("gap < -0.08").collect()]
    classes = test.groupBy(col(label).alias("c")).agg(F.count("*").alias("n"), F.avg((col(label) == col(prediction)).cast("double")).alias("r")).where("n >= 3 and r < 0.7")
    rows += [("class", str(r["c"]), half_up(r["r"]), half_up((0.8 - r["r"]) * r["n"] / n)) for r in classes.collect()]
    nums = [c for c in features if kind_of(test, c) == "numeric"]
    if nums:
        b = measure(train, **{f"{k}{i}": f(number(c)) for i, c in enumerate(nums) for k, f in (("lo", F.min), ("hi", F.max))})
        out = {c: (number(c) < b[f"lo{i}"]) | (number(c) > b[f"hi{i}"]) for i, c in enumerate(nums)}
        m = measure(test, **{f"n{i}": F.count_if(out[c]) for i, c in enumerate(nums)}, **{f"s{i}": F.avg(F.when(out[c], (col(label) == col(prediction)).cast("double"))) for i, c in enumerate(nums)})
        rows += [("coverage", c, half_up(m[f"s{i}"]), half_up(0.05 * m[f"n{i}"] / n)) for i, c in enumerate(nums) if m[f"n{i}"] >= 5]
    n_train = train.count()
    if overall < 0.85 and n_train < 5000:
        rows.append(("volume", str(3 * n_train), half_up(overall), 0.02))
    rows.sort(key=lambda r: (-r[3], r[0], r[1]))
    return report(test, rows[:limit], "kind string, what string, score double, impact double")


def boundary_rows(df: DataFrame, prob: str = "prob", label: str = "label", prediction: str = "prediction", cut: float = 0.6) -> DataFrame:
    """Share and accuracy of the rows whose top probability is below the cut."""
    near = F.greatest(number(prob), 1 - number(prob)) < cut
    return df.agg(F.count_if(near).alias("near"), rounded(100 * share(near), 2).alias("near_pct"),
                  rounded(F.avg(F.when(near, (col(label) == col(prediction)).cast("double")))).alias("accuracy"))


def poisson_weight(u: Column) -> Column:
    """Poisson(1) draw from a uniform number: the bootstrap weight of a row."""
    total, out = 0.0, F.lit(8)
    steps = []
    for k in range(8):
        total += math.exp(-1) / math.factorial(k)
        steps.append((k, total))
    for k, edge in reversed(steps):
        out = F.when(u < edge, k).otherwise(out)
    return out


def bootstrap_scores(df: DataFrame, key: str, label: str = "label", prediction: str = "prediction", draws: int = 20, seed: int = 42) -> DataFrame:
    """Accuracy of each bootstrap draw; all draws in one aggregate, weights from the row key."""
    right = (col(label) == col(prediction)).cast("double")
    exprs = {}
    for d in range(draws):
        w = poisson_weight(hash_uniform(key, seed, d))
        exprs |= {f"w{d}": F.sum(w), f"s{d}": F.sum(w * right)}
    row = measure(df, **exprs)
    return report(df, [(d, half_up(row[f"s{d}"] / row[f"w{d}"])) for d in range(draws)], "draw int, score double")


def bootstrap_spread(scores: DataFrame) -> DataFrame:
    s = scores.agg(rounded(F.avg("score")).alias("mean"), rounded(F.stddev_pop("score")).alias("std"))
    return s.withColumn("grade", F.when(F.col("std") < 0.01, "very_stable").when(F.col("std") < 0.03, "stable").when(F.col("std") < 0.06, "moderate").otherwise("unstable"))


def classification_measures(df: DataFrame, label: str = "label", prediction: str = "prediction", prob: str | None = "prob") -> DataFrame:
    """Accuracy, support-weighted precision, recall and F1, and AUC of a binary score."""
    raw = confusion(df, label, prediction).collect()  # classes squared
    n = sum(r["n"] for r in raw)
    classes = {r["label"] for r in raw} | {r["prediction"] for r in raw}
    p = r_ = f1 = 0.0
    for k in classes:
        tp = sum(r["n"] for r in raw if r["label"] == k and r["prediction"] == k)
        said, real = sum(r["n"] for r in raw if r["prediction"] == k), sum(r["n"] for r in raw if r["label"] == k)
        pk, rk = tp / said if said else 0.0, tp / real if real else 0.0
        p, r_ = p + pk * real / n, r_ + rk * real / n
        f1 += (2 * pk * rk / (pk + rk) if pk + rk else 0.0) * real / n
    acc = sum(r["n"] for r in raw if r["label"] == r["prediction"]) / n
    auc = roc_auc(curve(df, (), label, prob)).first()["auc"] if prob else None
    return report(df, [(half_up(acc), half_up(p), half_up(r_), half_up(f1), auc)], "accuracy double, precision double, recall double, f1 double, auc double")


def regression_measures(df: DataFrame, label: str = "label", prediction: str = "prediction", features: int = 1) -> DataFrame:
    """mae, mse, rmse, r2, mape, largest error, adjusted r2, explained variance in one aggregate."""
    y, e = number(label), number(label) - number(prediction)
    r = measure(df, n=F.count(y), mae=F.avg(F.abs(e)), mse=F.avg(e * e), v=F.var_pop(y), ev=F.var_pop(e), top=F.max(F.abs(e)), mape=F.avg(F.when(y != 0, F.abs(e / F.nullif(y, F.lit(0.0))))))
    r2 = 1 - r["mse"] / r["v"] if r["v"] else 0.0
    adj = 1 - (1 - r2) * (r["n"] - 1) / max(1, r["n"] - features - 1)
    return report(df, [(half_up(r["mae"]), half_up(r["mse"], 2), half_up(r["mse"] ** 0.5), half_up(r2), half_up(100 * (r["mape"] or 0.0)), half_up(r["top"]), half_up(adj), half_up(1 - r["ev"] / r["v"] if r["v"] else 0.0))],
                  "mae double, mse double, rmse double, r2 double, mape double, max_error double, adjusted_r2 double, explained_variance double")
