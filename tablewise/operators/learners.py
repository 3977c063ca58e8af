"""Training and comparing ``pyspark.ml`` learners on a prepared table (id, vec, features, label)."""

from __future__ import annotations

import itertools
import random
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException, SparkRuntimeException
from pyspark.ml.base import Estimator, Model
from pyspark.ml.feature import PCA, UnivariateFeatureSelector
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, OneVsRest, RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up, rounded, share
from tablewise.operators.anomalies import flag_top, isolation_scores
from tablewise.operators.evaluation import poisson_weight
from tablewise.operators.features import frequency_encode
from tablewise.operators.information import binned_edges
from tablewise.operators.measures import (
    ROWS_PER_TASK, bins_right_closed, col, distinct_counts, hash_uniform, measure, number, numeric_columns, report, text_columns,
)
from tablewise.operators.neighbors import knn
from tablewise.operators.transforms import label_encode

CLASSIFIERS: dict[str, Callable[..., Estimator]] = {
    "logistic": lambda **p: LogisticRegression(**{"regParam": 1e-4, "maxIter": 25, **p}),
    "tree": lambda **p: DecisionTreeClassifier(**{"maxDepth": 8, "seed": 42, **p}),
    "forest": lambda **p: RandomForestClassifier(**{"numTrees": 20, "maxDepth": 6, "seed": 42, **p}),
    "boosted": lambda **p: GBTClassifier(**{"maxIter": 10, "maxDepth": 4, "seed": 42, **p}),
    "boosted_deep": lambda **p: GBTClassifier(**{"maxIter": 20, "maxDepth": 6, "seed": 42, **p}),
    "bayes": lambda **p: NaiveBayes(**{"modelType": "gaussian", **p}),
    "svm": lambda **p: LinearSVC(**{"maxIter": 20, **p}),
}
REGRESSORS: dict[str, Callable[..., Estimator]] = {
    "linear": lambda **p: LinearRegression(**p),
    "ridge": lambda **p: LinearRegression(**{"regParam": 1.0, "elasticNetParam": 0.0, **p}),
    "lasso": lambda **p: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 1.0, **p}),
    "elastic": lambda **p: LinearRegression(**{"regParam": 0.1, "elasticNetParam": 0.5, **p}),
    "tree": lambda **p: DecisionTreeRegressor(**{"maxDepth": 8, "seed": 42, **p}),
    "forest": lambda **p: RandomForestRegressor(**{"numTrees": 20, "maxDepth": 6, "seed": 42, **p}),
    "boosted": lambda **p: GBTRegressor(**{"maxIter": 10, "maxDepth": 4, "seed": 42, **p}),
    "boosted_deep": lambda **p: GBTRegressor(**{"maxIter": 20, "maxDepth": 6, "seed": 42, **p}),
}
BINARY_ONLY = {"boosted", "boosted_deep", "svm"}


def make(name: str, problem: str, classes: int = 2, **params) -> Estimator:
    """A learner by name; binary learners are wrapped one-against-rest above two classes."""
    if problem != "classification":
        return REGRESSORS[name](**params)
    est = CLASSIFIERS[name](**params)
    return OneVsRest(classifier=est) if classes > 2 and name in BINARY_ONLY else est


def prepare(df: DataFrame, target: str, key: str, features: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(id, vec, features, label): text becomes codes (shares above 1000 values), missing or infinite becomes 0."""
    features = list(features or [c for c in numeric_columns(df, [target, key]) + text_columns(df, [target, key])])
    uniq = distinct_counts(df, [c for c in features if c in text_columns(df)])
    data = df
    for c, u in uniq.items():
        data = label_encode(data, c)[0] if u <= 1000 else frequency_encode(data, [c], replace=True)
    if target in text_columns(data):
        data, _ = label_encode(data, target)
    big = float("inf")
    clean = [F.coalesce(F.when(~F.isnan(number(c)) & (F.abs(number(c)) < big), number(c)), F.lit(0.0)) for c in features]
    out = data.where(col(target).isNotNull()).select(F.col(key).cast("long").alias("id"), F.array(*clean).alias("vec"), number(target).alias("label"))
    return out.withColumn("features", array_to_vector("vec")), features


def check(data: DataFrame, problem: str) -> list[str]:
    """Reasons not to train."""
    r = measure(data, n=F.count("*"), k=F.approx_count_distinct("label"))
    bad = ["fewer than 10 rows"] if r["n"] < 10 else []
    bad += ["one class"] if problem == "classification" and r["k"] < 2 else []
    bad += ["target looks continuous"] if problem == "classification" and r["k"] > 0.5 * r["n"] and r["n"] > 50 else []
    return bad


def with_vector(df: DataFrame, vec) -> DataFrame:
    return df.withColumn("vec", vec).withColumn("features", array_to_vector("vec"))


def score(pred: DataFrame, problem: str) -> float:
    """Accuracy, or R2."""
    if problem == "classification":
        return float(measure(pred, s=share(F.col("label") == F.col("prediction")))["s"])
    e = F.col("label") - F.col("prediction")
    r = measure(pred, m=F.avg(e * e), v=F.var_pop("label"))
    return 1 - r["m"] / r["v"] if r["v"] else 0.0


def class_weights(data: DataFrame) -> DataFrame:
    """Add ``weight``: n / (classes x class size)."""
    c = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}  # one row per class
    n = sum(c.values())
    table = F.create_map(*[x for k, v in c.items() for x in (F.lit(k), F.lit(n / (len(c) * v)))])
    return data.withColumn("weight", F.element_at(table, F.col("label")))


def split(data: DataFrame, test: float = 0.25, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    u = hash_uniform("id", seed)
    return data.where(u >= test), data.where(u < test)


def folded(data: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    return data.withColumn("fold", F.floor(hash_uniform("id", seed, 11) * folds).cast("int"))


def fold_scores(data: DataFrame, est: Estimator, problem: str, folds: int = 3, seed: int = 42, best: float | None = None) -> list[float]:
    """Score per fold; with ``best`` a model whose running mean is under 70% of it stops early."""
    data = folded(data, folds, seed).persist()
    out: list[float] = []
    try:
        for f in range(folds):
            out.append(score(est.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f)), problem))
            if best is not None and f >= 1 and best > 0 and np.mean(out) < 0.7 * best:
                break
    finally:
        data.unpersist()
    return out


def out_of_fold(data: DataFrame, est: Estimator, folds: int = 3, seed: int = 42) -> DataFrame:
    """Every row predicted by a model that has not seen it."""
    data = folded(data, folds, seed)
    parts = [est.fit(data.where(F.col("fold") != f)).transform(data.where(F.col("fold") == f)) for f in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def train_all(data: DataFrame, problem: str, names: Sequence[str], classes: int = 2) -> tuple[DataFrame, dict[str, Model]]:
    """Leaderboard (model, train and test score, error) and the fitted models; a table not fit for training is an error."""
    if bad := check(data, problem):
        raise ValueError("; ".join(bad))
    train, test = (p.persist() for p in split(data))
    rows, models = [], {}
    for name in names:
        try:
            m = make(name, problem, classes).fit(train)
            models[name] = m
            rows.append((name, half_up(score(m.transform(train), problem)), half_up(score(m.transform(test), problem)), None))
        except (IllegalArgumentException, Py4JJavaError, SparkRuntimeException) as e:  # a failing learner is a row of the result
            rows.append((name, None, None, str(e).splitlines()[0][:200]))
    train.unpersist(), test.unpersist()
    board = report(data, rows, "model string, train_score double, test_score double, error string")
    return board, models


def ranked(board: DataFrame) -> DataFrame:
    """Best first, failures last (one row per model)."""
    return board.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("test_score"), "model")))


def importance(model: Model, features: Sequence[str]) -> list[tuple[str, float]]:
    """Importance of every feature, scaled to the top one."""
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        v = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        v = np.abs(model.coefficients.toArray())
    else:
        return []
    top = max(float(np.max(v)), 1e-12)
    return sorted(((f, half_up(float(x) / top)) for f, x in zip(features, v)), key=lambda p: (-p[1], p[0]))


def nearest_predict(train: DataFrame, test: DataFrame, problem: str, k: int = 5) -> DataFrame:
    """Majority class or mean of the k nearest train rows."""
    near = knn(test.select("id", "vec"), train.select("id", "vec"), k)
    found = near.join(train.select(F.col("id").alias("neighbor"), F.col("label").alias("nl")), "neighbor")
    if problem == "classification":
        votes = found.groupBy("id", "nl").agg(F.count("*").alias("n"))
        pred = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("m"), "nl"))["nl"].alias("prediction"))
    else:
        pred = found.groupBy("id").agg(F.avg("nl").alias("prediction"))
    return test.join(pred, "id")


def qualify(data: DataFrame, problem: str, names: Sequence[str], keep: int = 5, sample: int = 5000, classes: int = 2) -> DataFrame:
    """The best learners by 3-fold score on a bounded sample."""
    n = data.count()
    part = data.where(hash_uniform("id", 5) < min(1.0, sample / n)).persist()
    rows = [(m, half_up(float(np.mean(fold_scores(part, make(m, problem, classes), problem))))) for m in names]
    part.unpersist()
    rows.sort(key=lambda r: -r[1])
    return report(data, [(*r, i < keep) for i, r in enumerate(rows)], "model string, score double, kept boolean")


def cross_validate(data: DataFrame, problem: str, names: Sequence[str], classes: int = 2, folds: int = 3) -> DataFrame:
    """Cross-validation with early abandon of weak learners."""
    best, rows = None, []
    for m in names:
        s = fold_scores(data, make(m, problem, classes), problem, folds, best=best)
        best = max(best or -1e9, float(np.mean(s)))
        rows.append((m, half_up(float(np.mean(s))), half_up(float(np.std(s))), len(s), len(s) < folds))
    return report(data, rows, "model string, mean double, std double, folds int, abandoned boolean")


def class_one(pred: DataFrame, problem: str):
    """The number a blend or stack uses: probability of class 1, or the prediction."""
    return vector_to_array("probability")[1] if problem == "classification" and "probability" in pred.columns else F.col("prediction")


def with_outputs(df: DataFrame, models: Sequence[Model], problem: str) -> DataFrame:
    """Columns ``m0, m1, ...`` (the number a blend uses) and ``p0, p1, ...`` (the prediction) of all models, added one after the other to the same rows."""
    for i, m in enumerate(models):
        pred = m.transform(df)
        df = pred.withColumns({f"m{i}": class_one(pred, problem).cast("double"), f"p{i}": F.col("prediction")}).drop("rawPrediction", "probability", "prediction")
    return df


def stack(data: DataFrame, problem: str, names: Sequence[str], folds: int = 3) -> DataFrame:
    """Out-of-fold base predictions into a logistic or ridge model; scores of all of them.

    Each row of a fold gets the outputs of all models that have not seen the fold in one go, so no rows are joined.
    """
    train, test = split(data)
    train = folded(train, folds).persist()
    fit = lambda part: [make(m, problem).fit(part) for m in names]
    parts = [with_outputs(train.where(F.col("fold") == f), fit(train.where(F.col("fold") != f)), problem) for f in range(folds)]
    cells = F.array(*[F.col(f"m{i}") for i in range(len(names))])
    meta = make("logistic" if problem == "classification" else "ridge", problem)
    fitted = meta.fit(with_vector(reduce(DataFrame.unionByName, parts), cells))
    out = with_outputs(test, fit(train), problem)
    out = fitted.transform(with_vector(out, cells)).persist()
    rows = [(m, half_up(score(out.drop("prediction").withColumnRenamed(f"p{i}", "prediction"), problem))) for i, m in enumerate(names)]
    rows.append(("stack", half_up(score(out, problem))))
    out.unpersist()
    train.unpersist()
    return report(data, rows, "model string, score double")


def blend(data: DataFrame, problem: str, names: Sequence[str], draws: int = 50, seed: int = 42) -> DataFrame:
    """Weighted blend: weights drawn at random, chosen on a validation part, scored on the test part."""
    train, rest = split(data, 0.4)
    valid, test = rest.where(hash_uniform("id", 77) < 0.5), rest.where(hash_uniform("id", 77) >= 0.5)
    rng = np.random.default_rng(seed)
    weights = rng.dirichlet(np.ones(len(names)), size=draws)
    fitted = [make(m, problem).fit(train) for m in names]

    def blended(w):
        return sum((F.col(f"m{i}") * float(x) for i, x in enumerate(w)), F.lit(0.0))

    def quality(w):
        b = blended(w)
        if problem == "classification":
            return share((b >= 0.5).cast("double") == F.col("label"))
        return 1 - F.avg((F.col("label") - b) * (F.col("label") - b)) / F.var_pop("label")

    v = measure(with_outputs(valid, fitted, problem), **{f"q{i}": quality(w) for i, w in enumerate(weights)})
    best = max(range(draws), key=lambda i: v[f"q{i}"])
    final = measure(with_outputs(test, fitted, problem), blend=quality(weights[best]), **{f"s{i}": quality(np.eye(len(names))[i]) for i in range(len(names))})
    rows = [(m, half_up(float(weights[best][i])), half_up(final[f"s{i}"])) for i, m in enumerate(names)] + [("blend", 1.0, half_up(final["blend"]))]
    return report(data, rows, "model string, weight double, score double")


def bagging(data: DataFrame, problem: str, name: str, bags: int = 5, seed: int = 42) -> DataFrame:
    """Bootstrap copies of one learner, majority or mean per row."""
    train, test = split(data)
    train = train.persist()
    alone = score(make(name, problem).fit(train).transform(test), problem)
    parts = []
    for b in range(bags):
        weight = poisson_weight(hash_uniform("id", seed, b))
        bag = train.withColumn("_w", weight).where("_w > 0").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("_w"))))
        parts.append(make(name, problem).fit(bag).transform(test).select("id", "label", "prediction"))
    votes = parts[0]
    for p in parts[1:]:
        votes = votes.union(p)
    if problem == "classification":
        counts = votes.groupBy("id", "label", "prediction").agg(F.count("*").alias("n"))
        pred = counts.groupBy("id", "label").agg(F.min(F.struct((-F.col("n")).alias("m"), "prediction"))["prediction"].alias("prediction"))
    else:
        pred = votes.groupBy("id", "label").agg(F.avg("prediction").alias("prediction"))
    return report(data, [("single", half_up(alone)), ("bagged", half_up(score(pred, problem)))], "model string, score double")


def seeds(data: DataFrame, problem: str, name: str, runs: int = 5) -> DataFrame:
    """The same learner over several seeds."""
    train, test = (p.persist() for p in split(data))
    s = [score(make(name, problem, seed=i).fit(train).transform(test), problem) for i in range(runs)]
    return report(data, [(runs, half_up(float(np.mean(s))), half_up(float(np.std(s))))], "runs int, mean double, std double")


# Parameter grids of the searches.
GRIDS = {
    "logistic": {"regParam": [0.0, 0.01, 0.1], "elasticNetParam": [0.0, 0.5]},
    "tree": {"maxDepth": [3, 6, 10], "minInstancesPerNode": [1, 5]},
    "forest": {"numTrees": [10, 30], "maxDepth": [4, 8]},
    "boosted": {"maxIter": [5, 15], "stepSize": [0.05, 0.1]},
    "ridge": {"regParam": [0.01, 0.1, 1.0, 10.0]},
    "lasso": {"regParam": [0.01, 0.1, 1.0]},
}


def grid(name: str) -> list[dict]:
    g = GRIDS[name]
    return [dict(zip(g, v)) for v in itertools.product(*g.values())]


def draws(name: str, n: int, seed: int = 42, deep: int = 10) -> list[dict]:
    """Random parameter maps; trees of up to ``deep`` levels."""
    rng = random.Random(seed)
    make_one = {
        "logistic": lambda: {"regParam": 10 ** rng.uniform(-4, 0), "elasticNetParam": rng.uniform(0, 1)},
        "tree": lambda: {"maxDepth": rng.randint(2, deep), "minInstancesPerNode": rng.randint(1, 10)},
        "forest": lambda: {"numTrees": rng.randint(5, 30), "maxDepth": rng.randint(3, deep)},
        "boosted": lambda: {"maxIter": rng.randint(5, 20), "stepSize": 10 ** rng.uniform(-2, -0.5)},
        "ridge": lambda: {"regParam": 10 ** rng.uniform(-3, 2)},
        "lasso": lambda: {"regParam": 10 ** rng.uniform(-3, 1)},
    }[name]
    return [make_one() for _ in range(n)]


def search(data: DataFrame, problem: str, name: str, trials: Sequence[Mapping], folds: int = 3) -> DataFrame:
    """Mean fold score of each parameter map."""
    data = data.persist()
    rows = [(name, ", ".join(f"{k}={half_up(v) if isinstance(v, float) else v}" for k, v in sorted(p.items())), half_up(float(np.mean(fold_scores(data, make(name, problem, **p), problem, folds))))) for p in trials]
    data.unpersist()
    return report(data, rows, "model string, params string, score double")


def tune(data: DataFrame, problem: str, names: Sequence[str], budget: int | None = None) -> DataFrame:
    """Search over the whole grid, or over ``budget`` random draws if given, and the gain over the defaults."""
    rows = []
    for m in names:
        trials = grid(m) if budget is None else draws(m, budget)
        base = float(np.mean(fold_scores(data, make(m, problem), problem)))
        best = search(data, problem, m, trials).orderBy(F.desc("score"), "params").first()
        rows.append((m, "grid" if budget is None else "random", half_up(base), best["score"], half_up(best["score"] - base), best["params"]))
    return report(data, rows, "model string, method string, before double, after double, gain double, params string")


def tournament(data: DataFrame, problem: str, names: Sequence[str], classes: int = 2) -> DataFrame:
    """Successive halving with growing samples; the last two meet on the test part."""
    train, test = split(data)
    alive, rows, frac, rnd = list(names), [], 0.25, 1
    while len(alive) > 2:
        part = train.where(hash_uniform("id", 31) < frac)
        s = {m: float(np.mean(fold_scores(part, make(m, problem, classes), problem, 3 if rnd == 1 else 5))) for m in alive}
        order = sorted(alive, key=lambda m: -s[m])
        cut = max(2, len(alive) // 2)
        rows += [(rnd, m, half_up(s[m]), i + 1, i < cut) for i, m in enumerate(order)]
        alive, frac, rnd = order[:cut], min(1.0, 2 * frac), rnd + 1
    s = {m: score(make(m, problem, classes).fit(train).transform(test), problem) for m in alive}
    order = sorted(alive, key=lambda m: -s[m])
    rows += [(rnd, m, half_up(s[m]), i + 1, i == 0) for i, m in enumerate(order)]
    return report(data, rows, "round int, model string, score double, rank int, advanced boolean")


def without_outliers(df: DataFrame, key: str, columns: Sequence[str], share_: float = 0.05, most: float = 0.2, trees: int = 100) -> DataFrame:
    """The rows but for the share with the highest isolation scores; refuses to drop more than ``most`` of them. Give it the train part."""
    marked = flag_top(isolation_scores(df, key, columns, trees=trees), share_)
    gone = measure(marked, s=share(F.col("flag") == 1))["s"] or 0.0
    if gone > most:
        raise ValueError(f"{100 * gone:.1f} % of the rows would go")
    return without(df, marked.where("flag = 1"), key)


def best_half(data: DataFrame, problem: str) -> DataFrame:
    """The vector cut to the half of its features (3 at least) with the highest F scores."""
    width = measure(data, w=F.max(F.size("vec")))["w"]
    kind = "categorical" if problem == "classification" else "continuous"
    pick = UnivariateFeatureSelector(featuresCol="features", labelCol="label", outputCol="_best", selectionMode="numTopFeatures")
    pick = pick.setFeatureType("continuous").setLabelType(kind).setSelectionThreshold(min(width, max(3, width // 2)))
    return with_vector(data, F.array(*[F.col("vec")[i] for i in sorted(pick.fit(data).selectedFeatures)]))


def with_deciles(data: DataFrame, bins: int = 10) -> DataFrame:
    """The vector with the quantile bin of every feature beside it."""
    width = measure(data, w=F.max(F.size("vec")))["w"]
    cells = {f"c{i}": F.col("vec")[i] for i in range(width)}
    edges = binned_edges(data, cells, bins)
    return with_vector(data, F.concat("vec", F.array(*[F.coalesce(bins_right_closed(c, edges[k]).cast("double"), F.lit(0.0)) for k, c in cells.items()])))


def improve(data: DataFrame, problem: str, name: str, misses: int = 3) -> DataFrame:
    """Try steps on the train part one after the other, keep those that raise the fold score, stop after 3 misses; a step that refuses is a miss without a score."""
    v = lambda i: F.col("vec")[i]

    def pairs(d):
        width = measure(d, w=F.max(F.size("vec")))["w"]
        return [(i, j) for i in range(width) for j in range(i + 1, width)]

    def outliers(d):
        names = [f"c{i}" for i in range(measure(d, w=F.max(F.size("vec")))["w"])]
        long = d.select("id", *[v(i).alias(c) for i, c in enumerate(names)])
        return d.join(without_outliers(long, "id", names, trees=50).select("id"), "id", "left_semi")

    steps = {
        "best_half": lambda d: best_half(d, problem),
        "products": lambda d: with_vector(d, F.concat("vec", F.array(*[v(i) * v(j) for i, j in pairs(d)]))),
        "squares": lambda d: with_vector(d, F.concat("vec", F.transform("vec", lambda x: x * x))),
        "outliers": outliers,
        "deciles": with_deciles,
        "ratios": lambda d: with_vector(d, F.concat("vec", F.array(*[v(i) / (F.abs(v(j)) + 1e-8) for i, j in pairs(d)], *[v(i) - v(j) for i, j in pairs(d)]))),
    }
    best = float(np.mean(fold_scores(data, make(name, problem), problem)))
    rows, missed = [("start", half_up(best), True)], 0
    for step, fn in steps.items():
        try:
            trial = fn(data)
            got = float(np.mean(fold_scores(trial, make(name, problem), problem)))
        except ValueError:
            trial, got = data, None
        ok = got is not None and got > best
        rows.append((step, None if got is None else half_up(got), ok))
        if ok:
            data, best = trial, got
        else:
            missed += 1
            if missed >= misses:
                break
    return report(data, rows, "step string, score double, kept boolean")


def feature_advice(width: int, importances: Sequence[tuple[str, float]], score_: float, problem: str, correlated: int) -> list[tuple[str, str, float]]:
    """Advice on the features: too few of them, one that dominates, none that says much, crossings, and components in place of more than two correlated ones."""
    total = sum(v for _, v in importances) or 1.0
    shares = sorted((v / total for _, v in importances), reverse=True)
    out: list[tuple[str, str, float]] = []
    if width < 5:
        out.append(("few_features", "products", float(width)))
    if len(shares) > 2 and shares[0] > 0.5:
        out.append(("dominant_feature", "products", half_up(shares[0])))
    if len(shares) > 5 and shares[0] < 0.1:
        out.append(("weak_features", "products", half_up(shares[0])))
    if score_ < (0.75 if problem == "classification" else 0.5) and width < 15:
        out.append(("cross_features", "products", half_up(score_)))
    elif width > 5 and sum(shares[:2]) > 0.6:
        out.append(("cross_top_features", "products", half_up(sum(shares[:2]))))
    if correlated > 2:
        out.append(("correlated_features", "components", float(correlated)))
    return out


def advice(data: DataFrame, board: DataFrame, problem: str, missing_pct: float = 0.0, importances: Sequence[tuple[str, float]] = (), folds: DataFrame | None = None, correlated: int = 0) -> DataFrame:
    """Retraining advice from the measures of a run: its leaderboard, feature importances, fold scores (as of ``cross_validate``) and the number of features dropped as correlated."""
    rows = board.where("test_score is not null").orderBy(F.desc("test_score"), "model").collect()  # one row per model
    best, out = rows[0], []
    if missing_pct > 20:
        out.append(("data_quality", "impute", half_up(missing_pct)))
    if problem == "classification":
        c = data.groupBy("label").count().agg(F.max("count").alias("hi"), F.min("count").alias("lo")).first()
        if c["hi"] > 3 * c["lo"]:
            out.append(("imbalance", "class_weights", half_up(c["hi"] / c["lo"])))
    gap = best["train_score"] - best["test_score"]
    if gap > 0.1:
        out.append(("overfitting", "regularise", half_up(gap)))
    elif best["test_score"] < 0.7:
        out.append(("underfitting", "larger_model", best["test_score"]))
    if len(rows) > 1 and best["test_score"] - rows[1]["test_score"] < 0.02:
        out.append(("close_models", "ensemble", half_up(best["test_score"] - rows[1]["test_score"])))
    out += feature_advice(measure(data, w=F.max(F.size("vec")))["w"] or 0, importances, best["test_score"], problem, correlated)
    if folds is not None:  # one row per model
        out += [(f"variance of {r['model']}", "regularise", r["std"]) for r in folds.where("std > 0.05").orderBy("model").collect()]
    if problem == "classification":
        out.append(("calibration", "calibrate", best["test_score"]))
    return report(data, out, "finding string, action string, value double")


def retrain(data: DataFrame, problem: str, name: str, actions: Sequence[str]) -> DataFrame:
    """Before and after applying the advice."""
    train, test = (p.persist() for p in split(data))
    before = score(make(name, problem).fit(train).transform(test), problem)
    params: dict = {}
    tr, te = train, test
    if "class_weights" in actions:
        tr, params["weightCol"] = class_weights(tr), "weight"
    if "products" in actions:
        width = measure(train, w=F.max(F.size("vec")))["w"]
        cells = F.concat("vec", F.array(*[F.col("vec")[i] * F.col("vec")[j] for i in range(width) for j in range(i + 1, width)]))
        tr, te = with_vector(tr, cells), with_vector(te, cells)
    if "components" in actions:
        width = measure(tr, w=F.max(F.size("vec")))["w"]
        found = PCA(k=min(width, max(5, int(0.8 * width))), inputCol="features", outputCol="_parts").fit(tr)
        tr, te = (with_vector(found.transform(p), vector_to_array("_parts")).drop("_parts") for p in (tr, te))
    if "regularise" in actions:
        params |= {"maxDepth": 4} if name in ("tree", "forest", "boosted") else {"regParam": 0.1}
    if "larger_model" in actions and name == "forest":
        params |= {"numTrees": 60, "maxDepth": 10}
    after = score(make(name, problem, **params).fit(tr).transform(te), problem)
    return report(data, [(name, ",".join(actions), half_up(before), half_up(after), half_up(after - before))], "model string, actions string, before double, after double, change double")


def label_errors(data: DataFrame, name: str = "forest", folds: int = 3, threshold: float = 0.5) -> DataFrame:
    """Rows whose out-of-fold class differs, surely, from the given label."""
    pred = out_of_fold(data, make(name, "classification"), folds).withColumn("p", vector_to_array("probability"))
    given = F.col("p")[F.col("label").cast("int")]
    return pred.where((F.col("prediction") != F.col("label")) & (F.array_max("p") > threshold) & (given < threshold)).select(
        "id", "label", "prediction", rounded(F.array_max("p")).alias("confidence"), rounded(given).alias("given_p"))


def without(df: DataFrame, flagged: DataFrame, key: str, flagged_key: str = "id") -> DataFrame:
    """Remove flagged rows by key."""
    return df.join(flagged.select(F.col(flagged_key).alias(key)).distinct(), key, "left_anti")


def shuffled(data: DataFrame, repeat: int, seed: int = 42) -> DataFrame:
    """Add ``other``: the vector of another row, as one cycle through each hash slice of the table."""
    rows = data.count()
    slices = max(1, -(-rows // ROWS_PER_TASK))
    d = data.withColumn("_u", hash_uniform("id", seed, repeat)).withColumn("_s", F.floor(F.col("_u") * slices))
    w = Window.partitionBy("_s").orderBy("_u", "id")
    last = F.last("vec").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.withColumn("other", F.coalesce(F.lag("vec", 1).over(w), last)).drop("_u", "_s")


def permutation_importance(data: DataFrame, model: Model, problem: str, features: Sequence[str], repeats: int = 3) -> DataFrame:
    """Score drop when one column is shuffled: all columns of a repeat are scored in one pass."""
    base = score(model.transform(data), problem)
    drops: dict[str, list[float]] = {f: [] for f in features}
    for r in range(repeats):
        copies = shuffled(data.select("id", "label", "vec"), r).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
        mixed = F.transform("vec", lambda x, i: F.when(i == F.col("j"), F.col("other")[i]).otherwise(x))
        pred = model.transform(with_vector(copies, mixed))
        e = F.col("label") - F.col("prediction")
        q = share(F.col("label") == F.col("prediction")) if problem == "classification" else 1 - F.avg(e * e) / F.var_pop("label")
        for row in pred.groupBy("j").agg(q.alias("s")).collect():  # one row per feature
            drops[features[row["j"]]].append(base - row["s"])
    rows = sorted(((f, half_up(float(np.mean(v))), half_up(float(np.std(v)))) for f, v in drops.items()), key=lambda r: (-r[1], r[0]))
    return report(data, [(*r, i < 3 or r[1] > 0.001) for i, r in enumerate(rows)], "feature string, drop double, std double, keep boolean")


def select_and_refit(data: DataFrame, problem: str, name: str, features: Sequence[str]) -> DataFrame:
    """Drop features without importance, refit, compare."""
    train, test = (p.persist() for p in split(data))
    model = make(name, problem).fit(train)
    kept = [r["feature"] for r in permutation_importance(test, model, problem, features).where("keep").collect()]
    cells = F.array(*[F.col("vec")[list(features).index(f)] for f in kept])
    after = score(make(name, problem).fit(with_vector(train, cells)).transform(with_vector(test, cells)), problem)
    return report(data, [(len(features), len(kept), half_up(score(model.transform(test), problem)), half_up(after))], "features_before int, features_after int, before double, after double")


def compress(data: DataFrame, problem: str, name: str, features: Sequence[str]) -> DataFrame:
    """Smaller models: half the features, and a depth-5 tree taught by the larger model."""
    train, test = (p.persist() for p in split(data))
    teacher = make(name, problem).fit(train)
    base = score(teacher.transform(test), problem)
    top = [f for f, _ in importance(teacher, features)][: max(1, len(features) // 2)]
    cells = F.array(*[F.col("vec")[list(features).index(f)] for f in top])
    half = score(make(name, problem).fit(with_vector(train, cells)).transform(with_vector(test, cells)), problem)
    taught = teacher.transform(train).select("id", "vec", "features", F.col("prediction").alias("label"))
    student = score(make("tree", problem, maxDepth=5).fit(taught).transform(test), problem)
    rows = [("teacher", len(features), half_up(base), True), ("half_features", len(top), half_up(half), half > 0.9 * base), ("student_tree", len(features), half_up(student), student > 0.9 * base)]
    return report(data, rows, "variant string, features int, score double, acceptable boolean")


def parameters(model: Model) -> int:
    """Nodes of a tree model, or numbers of a linear one."""
    if hasattr(model, "totalNumNodes"):
        return int(model.totalNumNodes)
    if hasattr(model, "numNodes"):
        return int(model.numNodes)
    return int(getattr(model, "numFeatures", 0)) + 1


def complexity(data: DataFrame, problem: str, models: Mapping[str, Model]) -> DataFrame:
    """Size against score; the smallest model within 97% of the best is the best value."""
    _, test = split(data)
    rows = [(m, parameters(f), score(f.transform(test), problem)) for m, f in models.items()]
    top = max(r[2] for r in rows)
    value = min((r for r in rows if r[2] >= 0.97 * top), key=lambda r: (r[1], r[0]))[0]
    return report(data, [(m, n, "simple" if n < 100 else "moderate" if n < 1000 else "complex", half_up(s), m == value) for m, n, s in rows],
                  "model string, parameters long, size string, score double, best_value boolean")
