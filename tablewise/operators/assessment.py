"""Evaluation that needs fitted models: calibration, learning curves, data value, stress, shelf life, scoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.base import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import half_up, rounded
from tablewise.operators.drift import ks, score_drop
from tablewise.operators.evaluation import bootstrap_scores, bootstrap_spread, calibration
from tablewise.operators.explain import vector_stats
from tablewise.operators.learners import fold_scores, make, prepare, score, split, with_vector
from tablewise.operators.measures import col, hash_normal, hash_uniform, measure, quantiles, report
from tablewise.operators.neighbors import knn
from tablewise.operators.transforms import target_transforms


def calibration_error(df: DataFrame, prob: str) -> float:
    return calibration(df, "label", prob).agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("e")).first()["e"]


def recalibrate(data: DataFrame, name: str = "forest") -> tuple[DataFrame, DataFrame]:
    """Sigmoid and isotonic maps of the score, fitted on a held-out part; errors on the test part and the better map applied."""
    train, rest = split(data, 0.5)
    model = make(name, "classification").fit(train)
    scored = model.transform(rest).select("id", "label", vector_to_array("probability")[1].alias("raw")).persist()
    fit, test = scored.where(hash_uniform("id", 9) < 0.5), scored.where(hash_uniform("id", 9) >= 0.5)
    one = lambda d: d.withColumn("features", array_to_vector(F.array("raw")))
    sig = LogisticRegression().fit(one(fit)).transform(one(test)).withColumn("sigmoid", vector_to_array("probability")[1]).select("id", "label", "raw", "sigmoid")
    iso = IsotonicRegression().fit(one(fit)).transform(one(test)).select("id", F.col("prediction").alias("isotonic"))
    both = sig.join(iso, "id").persist()
    errors = {m: calibration_error(both, m) for m in ("raw", "sigmoid", "isotonic")}
    best = min(errors, key=errors.get)
    table = report(data, [(m, half_up(e), m == best) for m, e in errors.items()], "method string, ece double, chosen boolean")
    return table, both.select("id", "label", "raw", F.col(best).alias("prob"))


def learning_curve(data: DataFrame, problem: str, name: str, sizes: int = 10, seed: int = 42) -> DataFrame:
    """Train and validation score at growing nested samples."""
    train, valid = (p.persist() for p in split(data))
    n, rows = train.count(), []
    for f in np.linspace(0.1, 1.0, sizes):
        part = train.where(hash_uniform("id", seed, 3) < float(f))
        m = make(name, problem).fit(part)
        rows.append((int(round(n * f)), half_up(score(m.transform(part), problem)), half_up(score(m.transform(valid), problem))))
    return report(data, [(*r, half_up(r[1] - r[2])) for r in rows], "rows long, train_score double, valid_score double, gap double")


def plateau(curve: DataFrame, change: float = 0.005) -> DataFrame:
    """Whether the validation score has moved by less than ``change`` over the last three sizes; null for fewer sizes."""
    scores = [r["valid_score"] for r in curve.orderBy("rows").collect()]  # a handful of points
    moved = scores[-1] - scores[-3] if len(scores) > 2 else None
    return report(curve, [(moved if moved is None else half_up(moved), None if moved is None else abs(moved) < change)], "recent_change double, plateaued boolean")


def curve_forecast(curve: DataFrame) -> DataFrame:
    """Score at 2, 5, 10 and 20 times the rows by a power law a - b n^-c; c by a grid, a and b by least squares."""
    pts = sorted((r["rows"], r["valid_score"]) for r in curve.collect())  # a handful of points
    x, y = np.array([p[0] for p in pts], float), np.array([p[1] for p in pts])
    best = None
    for c in np.linspace(0.05, 2.0, 40):
        a = np.column_stack([np.ones_like(x), -np.power(x, -c)])
        coef = np.linalg.lstsq(a, y, rcond=None)[0]
        if coef[1] < 0:  # more rows may not lower the score
            coef = np.array([y.mean(), 0.0])
        err = float(((a @ coef - y) ** 2).sum())
        if best is None or err < best[0]:
            best = (err, c, coef)
    _, c, (a, b) = best
    rows = []
    for m in (2, 5, 10, 20):
        s = min(1.0, float(a - b * (x[-1] * m) ** -c))
        rows.append((m, int(x[-1] * m), half_up(s), half_up(s - float(y[-1])), s - float(y[-1]) > 0.01))
    return report(curve, rows, "times int, rows long, score double, gain double, worth_it boolean")


def data_value(train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """(id, value, suspicious): marginal gain of each train row in the running vote of the test rows it is near to."""
    near = knn(test.select("id", "vec"), train.select("id", "vec"), k)
    found = near.join(train.select(F.col("id").alias("neighbor"), F.col("label").alias("nl")), "neighbor").join(test.select("id", "label"), "id")
    lists = found.groupBy("id", "label").agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor", "nl"))).alias("s"))  # k entries per row
    flat = lists.select("label", F.transform("s", lambda x: x["neighbor"]).alias("who"), F.transform("s", lambda x: x["nl"]).alias("said"))

    def gains(batches):
        for pdf in batches:
            for width, part in pdf.groupby(pdf["said"].str.len()):
                said, truth = np.stack(part["said"].to_numpy()), part["label"].to_numpy()
                classes = np.unique(said)
                votes = np.stack([(said == c).cumsum(axis=1) for c in classes])  # ties go to the lowest class
                right = (classes[votes.argmax(axis=0)] == truth[:, None]).astype(float)
                step = np.diff(right, axis=1, prepend=0.0)
                yield pd.DataFrame({"id": np.concatenate(part["who"].to_numpy()), "g": step.ravel()})

    value = flat.mapInPandas(gains, "id long, g double").groupBy("id").agg(F.sum("g").alias("g"))
    n = test.count()
    out = train.select("id", "label").join(value, "id", "left").select("id", "label", (F.coalesce("g", F.lit(0.0)) / n).alias("value")).persist()
    cut = quantiles(out, ["value"], [0.05])["value"][0]
    return out.withColumn("suspicious", F.col("value") < cut)


def stress(data: DataFrame, model: Model, problem: str, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Score after noise, gaps, scaling and knocked-out features; all tests in one transform."""
    p = len(features)
    std, = vector_stats(data, p, F.stddev_samp)
    med = [q[0] for q in quantiles(data, {str(i): F.col("vec")[i] for i in range(p)}, [0.5]).values()]
    s, m = F.array(*[F.lit(float(x or 0.0)) for x in std]), F.array(*[F.lit(float(x)) for x in med])
    tests = [("noise", f, i) for i, f in enumerate((0.01, 0.05, 0.1, 0.2))] + [("missing", f, 10 + i) for i, f in enumerate((0.05, 0.1, 0.2, 0.3))]
    tests += [("scale", f, 20 + i) for i, f in enumerate((0.9, 0.8, 0.7))] + [("knockout", float(i), 30 + i) for i in range(p)] + [("baseline", 0.0, 99)]
    cells = F.array(*[F.struct(F.lit(k).alias("test"), F.lit(f).alias("level"), F.lit(i).alias("no")) for k, f, i in tests])
    long = data.select("id", "label", "vec", F.explode(cells).alias("t")).select("id", "label", "vec", "t.*")

    def change(x, i):
        noise = x + hash_normal(F.col("id"), F.col("no"), i, F.lit(seed)) * F.element_at(s, i + 1) * F.col("level")
        gap = F.when(hash_uniform(F.col("id"), F.col("no"), i, F.lit(seed)) < F.col("level"), F.element_at(m, i + 1)).otherwise(x)
        out = F.when(F.col("test") == "noise", noise).when(F.col("test") == "missing", gap).when(F.col("test") == "scale", x * F.col("level"))
        return out.when((F.col("test") == "knockout") & (i == F.col("level").cast("int")), F.lit(0.0)).otherwise(x)

    pred = model.transform(with_vector(long, F.transform("vec", change)))
    e = F.col("label") - F.col("prediction")
    q = F.avg((F.col("label") == F.col("prediction")).cast("double")) if problem == "classification" else 1 - F.avg(e * e) / F.var_pop("label")
    got = pred.groupBy("test", "level").agg(q.alias("s")).collect()  # one row per test
    base = next(r["s"] for r in got if r["test"] == "baseline")
    rows = [(r["test"], features[int(r["level"])] if r["test"] == "knockout" else str(r["level"]), half_up(r["s"]), half_up(base - r["s"])) for r in got]
    rows.sort()
    return report(data, rows, "test string, level string, score double, drop double")


def stress_grade(tests: DataFrame) -> DataFrame:
    d = tests.where("test <> 'baseline'").agg(rounded(F.avg("drop")).alias("mean_drop"), rounded(F.max("drop")).alias("worst_drop"))
    x = F.col("mean_drop")
    return d.withColumn("grade", F.when(x < 0.02, "A").when(x < 0.05, "B").when(x < 0.1, "C").when(x < 0.2, "D").otherwise("F"))


def shelf_life(train: DataFrame, test: DataFrame, model: Model, problem: str, features: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Volatility (KS train against test) per feature, and the days a model is expected to last."""
    wide = lambda d: d.select(*[F.col("vec")[i].alias(f) for i, f in enumerate(features)])
    moved = ks(wide(train), wide(test), list(features)).select(F.col("column").alias("feature"), rounded(F.col("statistic")).alias("volatility"))
    pred = model.transform(test).select("id", "label", "prediction")
    grade = bootstrap_spread(bootstrap_scores(pred, "id")).first()["grade"]
    drop = max(0.0, stress(test, model, problem, features).where("test = 'noise' and level = '0.1'").first()["drop"])
    base = 180 if drop < 0.02 else 90 if drop < 0.05 else 45 if drop < 0.1 else 14
    days = int(base * {"very_stable": 2.0, "stable": 1.5, "moderate": 1.0, "unstable": 0.5}[grade])
    plan = "quarterly" if days > 120 else "monthly" if days > 60 else "bi-weekly" if days > 21 else "weekly"
    return moved, report(train, [(grade, half_up(drop), days, plan)], "stability string, drop_at_10pct double, days int, schedule string")


def model_drift(new_rows: DataFrame, model: Model, baseline: float, problem: str) -> DataFrame:
    """Score of a model on new labelled rows against its baseline."""
    now = score(model.transform(new_rows), problem)
    return report(new_rows, [(half_up(baseline), half_up(now), half_up(baseline - now), score_drop(baseline, now))], "baseline double, score double, drop double, status string")


def feature_number(c):
    """A feature value as a number: blank 0, yes/no words 1/0, a number as it is, anything else 0."""
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "yes", "y", "on"), 1.0).when(t.isin("false", "no", "n", "off"), 0.0).otherwise(F.coalesce(t.try_cast("double"), F.lit(0.0)))


def score_batch(df: DataFrame, model: Model, features: Sequence[str], key: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Predictions for raw rows: missing columns 0, text read as numbers, class names back, confidence."""
    cells = F.array(*[feature_number(col(f)) if f in df.columns else F.lit(0.0) for f in features])
    pred = model.transform(with_vector(df, cells))
    out = pred.withColumn("confidence", rounded(F.array_max(vector_to_array("probability")))) if "probability" in pred.columns else pred
    if labels:
        out = out.withColumn("predicted_label", F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1))
    keep = [key, "prediction"] + [c for c in ("confidence", "predicted_label") if c in out.columns]
    return out.select(*keep)


def score_summary(scored: DataFrame, column: str = "prediction", numeric: bool = True) -> DataFrame:
    """Moments of numeric predictions, or rows per predicted class."""
    if not numeric:
        return scored.groupBy(column).agg(F.count("*").alias("n"))
    r = measure(scored, n=F.count("*"), a=F.avg(column), s=F.stddev_pop(column), lo=F.min(column), hi=F.max(column))
    return report(scored, [(r["n"], half_up(r["a"]), half_up(quantiles(scored, [column], [0.5])[column][0]), half_up(r["s"]), half_up(r["lo"]), half_up(r["hi"]))],
                  "n long, mean double, median double, std double, min double, max double")


def target_transform_scores(df: DataFrame, target: str, key: str, features: Sequence[str], folds: int = 3) -> DataFrame:
    """Skew after each target transform and the fold score of a model trained on it, best first."""
    data, _ = prepare(df, target, key, features)
    rows = []
    for name, (expr, lam) in target_transforms(data, "label").items():
        t = data.withColumn("label", expr)
        g = measure(t, g=F.skewness("label"))["g"]
        s = float(np.mean(fold_scores(t, make("forest", "regression", numTrees=10), "regression", folds)))
        rows.append((name, half_up(lam), half_up(g), half_up(s)))
    rows.sort(key=lambda r: (-r[3], r[0]))
    return report(df, [(*r, i == 0) for i, r in enumerate(rows)], "transform string, lambda double, skewness double, score double, best boolean")
