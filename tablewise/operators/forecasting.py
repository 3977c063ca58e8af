"""Forecast learners on lag features: leaderboard, walk-forward validation, bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.functions.moments import rounded
from tablewise.operators.evaluation import poisson_weight, regression_measures
from tablewise.operators.learners import make
from tablewise.operators.measures import hash_uniform, number, numeric_columns, order_number, positions, report, task_sums
from tablewise.operators.timeseries import holdout, lag_features

MODELS = ("ridge", "lasso", "forest", "boosted")


def lagged(df: DataFrame, by: Sequence[str], date: str, target: str, lags=(1, 2, 3, 7), windows=(3, 7)) -> DataFrame:
    """(id, series..., date, vec, features, label): lag features only, so nothing of the day itself leaks."""
    made = lag_features(df.select(*by, date, target), by, date, target, lags, windows)
    feats = [c for c in numeric_columns(made) if c.startswith(f"{target}_") and "_diff_" not in c]
    out = made.select(*by, date, F.array(*[number(c) for c in feats]).alias("vec"), number(target).alias("label"))
    return out.withColumn("id", F.xxhash64(*by, date)).withColumn("features", array_to_vector("vec"))


def forecast_leaderboard(df: DataFrame, by: Sequence[str], date: str, target: str, horizon: int, names: Sequence[str] = MODELS) -> DataFrame:
    data = holdout(lagged(df, by, date, target), by, date, horizon).persist()
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    rows = []
    for n in names:
        m = regression_measures(make(n, "regression").fit(train).transform(test)).first()
        rows.append((n, m["mae"], m["mse"], m["rmse"], m["r2"], m["mape"]))
    data.unpersist()
    rows.sort(key=lambda r: r[3])
    return report(df, rows, "model string, mae double, mse double, rmse double, r2 double, mape double")


def walk_forward(df: DataFrame, by: Sequence[str], date: str, target: str, name: str = "ridge", blocks: int = 4) -> DataFrame:
    """Train on everything before a block of time, test on the block."""
    data = lagged(df, by, date, target)
    data = positions(data.withColumn("_t", order_number(data, date)), list(by), "_t", "_pos").drop("_t")
    n = data.groupBy(*by).agg((F.max("_pos") + 1).alias("_n"))
    data = (data.join(n, list(by)) if by else data.withColumn("_n", F.lit(n.first()["_n"]))).withColumn("block", F.floor(F.col("_pos") * (blocks + 1) / F.col("_n")).cast("int")).persist()
    rows = []
    for b in range(1, blocks + 1):
        train, test = data.where(F.col("block") < b), data.where(F.col("block") == b)
        m = regression_measures(make(name, "regression").fit(train).transform(test)).first()
        rows.append((b, m["rmse"], m["r2"]))
    data.unpersist()
    return report(df, rows, "block int, rmse double, r2 double")


#: Learners whose refits have a closed form, and their penalty.
RIDGES = {"linear": 0.0, "ridge": 1.0}


def weighted_fits(train: DataFrame, refits: int, penalty: float, seed: int) -> np.ndarray:
    """Coefficients (constant first) of a penalised regression for each set of bootstrap weights, all from one pass.

    A row's weights come from its id. The weighted products of all refits are summed by partition; a regression is solved from its own, standardised by its
    own weighted moments as the learner does.
    """
    width = len(train.first()["vec"])
    size = width + 2
    weights = F.transform(F.sequence(F.lit(0), F.lit(refits - 1)), lambda r: poisson_weight(hash_uniform("id", seed, r)).cast("double"))

    def own(b: pa.RecordBatch) -> np.ndarray:
        x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        z = np.column_stack([np.ones(len(x)), x, b.column(1).to_numpy()])
        w = b.column(2).flatten().to_numpy().reshape(-1, refits)
        return np.stack([z.T @ (w[:, [r]] * z) for r in range(refits)]).ravel()

    sums = task_sums(train.select("vec", "label", weights.alias("w")), refits * size * size, own).reshape(refits, size, size)
    out = np.zeros((refits, width + 1))
    for r, s in enumerate(sums):
        if s[0, 0] <= 0:
            continue
        mean = s[0] / s[0, 0]
        cov = s / s[0, 0] - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))
        used = [j for j in range(1, width + 1) if sd[j] > 1e-12 * max(1.0, abs(mean[j]))]
        if sd[-1] > 0 and used:
            corr = cov[np.ix_(used, used)] / np.outer(sd[used], sd[used])
            beta = np.linalg.lstsq(corr + np.eye(len(used)) * penalty / sd[-1], cov[used, -1] / (sd[used] * sd[-1]), rcond=None)[0]
            out[r, used] = beta * sd[-1] / sd[used]
        out[r, 0] = mean[-1] - out[r, 1:] @ mean[1 : width + 1]
    return out


def forecast_interval(df: DataFrame, by: Sequence[str], date: str, target: str, horizon: int, name: str = "ridge", refits: int = 50, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Forecast of the held-out rows with a percentile interval over bootstrap refits.

    The refits of ``linear`` and ``ridge`` come from one pass over the train part; other learners are fitted one by one.
    """
    data = holdout(lagged(df, by, date, target), by, date, horizon).persist()
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    point = make(name, "regression").fit(train).transform(test).select("id", *by, date, "label", F.col("prediction").alias("forecast"))
    a = (1 - confidence) / 2
    if name in RIDGES:
        fits = weighted_fits(train, refits, RIDGES[name], seed)

        def bands(batches):
            for b in batches:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                low, high = np.quantile(x @ fits[:, 1:].T + fits[:, 0], [a, 1 - a], axis=1) if b.num_rows else (np.zeros(0), np.zeros(0))
                yield pa.record_batch([b.column(0), pa.array(low), pa.array(high)], ["id", "low", "high"])

        band = test.select("id", "vec").mapInArrow(bands, "id long, low double, high double")
    else:
        draws = None
        for r in range(refits):
            part = train.withColumn("_w", poisson_weight(hash_uniform("id", seed, r)).cast("double")).where("_w > 0")
            p = make(name, "regression", weightCol="_w").fit(part).transform(test).select("id", "prediction")
            draws = p if draws is None else draws.union(p)
        q = F.percentile("prediction", F.array(F.lit(a), F.lit(1 - a)))  # ``refits`` values per row
        band = draws.groupBy("id").agg(q.alias("q")).select("id", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return point.join(band, "id").select(*by, date, "label", *[rounded(F.col(c)).alias(c) for c in ("forecast", "low", "high")])
