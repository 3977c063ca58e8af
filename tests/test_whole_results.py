"""Nothing is left out unless an argument says so; refits in one pass equal refits one by one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import blocks, clusters, features, forecasting, learners, measures, sampling
from tablewise.operators.evaluation import poisson_weight


def test_wide_tables_give_all_pairs(spark):
    wide = spark.range(50).select("id", *[(F.col("id") * (k + 1) % 17 + k).cast("double").alias(f"c{k}") for k in range(60)])
    names = [f"c{k}" for k in range(60)]
    assert len(features.products(wide, names).columns) == 61 + 60 * 59 // 2
    assert len(features.ratios(wide, names[:20]).columns) == 61 + 20 * 19 // 2
    assert len(features.products(wide, names, top=5, pairs=3).columns) == 64


def test_small_tables_are_balanced_too(spark):
    df = spark.range(30).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.col("id").cast("double").alias("a"))
    made = sampling.smote(df, "label", "id", ["a"])
    assert dict(made.groupBy("label").count().collect()) == {0: 27, 1: 27}
    assert sampling.undersample(df, "label", "id", ratio=2.0).count() == 6


def test_scan_reaches_the_k_that_is_asked_for(spark):
    df = spark.range(40).select("id", (F.col("id") * 37 % 40).cast("double").alias("a"))
    assert [r.k for r in clusters.kmeans_scan(df, "id", ["a"], 18).collect()] == list(range(2, 19))


@pytest.mark.parametrize("made", [[("scale", "standard")], [("select", "correlation")], [("scale", "minmax"), ("select", "k_best"), ("reduce", "pca")], [("encode", "onehot"), ("select", "variance")]])
def test_blocks_keep_rows_with_gaps(spark, made):
    rows = [(float(i), None if i % 4 == 0 else float(2 * i), float((i * 7) % 11), None if i % 5 == 0 else "ab"[i % 2], float(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, t string, target double")
    out = blocks.compile_blocks(made, ["a", "b", "c"], "target", ["t"]).fit(df).transform(df)
    assert out.where("features IS NOT NULL").count() == 200
    if made[0] == ("select", "correlation"):
        assert out.first()["features"].size == 2 or out.first()["features"].size == 3
    assert blocks.compile_blocks([("fill", "drop")], ["a", "b"], "target").fit(df).transform(df).count() == 150


def test_correlated_columns_go(spark):
    df = spark.range(300).select(F.col("id").cast("double").alias("a"), (3.0 * F.col("id") + 1).alias("b"), (F.col("id") * 7 % 11).cast("double").alias("c"), F.lit(1.0).alias("d"))
    out = blocks.compile_blocks([("select", "correlation")], ["a", "b", "c", "d"], "a").fit(df).transform(df).first()["features"]
    assert out.size == 3


@pytest.mark.parametrize("rows", [50, 700, 5_000])
def test_quantiles_of_many_columns_stay_exact(spark, monkeypatch, rows):
    monkeypatch.setattr(measures, "ROWS_PER_TASK", rows)
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=2_000), rng.integers(0, 5, 2_000), rng.exponential(size=2_000) ** 4, np.zeros(2_000), np.round(rng.normal(size=2_000), 1)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"c{i} double" for i in range(5))).repartition(4)
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = measures.quantiles(df, [f"c{i}" for i in range(5)], probs)
    for i in range(5):
        assert np.allclose(got[f"c{i}"], np.quantile(x[:, i], probs), rtol=1e-12, atol=1e-12), i


def test_refits_in_one_pass_equal_refits_one_by_one(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 3)) * [1, 5, 0.1]
    y = x @ [2.0, -1.0, 30.0] + rng.normal(size=600) * 4 + 7
    rows = [(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    train = learners.with_vector(spark.createDataFrame(rows, "id long, vec array<double>, label double"), F.col("vec")) if hasattr(learners, "with_vector") else None
    for name, penalty in forecasting.RIDGES.items():
        fits = forecasting.weighted_fits(train, 4, penalty, 42)
        for r in range(4):
            part = train.withColumn("_w", poisson_weight(measures.hash_uniform("id", 42, r)).cast("double")).where("_w > 0")
            m = learners.make(name, "regression", weightCol="_w").fit(part)
            assert np.allclose(fits[r], [m.intercept, *m.coefficients.toArray()], rtol=1e-5, atol=1e-6), (name, r)
