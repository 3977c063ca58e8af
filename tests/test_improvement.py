"""Steps of the improvement loop, advice on features and retraining on components."""

import pytest
from pyspark.sql import functions as F

from tablewise.operators import learners as L


@pytest.fixture(scope="module")
def data(spark):
    u = lambda k: (F.abs(F.xxhash64(F.col("id"), F.lit(k))) % 1000) / 1000.0
    d = spark.range(600).select("id", F.array(*[u(k) for k in range(8)]).alias("vec"))
    label = (F.col("vec")[0] + F.col("vec")[5] > 1).cast("double")
    return L.with_vector(d.withColumn("label", label), F.col("vec")).persist()


def test_best_half_keeps_the_features_that_matter(data):
    kept = L.best_half(data, "classification")
    row = kept.join(data.select("id", F.col("vec").alias("whole")), "id").where("id = 7").first()
    assert len(row["vec"]) == 4
    assert row["whole"][0] in row["vec"] and row["whole"][5] in row["vec"]
    assert len(L.best_half(data, "regression").first()["vec"]) == 4
    few = L.with_vector(data, F.slice("vec", 1, 2))
    assert len(L.best_half(few, "classification").first()["vec"]) == 2


def test_deciles_stand_beside_the_features(data):
    d = L.with_deciles(data)
    sizes = {r["bin"]: r["count"] for r in d.groupBy(F.col("vec")[8].alias("bin")).count().collect()}
    assert set(sizes) == set(map(float, range(10)))
    assert all(50 <= n <= 70 for n in sizes.values())
    flat = L.with_deciles(L.with_vector(data, F.array(F.lit(1.0), F.col("vec")[0])))
    assert flat.where(F.col("vec")[2] != 0).isEmpty()  # one value has no bins


def test_outliers_go_unless_too_many(data):
    d = data.select("id", F.when(F.col("id") == 3, 50.0).otherwise(F.col("vec")[0]).alias("x"), F.col("vec")[1].alias("y"))
    left = L.without_outliers(d, "id", ["x", "y"], 0.05, trees=20)
    assert 560 <= left.count() < 600 and left.where("id = 3").isEmpty()
    with pytest.raises(ValueError):
        L.without_outliers(d, "id", ["x", "y"], 0.5, trees=20)


def test_a_step_that_refuses_is_a_miss(data, monkeypatch):
    def refuse(*args, **kwargs):
        raise ValueError("too many")

    monkeypatch.setattr(L, "without_outliers", refuse)
    rows = {r["step"]: r for r in L.improve(data, "classification", "bayes", misses=9).collect()}
    assert list(rows) == ["start", "best_half", "products", "squares", "outliers", "deciles", "ratios"]
    assert rows["outliers"]["score"] is None and not rows["outliers"]["kept"]


def test_feature_advice():
    findings = lambda *a: [f for f, _, _ in L.feature_advice(*a)]
    assert findings(3, [("a", 1.0), ("b", 0.2), ("c", 0.1)], 0.9, "classification", 0) == ["few_features", "dominant_feature"]
    assert findings(20, [(str(i), 1.0) for i in range(20)], 0.9, "classification", 3) == ["weak_features", "correlated_features"]
    assert findings(8, [(str(i), 1.0) for i in range(8)], 0.6, "classification", 0) == ["cross_features"]
    assert findings(8, [("a", 1.0), ("b", 1.0), ("c", 0.1)], 0.9, "regression", 2) == ["cross_top_features"]
    assert findings(8, [], 0.9, "regression", 0) == []


def test_components_keep_what_a_linear_model_needs(data):
    row = L.retrain(data, "classification", "logistic", ["components"]).first()
    assert row["actions"] == "components" and 0.5 < row["after"] <= 1.0
