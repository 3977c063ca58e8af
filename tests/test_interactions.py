"""Interactions of tree models over all rows, against copies of every row with every other."""

import pytest
from pyspark.sql import functions as F

from tablewise.operators import explain as X
from tablewise.operators import learners as L

NAMES = ["a", "b", "c", "d"]


def table(spark, rows, label):
    u = lambda k: (F.abs(F.xxhash64(F.col("id"), F.lit(k))) % 1000) / 1000.0
    d = spark.range(rows).select("id", F.array(*[u(k) for k in range(4)]).alias("vec"))
    return L.with_vector(d.withColumn("label", label.cast("double")), F.col("vec")).repartition(3)


def strength(found):
    return {frozenset((r["feature_1"], r["feature_2"])): r["strength"] for r in found.collect()}


v = lambda i: F.col("vec")[i]


@pytest.mark.parametrize("problem, name", [("classification", "tree"), ("classification", "forest"), ("regression", "tree"), ("regression", "forest"), ("regression", "boosted")])
def test_equal_to_brute_force(spark, problem, name):
    label = ((v(0) > 0.5) != (v(1) > 0.4)) | (v(2) > 0.9) if problem == "classification" else v(0) * v(1) * 10 + v(2)
    d = table(spark, 200, label).persist()
    model = L.make(name, problem, maxDepth=4).fit(d)
    exact = strength(X.interactions(d, model, problem, NAMES))
    brute = strength(X.sampled_interactions(d, model, problem, NAMES, rows=200))
    assert set(exact) == set(brute) and len(exact) == 6
    assert all(abs(exact[p] - brute[p]) < 2e-4 for p in brute)
    assert exact[frozenset("ab")] > 0.1


def test_all_rows_count(spark):
    """Rows beyond any sample have a say, and blocks of rows add up."""
    d = table(spark, 5000, (v(0) > 0.5) != (v(1) > 0.4)).persist()
    model = L.make("tree", "classification", maxDepth=4).fit(d)
    leaves = X.tree_leaves(model, "classification")
    pairs = [(0, 1), (2, 3)]
    whole = X.tree_interactions(d, leaves, pairs)
    X.CELLS, before = 100, X.CELLS
    try:
        cut = X.tree_interactions(d, leaves, pairs)
    finally:
        X.CELLS = before
    assert whole[0, 1] > 0.9 and whole == pytest.approx(cut)
    assert X.tree_interactions(d.where("id < 0"), leaves, pairs) == {(0, 1): 0.0, (2, 3): 0.0}


def test_features_that_share_no_leaf_do_not_interact(spark):
    d = table(spark, 500, v(0)).persist()
    model = L.make("tree", "regression", maxDepth=3).fit(d)
    assert all(h == 0 for h in strength(X.interactions(d, model, "regression", NAMES)).values())


def test_other_models_use_the_sample(spark):
    d = table(spark, 300, v(0) > 0.5).persist()
    model = L.make("logistic", "classification").fit(d)
    assert X.tree_leaves(model, "classification") is None
    assert len(strength(X.interactions(d, model, "classification", NAMES, rows=20))) == 6
