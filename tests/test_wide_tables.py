"""Nothing is dropped on wide tables, on tables with nulls, or when rows come in another order."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.operators import explore, neighbors, transforms
from tablewise.operators.measures import pair_correlations


@pytest.fixture(scope="module")
def wide(spark):
    gaps = [F.when(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(7)) > 0, F.pmod(F.xxhash64("id", F.lit(i % 40)), F.lit(100)).cast("double")).alias(f"c{i}") for i in range(60)]
    return spark.range(300).select("id", *gaps).cache()


def test_all_columns_are_reported(wide):
    columns = [f"c{i}" for i in range(60)]
    assert explore.correlation_matrix(wide, columns).count() == 60 * 59 // 2
    assert explore.missing_by_column(wide).count() == 60
    assert explore.missing_by_column(wide, 5).count() == 5


def test_correlations_are_pairwise_complete(wide):
    columns = [f"c{i}" for i in range(38, 44)]
    pdf = wide.select(*columns).toPandas()
    want = pdf.corr(min_periods=2)
    for (a, b), r in pair_correlations(wide, columns).items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-9)


def test_constant_columns_have_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (4.0, 5.0, None)], "a double, b double, c double")
    assert set(pair_correlations(df, ["a", "b", "c"]).values()) == {None}


def test_rows_with_gaps_stay(wide):
    scores, shares, _ = transforms.principal_components(wide, ["c1", "c2", "c3"], 2)
    assert scores.count() == 300 and len(shares) == 2 and "_filled0" not in scores.columns


@pytest.mark.parametrize("small", [True, False])
def test_neighbours_do_not_depend_on_row_order(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(neighbors, "BROADCAST_VALUES", 10)
        monkeypatch.setattr(neighbors, "LEAF_ROWS", 40)
    rng = np.random.default_rng(3)
    points = rng.integers(0, 6, (400, 2)).astype(float)
    points[:130] = points[0]  # a third of all rows are copies
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    found = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "id long, vec array<double>").repartition(3)
        found.append({(r.id, r["rank"], r.neighbor) for r in neighbors.knn(df, df, 4, same=True).collect()})
    want = set()
    for i, p in enumerate(points):
        d = np.sqrt(((points - p) ** 2).sum(axis=1))
        near = sorted((d[j], j) for j in range(400) if j != i)[:4]
        want |= {(i, k + 1, j) for k, (_, j) in enumerate(near)}
    assert found[0] == found[1] == want


@pytest.mark.parametrize("tie", ["id", None])
def test_one_order_value_is_split(spark, monkeypatch, tie):
    from tablewise.operators import measures

    monkeypatch.setattr(measures, "ROWS_PER_TASK", 100)
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("double").alias("v"))
    data, parts = measures.bucketed(df, "v", "_bucket")
    split = measures.uncrowded(data, "v", tie).groupBy("_bucket").count().agg(F.max("count")).first()[0]
    assert parts > 1 and split < 400 < data.groupBy("_bucket").count().agg(F.max("count")).first()[0]
    got = [(r.v, r.id) for r in measures.positions(df, [], "v", "pos", tie).orderBy("pos").collect()]
    assert [v for v, _ in got] == sorted(v for v, _ in got) and len(set(got)) == 3000
    assert tie is None or got == sorted(got)
