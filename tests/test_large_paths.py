"""The code paths for large tables, forced on small ones, give the same answers."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tablewise.operators import measures, neighbors
from tests.compare import difference
from tests.conftest import FOLDER

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
KEYS = ["QR10", "PR9", "ED2", "ED10", "DQ1", "CN5", "CN9", "CN10", "CN17", "FE8", "TS2", "TS3", "TS5", "TS6", "TS9", "TS10", "TS11", "TR14",
        "DR1", "DR2", "DR7", "EV2", "EV2_auc", "EV3_ap", "EV4_qq", "EV5", "EV11_reg", "EV17", "SM1", "SM4", "SM5", "SM6", "UN7", "UN11", "ML24", "XP3", "XP8"]


@pytest.fixture
def tiny_tasks(monkeypatch):
    monkeypatch.setattr(measures, "ROWS_PER_TASK", 700)


@pytest.mark.parametrize("key", KEYS)
def test_split_paths_match_oracle(spark, oracle, tiny_tasks, key):
    diff, _ = difference(spark, oracle, FOLDER, QUERIES[key], ORACLES[key])
    assert diff is None, diff


@pytest.mark.parametrize("probs", [[0.0, 0.5, 1.0], [0.013, 0.25, 0.999]])
def test_quantiles_with_a_hot_value(spark, tiny_tasks, probs):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.full(2_000, 7.0), rng.normal(5, 4, 4_000)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(6)
    got = measures.quantiles(df, ["x"], probs)["x"]
    assert got == pytest.approx(list(np.quantile(x, probs)))


def test_running_sums_and_positions(spark, tiny_tasks):
    df = spark.range(5_000).selectExpr("id % 3 AS g", "id AS x", "1 AS n")
    got = measures.running_sums(df, ["g"], "x", {"c": "n"}).toPandas().sort_values(["g", "x"])
    assert (got.groupby("g")["c"].apply(list).map(lambda v: v == list(range(1, len(v) + 1)))).all()
    pos = measures.positions(df, ["g"], "x").toPandas().sort_values(["g", "x"])
    assert (pos.groupby("g")["pos"].apply(list).map(lambda v: v == list(range(len(v))))).all()


@pytest.mark.parametrize("small", [True, False])
def test_nearest_neighbours_are_exact(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(neighbors, "BROADCAST_VALUES", 0)
        monkeypatch.setattr(neighbors, "LEAF_ROWS", 150)
        monkeypatch.setattr(neighbors, "QUERY_ROWS", 300)
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(2_400, 3))
    pts[:800] = pts[0]  # a third of the rows are copies of one point
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, vec array<double>").repartition(4)
    got = neighbors.knn(df, df, 4, same=True).toPandas().sort_values(["id", "rank"])
    assert np.allclose(got["distance"].to_numpy().reshape(-1, 4), np.sort(d, axis=1)[:, :4])
    assert got.groupby("id")["neighbor"].nunique().min() == 4
