"""Known answers and properties of operators that SQL cannot state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewise.functions import tails
from tablewise.operators import anomalies, clusters, coercion, imputation, learners, measures, missingness, neighbors, patterns, sampling, studio, transforms
from tablewise.operators import metadata, timeseries
from tablewise.sources import files


def points(spark, rows, names):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{n} double" for n in names))


def test_tails():
    assert tails.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert tails.chi2_sf(18.307038053275146, 10) == pytest.approx(0.05)
    assert tails.t_sf2(2.2281388519649385, 10) == pytest.approx(0.05)
    assert tails.normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert tails.normal_cdf(-1.0) == pytest.approx(0.15865525393145707)
    assert tails.ks_sf(0.1, 1000, 1000) == pytest.approx(9.0816e-05, rel=1e-2)
    assert tails.ks_sf(0.0, 10, 10) == 1.0


def density_labels(z, eps, least):
    """Core rows, and of every row the smallest core row it is connected with; -1 for noise."""
    near = [np.flatnonzero(np.sqrt(((z - p) ** 2).sum(axis=1)) <= eps) for p in z]
    core = np.array([len(k) >= least for k in near])
    label = np.full(len(z), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], i
            while todo:
                for k in near[todo.pop()]:
                    if core[k] and label[k] < 0:
                        label[k] = i
                        todo.append(k)
    for i in np.flatnonzero(~core):
        others = near[i][core[near[i]]]
        if len(others):
            d = np.sqrt(((z[others] - z[i]) ** 2).sum(axis=1))
            label[i] = label[others[np.lexsort((others, d))[0]]]
    return label


@pytest.mark.parametrize(("width", "eps", "least", "leaf"), [(2, 0.08, 12, 300), (2, 0.2, 50, 20_000), (3, 0.25, 10, 300), (6, 0.9, 8, 400), (1, 0.001, 5, 50)])
def test_dbscan_equals_brute_force(spark, monkeypatch, width, eps, least, leaf):
    monkeypatch.setattr(clusters, "LEAF_ROWS", leaf)
    rng = np.random.default_rng(width)
    centres = rng.uniform(-4, 4, (6, width))
    x = np.concatenate([*(rng.normal(c, s, (700, width)) for c, s in zip(centres, (0.1, 0.2, 0.3, 0.4, 0.5, 0.6))), rng.uniform(-5, 5, (400, width)), np.repeat(centres[:1] + 3, 400, axis=0)])
    columns = [f"c{i}" for i in range(width)]
    df = points(spark, x, columns)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    got = clusters.dbscan(df, "id", columns, eps, least).toPandas().sort_values("id")
    assert got["id"].tolist() == list(range(len(x)))
    assert (got["cluster"].to_numpy() == density_labels(z, eps, least)).all()


def test_dbscan_of_copies(spark):
    df = points(spark, np.array([[1.0, 2.0]] * 30 + [[5.0, 5.0]]), ["a", "b"])
    got = {r.id: r.cluster for r in clusters.dbscan(df, "id", ["a", "b"]).collect()}
    assert got == {**{i: 0 for i in range(30)}, 30: -1}
    assert clusters.dbscan(df.where("false"), "id", ["a", "b"], 0.5, 3).count() == 0


def test_boxes_are_found_down_the_tree():
    rng = np.random.default_rng(0)
    looked = []
    for rows in (4_000, 64_000):
        x = rng.uniform(size=(rows, 3))
        tree = neighbors.Leaves(x, rows // 50)
        leaf = tree.assign(x)
        names = np.unique(leaf)
        lo, hi = (np.array([f(x[leaf == k], axis=0) for k in names]) for f in (np.min, np.max))
        tree.enclose(names, lo, hi)
        q, bound = rng.uniform(size=(200, 3)), np.full(200, 0.3 / rows ** (1 / 3))
        at, found, n = tree.within(q, q, bound)
        gap = np.maximum(np.maximum(lo[None] - q[:, None], q[:, None] - hi[None]), 0)
        i, j = np.nonzero(np.sqrt((gap**2).sum(axis=2)) <= bound[:, None])
        assert {*zip(at.tolist(), found.tolist(), strict=True)} == {*zip(i.tolist(), names[j].tolist(), strict=True)}
        looked.append(n / 200)
    assert looked[1] < looked[0] + 12  # sixteen times the leaves, four levels more


def test_local_outlier_factor_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(120, 2)), [[9.0, 9.0]]])
    z = (x - x.mean(0)) / x.std(0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    k = 8
    nb = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, nb, 1).max(1)
    lrd = 1 / (np.maximum(kd[nb], np.take_along_axis(d, nb, 1)).mean(1) + 1e-10)
    want = lrd[nb].mean(1) / lrd
    got = anomalies.local_outlier_factor(points(spark, x, ["a", "b"]), "id", ["a", "b"], k).toPandas().sort_values("id")["score"].to_numpy()
    assert np.allclose(got, want)
    assert got.argmax() == 120


def test_isolation_forest_finds_the_far_point_and_repeats(spark):
    rng = np.random.default_rng(4)
    df = points(spark, np.concatenate([rng.normal(size=(400, 2)), [[12.0, -12.0]]]), ["a", "b"])
    one = anomalies.isolation_scores(df, "id", ["a", "b"], trees=60).toPandas().set_index("id")["score"]
    two = anomalies.isolation_scores(df.repartition(5), "id", ["a", "b"], trees=60).toPandas().set_index("id")["score"]
    assert one.idxmax() == 400
    assert np.allclose(one.sort_index(), two.sort_index())


def test_smote_lies_between_minority_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))] + [(1000 + i, float(a), float(b), 1) for i, (a, b) in enumerate(rng.normal(5, 0.5, size=(20, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = sampling.smote(df, "y", "id", ["a", "b"]).toPandas()
    new = out[out["synthetic"]]
    assert len(new) == 180 and (new["y"] == 1).all()
    small = out[(out["y"] == 1) & ~out["synthetic"]]
    assert new["a"].between(small["a"].min(), small["a"].max()).all()
    assert new["b"].between(small["b"].min(), small["b"].max()).all()


def test_samples_repeat_under_any_partitioning(spark):
    df = spark.range(3_000).selectExpr("id", "id % 7 = 0 AS y")
    a = sampling.stratified(df, "y", "id", 500).select("id").toPandas()["id"].sort_values().tolist()
    b = sampling.stratified(df.repartition(9), "y", "id", 500).select("id").toPandas()["id"].sort_values().tolist()
    assert a == b


def test_synthetic_numbers_keep_shape(spark):
    rng = np.random.default_rng(6)
    a = rng.gamma(2.0, 3.0, 4_000)
    df = points(spark, np.column_stack([a, 2 * a + rng.normal(0, 1, 4_000)]), ["a", "b"])
    made = sampling.synthetic_numbers(df, ["a", "b"], 4_000).toPandas()
    assert made["a"].mean() == pytest.approx(a.mean(), rel=0.05)
    assert np.corrcoef(made["a"], made["b"])[0, 1] > 0.9


def test_chained_fill_recovers_a_linear_column(spark):
    df = spark.range(400).selectExpr("id", "CAST(id AS DOUBLE) AS a", "CASE WHEN id % 5 = 0 THEN NULL ELSE 3.0 * id + 1 END AS b")
    out = imputation.fill_iterative(df, ["a", "b"], rounds=2).toPandas()
    assert np.allclose(out["b"], 3 * out["a"] + 1, atol=0.05)


def test_nearest_fill_uses_the_nearest_rows(spark):
    df = spark.range(100).selectExpr("id", "CAST(id AS DOUBLE) AS a", "CASE WHEN id = 50 THEN NULL ELSE CAST(id AS DOUBLE) END AS b")
    out = imputation.fill_nearest(df, "id", ["a", "b"], k=2).toPandas().set_index("id")
    assert out.loc[50, "b"] == pytest.approx(50.0)


def test_little_test_accepts_random_gaps(spark):
    rng = np.random.default_rng(7)
    rows = [(float(a), float(b) if u > 0.2 else None) for a, b, u in zip(rng.normal(size=2_000), rng.normal(size=2_000), rng.uniform(size=2_000))]
    ok = missingness.little_test(spark.createDataFrame(rows, "a double, b double")).first()
    tied = missingness.little_test(spark.createDataFrame([(a, b if a < 0.5 else None) for a, b in rows], "a double, b double")).first()
    assert ok["is_mcar"] and not tied["is_mcar"]


def test_coercion_chain(spark):
    df = spark.createDataFrame(
        [(f"a-{i:07d}x", f"${i}.50", f"{i}%", "yes" if i % 2 else "no", f"2024-01-{i % 28 + 1:02d}", "<b>x</b> y%d" % (i % 30), '{"p": {"q": %d}}' % (i % 30), "low" if i % 3 else "high") for i in range(60)],
        ["Row ID", "cost", "rate", "flag", "when", "html", "doc", "level"])
    out, changes = coercion.transform_any(df)
    assert "row_id" not in out.columns and out.schema["cost"].dataType.simpleString() == "double"
    assert {"rate", "flag", "when_year", "doc_p_q", "level"} <= set(out.columns)
    row = out.where("cost = 5.5").first()
    assert (row["rate"], row["flag"], row["doc_p_q"], row["level"], row["html"]) == (0.05, 1, 5, 1, "x y5")
    assert changes.count() >= 8


def test_expressions_are_checked(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert studio.add_feature(df, "f", "log(a) + b ** 2").first()["f"] == pytest.approx(np.log(2) + 4)
    with pytest.raises(ValueError):
        studio.spark_expression("java_method('x')")
    with pytest.raises(ValueError):
        studio.spark_expression("sleep(a)")
    assert studio.check_expression(df, "a + missing") is not None
    assert studio.check_expression(df, "a + b") is None


def test_bootstrap_effect_covers_the_truth(spark):
    rng = np.random.default_rng(8)
    c = rng.normal(size=3_000)
    t = c + rng.normal(size=3_000)
    y = 2.0 * t + 3.0 * c + rng.normal(size=3_000)
    df = points(spark, np.column_stack([t, y, c]), ["t", "y", "c"])
    r = patterns.causal_effect(df, "id", "t", "y", ["c"], draws=200).first()
    assert r["low"] < 2.0 < r["high"] and r["significant"]
    assert abs(r["plain"] - 3.5) < 0.2


def test_fingerprint_ignores_order_and_sees_every_row(spark):
    df = spark.range(1_000).withColumn("x", F.col("id") * 2)
    one = files.fingerprint(df).first()[0]
    assert one == files.fingerprint(df.repartition(7)).first()[0]
    assert one != files.fingerprint(df.withColumn("x", F.when(F.col("id") == 500, -1).otherwise(F.col("x")))).first()[0]


def test_separator_is_sniffed(spark, tmp_path):
    (tmp_path / "f.dat").write_text("a;b\n1;2,5\n3;4,5\n")
    df = files.read_table(spark, str(tmp_path / "f.dat"))
    assert df.columns == ["a", "b"] and df.count() == 2


def test_shuffled_is_a_permutation(spark, monkeypatch):
    monkeypatch.setattr(learners, "ROWS_PER_TASK", 100)
    df = spark.range(1_000).select("id", F.array(F.col("id").cast("double")).alias("vec"))
    got = learners.shuffled(df, 0).toPandas()
    assert sorted(v[0] for v in got["other"]) == [float(i) for i in range(1_000)]
    assert (got["id"] != [int(v[0]) for v in got["other"]]).mean() > 0.95


def test_similarity_of_equal_vectors_is_one(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [-2.0, 1.0])], "id string, v array<double>")
    got = {r["id"]: r["similarity"] for r in metadata.most_similar(df, "id", "v", [2.0, 4.0], 2).collect()}
    assert got == {"a": 1.0, "b": 0.0}


def test_blocked_windows_equal_plain_windows(spark, monkeypatch):
    df = spark.range(2_000).selectExpr("id % 2 AS g", "id AS t", "CAST(id * id % 97 AS DOUBLE) AS y")
    plain = timeseries.lag_features(df, ["g"], "t", "y").toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    monkeypatch.setattr(measures, "ROWS_PER_TASK", 90)
    split = timeseries.lag_features(df, ["g"], "t", "y").toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    assert np.allclose(plain.to_numpy(float), split[plain.columns].to_numpy(float))


@pytest.mark.parametrize("values", [5, 300])
def test_label_codes_follow_sorted_order(spark, values):
    df = spark.range(1_000).selectExpr("id", f"concat('c', lpad(CAST(id % {values} AS STRING), 4, '0')) AS c")
    out, mapping = transforms.label_encode(df, "c")
    got = out.toPandas()
    assert out.columns == ["id", "c"] and len(mapping) == values
    assert (got["c"] == got["id"] % values).all()
