"""Training, tuning, explaining and scoring over the source tables."""


from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from tablewise.operators import assessment as S
from tablewise.operators import cleaning as C
from tablewise.operators import explain as X
from tablewise.operators import forecasting as Z
from tablewise.operators import imputation as I
from tablewise.operators import learners as L
from tablewise.operators.measures import report
from tablewise.plans.feature_plans import r
from tablewise.plans.record_plans import scratch
from tablewise.plans.registry import query
from tablewise.plans.sqltext import rnd

FEATURES = ["price", "f1", "f2"]
CLF, REG = "classification", "regression"


def table(t):
    return L.prepare(t.learnable, "target", "o_orderkey", FEATURES)[0]


def reg_table(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return L.prepare(df, "p_retailprice", "p_partkey", ["p_partkey", "p_size", "p_brand"])[0]


def fitted(t, name="forest"):
    train, test = L.split(table(t))
    return train, test, L.make(name, CLF).fit(train)


# Cleaning with models


@query("CN7", "SELECT count(*) AS n, count(*) FILTER (WHERE price IS NOT NULL) AS filled_before, count(*) AS filled_after FROM {gappy_orders}")
def cn7(t):
    df = t.gappy_orders
    out = I.fill_nearest(df, "o_orderkey", ["price", "cust", "o_shippriority"])
    before = df.agg(F.count("price")).first()[0]
    return out.agg(F.count("*").alias("n"), F.lit(before).cast("long").alias("filled_before"), F.count("price").alias("filled_after"))


@query("CN8")
def cn8(t):
    return r(I.fill_iterative(t.gappy_orders.select("o_orderkey", "price", "cust", "o_shippriority"), ["price", "cust", "o_shippriority"]), "price", "cust")


@query("CN14")
def cn14(t):
    df = t.gappy_orders.withColumn("target", (F.col("o_shippriority") > 5).cast("int")).drop("o_shippriority")
    return I.cleaning_impact(df, "target", "o_orderkey", C.suggestions(df.drop("target")), trees=50, depth=10)


# Transforms with models


@query("TR10")
def tr10(t):
    from tablewise.operators.blocks import compile_blocks

    model = compile_blocks([("fill", "median"), ("scale", "minmax"), ("select", "correlation"), ("select", "variance"), ("reduce", "pca")], FEATURES, "target").fit(t.learnable.withColumn("target", F.col("target").cast("double")))
    return model.transform(t.learnable.withColumn("target", F.col("target").cast("double"))).select("o_orderkey", F.col("features").cast("string").alias("features"))


@query("TR16")
def tr16(t):
    train, _ = L.split(t.learnable.withColumn("id", F.col("o_orderkey")))
    return L.without_outliers(train, "o_orderkey", FEATURES).select("o_orderkey", "target")


@query("TR17")
def tr17(t):
    return S.target_transform_scores(t.events, "value", "event_id", ["user_id"], 2)


# Training


@query("ML1", f"SELECT o_orderkey AS id, {rnd('price')} AS price, f1, f2, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS INTEGER) AS code, target AS label FROM {{learnable}}")
def ml1(t):
    d, _ = L.prepare(t.learnable, "target", "o_orderkey", FEATURES + ["o_orderpriority"])
    v = F.col("vec")
    return d.select("id", F.round(v[0], 4).alias("price"), v[1].cast("long").alias("f1"), v[2].cast("long").alias("f2"), v[3].cast("int").alias("code"), F.col("label").cast("int").alias("label"))


def one(t, name):
    return L.train_all(table(t), CLF, [name])[0]


@query("ML2")
def ml2(t):
    return one(t, "logistic")


@query("ML2_weighted")
def ml2_weighted(t):
    return L.retrain(table(t), CLF, "logistic", ["class_weights"])


@query("ML3")
def ml3(t):
    return L.train_all(reg_table(t), REG, ["linear", "ridge", "lasso", "elastic"])[0]


@query("ML4")
def ml4(t):
    return one(t, "tree")


@query("ML5")
def ml5(t):
    return one(t, "forest")


@query("ML6")
def ml6(t):
    return one(t, "boosted")


@query("ML7")
def ml7(t):
    return one(t, "bayes")


@query("ML8")
def ml8(t):
    return one(t, "svm")


@query("ML9")
def ml9(t):
    train, test = L.split(table(t))
    pred = L.nearest_predict(train, test, CLF)
    return report(pred, [("nearest", round(L.score(pred, CLF), 4))], "model string, score double")


@query("ML10")
def ml10(t):
    return L.qualify(table(t), CLF, ["logistic", "tree", "bayes", "svm"], 2)


@query("ML11")
def ml11(t):
    return L.cross_validate(table(t), CLF, ["tree", "logistic", "bayes"])


@query("ML14")
def ml14(t):
    return L.ranked(L.train_all(table(t), CLF, ["logistic", "tree", "bayes"])[0])


@query("ML14_importance")
def ml14_importance(t):
    _, _, m = fitted(t)
    return report(t.orders, L.importance(m, FEATURES), "feature string, importance double")


@query("ML16")
def ml16(t):
    return L.stack(table(t), CLF, ["tree", "bayes"])


@query("ML17")
def ml17(t):
    return L.blend(table(t), CLF, ["tree", "logistic", "bayes"])


@query("ML18")
def ml18(t):
    return L.bagging(table(t), CLF, "tree", 5)


@query("ML19")
def ml19(t):
    return L.seeds(table(t), CLF, "forest", 5)


@query("ML20")
def ml20(t):
    return L.search(table(t), CLF, "tree", L.grid("tree"), 2)


@query("ML21")
def ml21(t):
    return L.search(table(t), CLF, "logistic", L.draws("logistic", 4), 2)


@query("ML23")
def ml23(t):
    return L.tune(table(t), CLF, ["tree", "logistic"], 2)


@query("ML25")
def ml25(t):
    return L.tournament(table(t), CLF, ["logistic", "tree", "bayes", "svm"])


@query("ML26")
def ml26(t):
    return L.improve(L.split(table(t))[0], CLF, "logistic")


@query("ML27")
def ml27(t):
    d = table(t)
    board, models = L.train_all(d, CLF, ["logistic", "tree"])
    return L.advice(d, board, CLF, importances=L.importance(models["tree"], FEATURES), folds=L.cross_validate(d, CLF, ["logistic", "tree"]))


@query("ML28")
def ml28(t):
    return L.retrain(table(t), CLF, "logistic", ["class_weights", "products", "regularise"])


@query("ML28_components")
def ml28_components(t):
    return L.retrain(table(t), CLF, "logistic", ["products", "components"])


def noisy(t):
    """Labels with some flips, to be found."""
    return table(t).withColumn("label", F.when(F.col("id") % 50 == 0, 1 - F.col("label")).otherwise(F.col("label")))


@query("ML29")
def ml29(t):
    return L.label_errors(noisy(t), "tree", 2)


@query("ML30", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE value > 100)")
def ml30(t):
    return L.without(t.orders.select("o_orderkey", "o_totalprice"), t.events.where("value > 100"), "o_orderkey", "event_id")


@query("ML31")
def ml31(t):
    _, test, m = fitted(t, "tree")
    return L.permutation_importance(test, m, CLF, FEATURES, 10)


@query("ML31_refit")
def ml31_refit(t):
    return L.select_and_refit(table(t), CLF, "tree", FEATURES)


@query("ML32")
def ml32(t):
    return L.compress(table(t), CLF, "forest", FEATURES)


@query("ML33")
def ml33(t):
    d = table(t)
    return L.complexity(d, CLF, L.train_all(d, CLF, ["logistic", "tree", "forest"])[1])


@query("IO15")
def io15(t):
    train, test, m = fitted(t, "logistic")
    path = scratch(t) + "/model"
    m.write().overwrite().save(path)
    again = LogisticRegressionModel.load(path)
    return again.transform(test).select("id", "prediction")


# Forecasts


@query("TS12")
def ts12(t):
    return Z.forecast_leaderboard(t.series, ["event_type"], "day", "total", 7, ["ridge", "lasso", "tree"])


@query("TS13")
def ts13(t):
    return Z.walk_forward(t.series, ["event_type"], "day", "total", "ridge", 3)


@query("TS14")
def ts14(t):
    return Z.forecast_interval(t.series, ["event_type"], "day", "total", 7, "ridge")


# Evaluation with models


@query("EV7")
def ev7(t):
    return S.recalibrate(table(t), "tree")[0]


@query("EV8")
def ev8(t):
    return S.learning_curve(table(t), CLF, "tree", 10)


@query("EV8_plateau")
def ev8_plateau(t):
    return S.plateau(S.learning_curve(table(t), CLF, "tree", 10))


@query("EV8_forecast")
def ev8_forecast(t):
    return S.curve_forecast(S.learning_curve(table(t), CLF, "tree", 10))


@query("EV21")
def ev21(t):
    train, test = L.split(table(t))
    return r(S.data_value(train, test), "value", places=8)


@query("EV22")
def ev22(t):
    _, test, m = fitted(t, "logistic")
    return S.stress(test, m, CLF, FEATURES)


@query("EV22_grade")
def ev22_grade(t):
    _, test, m = fitted(t, "logistic")
    return S.stress_grade(S.stress(test, m, CLF, FEATURES))


@query("EV25")
def ev25(t):
    train, test, m = fitted(t, "logistic")
    return S.shelf_life(train, test, m, CLF, FEATURES)[1]


@query("EV25_volatility")
def ev25_volatility(t):
    train, test, m = fitted(t, "logistic")
    return S.shelf_life(train, test, m, CLF, FEATURES)[0]


@query("DR8")
def dr8(t):
    train, test, m = fitted(t, "logistic")
    return S.model_drift(noisy(t), m, L.score(m.transform(test), CLF), CLF)


# Explanations


@query("EX1", "WITH m AS (SELECT avg(f1) AS a, avg(f2) AS b FROM {learnable}) SELECT o_orderkey AS id, 'f1' AS feature, round(3.0 * (f1 - a), 4) + 0.0 AS contribution FROM {learnable}, m UNION ALL SELECT o_orderkey, 'f2', round(2.0 * (f2 - b), 4) + 0.0 FROM {learnable}, m")
def ex1(t):
    d = L.prepare(t.learnable, "target", "o_orderkey", ["f1", "f2"])[0]
    return r(X.linear_contributions(d, [3.0, 2.0], ["f1", "f2"]), "contribution")


@query("EX1_sampled")
def ex1_sampled(t):
    _, test, m = fitted(t, "tree")
    return r(X.sampled_contributions(test, m, CLF, FEATURES, 3), "contribution")


LINEAR = "(SELECT 3.0 * (f1 - (SELECT avg(f1) FROM {learnable})) AS x, 2.0 * (f2 - (SELECT avg(f2) FROM {learnable})) AS y FROM {learnable})"


@query("EX2", f"SELECT 'f1' AS feature, round(avg(abs(x)), 6) AS strength, round(avg(abs(x)) / (avg(abs(x)) + avg(abs(y))), 4) AS share FROM {LINEAR} a UNION ALL SELECT 'f2', round(avg(abs(y)), 6), round(avg(abs(y)) / (avg(abs(x)) + avg(abs(y))), 4) FROM {LINEAR} b")
def ex2(t):
    d = L.prepare(t.learnable, "target", "o_orderkey", ["f1", "f2"])[0]
    return X.global_strength(X.linear_contributions(d, [3.0, 2.0], ["f1", "f2"]))


@query("EX2_pairs", f"SELECT 'f1' AS feature_1, 'f2' AS feature_2, round(corr(x, y), 4) + 0.0 AS correlation FROM {LINEAR} a")
def ex2_pairs(t):
    d = L.prepare(t.learnable, "target", "o_orderkey", ["f1", "f2"])[0]
    return X.contribution_pairs(X.linear_contributions(d, [3.0, 2.0], ["f1", "f2"]), ["f1", "f2"], 0.0)


@query("EX3")
def ex3(t):
    _, test, m = fitted(t, "logistic")
    return X.what_if(test, m, CLF, FEATURES, test.select("id", F.lit("f1").alias("feature"), F.lit(16.0).alias("value")))


@query("EX4")
def ex4(t):
    train, test, m = fitted(t, "logistic")
    return X.counterfactuals(test, train, m, FEATURES)


@query("EX5")
def ex5(t):
    _, test, m = fitted(t, "tree")
    return X.partial_dependence(test, m, CLF, FEATURES, ["price", "f1", "f2"], 50)


@query("EX5_curves")
def ex5_curves(t):
    _, test, m = fitted(t, "tree")
    return X.individual_curves(test, m, CLF, FEATURES, "f1")


@query("EX6")
def ex6(t):
    _, test, m = fitted(t, "tree")
    return X.interactions(test, m, CLF, FEATURES)


@query("EX6_forest")
def ex6_forest(t):
    _, test, m = fitted(t, "forest")
    return X.interactions(test, m, CLF, FEATURES)


@query("EX6_sampled")
def ex6_sampled(t):
    _, test, m = fitted(t, "logistic")
    return X.interactions(test, m, CLF, FEATURES)


@query("EX7")
def ex7(t):
    train, test, m = fitted(t, "logistic")
    return X.review(test, train, m, FEATURES)


# Scoring


@query("SC1")
def sc1(t):
    _, _, m = fitted(t, "logistic")
    return S.score_batch(t.learnable.select("o_orderkey", F.col("price").cast("string").alias("price"), "f1"), m, FEATURES, "o_orderkey", ["low", "high"])


@query("SC2", f"SELECT count(*) AS n, {rnd('avg(prediction)')} AS mean, {rnd('median(prediction)')} AS median, {rnd('stddev_pop(prediction)')} AS std, {rnd('min(prediction)')} AS min, {rnd('max(prediction)')} AS max FROM {{reg_predictions}}")
def sc2(t):
    return S.score_summary(t.reg_predictions)


@query("SC2_classes", "SELECT prediction, count(*) AS n FROM {predictions} GROUP BY 1")
def sc2_classes(t):
    return S.score_summary(t.predictions, "prediction", numeric=False)


@query("SC3", "SELECT c_custkey, CASE WHEN flag_text = 'Yes' THEN 1.0 ELSE 0.0 END AS flag, coalesce(TRY_CAST(mostly_number AS DOUBLE), 0.0) AS num FROM {text_numbers}")
def sc3(t):
    return t.text_numbers.select("c_custkey", S.feature_number(F.col("flag_text")).alias("flag"), S.feature_number(F.col("mostly_number")).alias("num"))
