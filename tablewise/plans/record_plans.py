"""Sources, sinks, experiment tables and metadata over the source tables."""

from uuid import uuid4

from pyspark.sql import functions as F

from tablewise.operators import experiments as X
from tablewise.operators import metadata as M
from tablewise.operators.measures import report
from tablewise.plans.explore_plans import _outliers
from tablewise.plans.registry import query
from tablewise.plans.sqltext import rnd, union
from tablewise.session import shared_folder
from tablewise.sources import files as IO
from tablewise.sources.experiment_store import ExperimentStore


def scratch(t) -> str:
    """A new folder for written tables, inside the shared folder."""
    return f"{shared_folder(t.spark)}/{uuid4().hex}"


@query("IO1", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def io1(t):
    path = IO.export_csv(t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), scratch(t) + "/orders.csv")
    return IO.read_table(t.spark, path)


@query("IO2", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def io2(t):
    path = scratch(t) + "/customer.tsv"
    t.customer.select("c_custkey", "c_name", "c_acctbal").write.option("header", True).option("sep", "\t").csv(path)
    return IO.read_table(t.spark, path)


@query("IO3", "SELECT p_partkey, p_name, p_size FROM part")
def io3(t):
    path = scratch(t) + "/part.jsonl"
    t.part.select("p_partkey", "p_name", "p_size").write.json(path)
    return IO.read_table(t.spark, path)


@query("IO4", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 49")
def io4(t):
    return IO.read_table(t.spark, f"{t.folder}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate").where("l_quantity > 49")


@query("IO7", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, coalesce(priority, 'NaN') AS priority FROM {dirty_orders} ORDER BY CAST(o_orderkey AS BIGINT), priority NULLS FIRST LIMIT 10")
def io7(t):
    return IO.preview(t.dirty_orders.select("o_orderkey", "priority"), "o_orderkey")


@query("IO8", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def io8(t):
    return IO.parse_records(t.events.select("event_id", "props"), "props", "k bigint")


@query("IO9", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def io9(t):
    return IO.narrow_numbers(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))[0]


@query("IO9_report", "SELECT 'o_orderkey' AS \"column\", 'bigint' AS type_before, 'int' AS type_after, count(*) * 8 AS bytes_before, count(*) * 4 AS bytes_after FROM orders UNION ALL SELECT 'o_custkey', 'bigint', 'int', count(*) * 8, count(*) * 4 FROM orders UNION ALL SELECT 'o_totalprice', 'double', 'double', count(*) * 8, count(*) * 8 FROM orders")
def io9_report(t):
    return IO.narrow_numbers(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"))[1]


@query("IO10", "SELECT o_orderkey, priority FROM {dirty_orders} WHERE price IS NOT NULL")
def io10(t):
    path = IO.write_table(t.dirty_orders.where("price is not null").select("o_orderkey", "priority"), scratch(t) + "/out.parquet")
    return t.spark.read.parquet(path)


@query("IO11", "SELECT s_suppkey, s_name FROM supplier")
def io11(t):
    path = IO.export_csv(t.supplier.select("s_suppkey", "s_name"), scratch(t) + "/supplier.csv")
    return t.spark.read.schema("s_suppkey long, s_name string").option("header", True).csv(path)


@query("IO12", "SELECT * FROM part")
def io12(t):
    base = scratch(t)
    IO.save_snapshot(t.part, base, "After Load")
    IO.save_snapshot(t.supplier, base, "Other table")
    return IO.restore_snapshot(t.spark, base, "after load")


@query("IO12_list", "SELECT 'after_load' AS label, count(*) AS n_rows, 6 AS n_columns FROM part UNION ALL SELECT 'other_table', count(*), 4 FROM supplier")
def io12_list(t):
    base = scratch(t)
    IO.save_snapshot(t.part, base, "After Load")
    IO.save_snapshot(t.supplier, base, "Other table")
    return IO.list_snapshots(t.spark, base).select("label", "n_rows", "n_columns")


@query("IO13")
def io13(t):
    return IO.fingerprint(t.orders)


@query("IO14", "SELECT o_orderpriority, count(*) AS n, true AS reused FROM orders GROUP BY 1")
def io14(t):
    base = scratch(t)
    step = lambda d: d.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    IO.cached_step(t.orders, base, "counts", step)
    out, reused = IO.cached_step(t.orders, base, "counts", step)
    return out.withColumn("reused", F.lit(reused))


# Experiment tables


@query("XP1", "SELECT id, CASE WHEN score > 0.9 THEN 'reviewed' ELSE status END AS status, CASE WHEN score > 0.9 THEN 2 ELSE 1 END AS version FROM {experiments}")
def xp1(t):
    e = t.experiments.select("id", "status", "score").withColumn("version", F.lit(1))
    changed = e.where("score > 0.9").withColumns({"status": F.lit("reviewed"), "version": F.lit(2)})
    path = scratch(t) + "/experiments"
    e.write.mode("append").parquet(path)
    changed.write.mode("append").parquet(path)
    return X.latest_submission(t.spark.read.parquet(path).select("id", "status", "version"), "id", "version")


@query("XP2", "SELECT id, name, score, (SELECT count(*) FROM {experiments} WHERE name LIKE '%7%') AS total FROM {experiments} WHERE name LIKE '%7%' ORDER BY score DESC, id LIMIT 20 OFFSET 10")
def xp2(t):
    return X.list_experiments(t.experiments, 20, 10, "7", ["name"], sort_by="score").select("id", "name", "score", "total")


@query("XP3", "SELECT e.id, e.name, m.model AS model_name, round(m.metric, 6) AS primary_metric, row_number() OVER (PARTITION BY e.id ORDER BY m.metric DESC, m.model) AS model_rank FROM {experiments} e JOIN {runs} m ON m.experiment_id = e.id")
def xp3(t):
    runs = t.runs.select("experiment_id", F.col("model").alias("model_name"), F.col("metric").alias("primary_metric"))
    return X.with_models(t.experiments.select("id", "name"), runs).withColumn("primary_metric", F.round("primary_metric", 6))


@query("XP3_steps", "SELECT e.id, e.name, a.label AS step, a.value AS result_data, a.created_at AS step_at FROM {experiments} e LEFT JOIN {annotations} a ON a.experiment_id = e.id")
def xp3_steps(t):
    results = t.annotations.select("experiment_id", F.col("label").alias("step"), F.col("value").alias("result_data"), "created_at")
    return X.with_steps(t.experiments.select("id", "name"), results)


@query("XP3_newest", "SELECT session_id, id, created_at, value FROM (SELECT experiment_id AS session_id, id, created_at, value, row_number() OVER (PARTITION BY experiment_id ORDER BY created_at DESC, id DESC) AS k FROM {annotations}) x WHERE k = 1")
def xp3_newest(t):
    return X.newest_of_session(t.annotations.select(F.col("experiment_id").alias("session_id"), "id", "created_at", "value"))


@query("XP4_parameters", """SELECT * FROM (SELECT name, max(value) FILTER (WHERE experiment_id = 10) AS a, max(value) FILTER (WHERE experiment_id = 20) AS b FROM (
SELECT experiment_id, model || '.depth' AS name, CAST(experiment_id * 3 % 8 AS VARCHAR) AS value FROM {runs} UNION ALL SELECT experiment_id, model || '.seed', '42' FROM {runs}
UNION ALL SELECT experiment_id, model || '.early', 'yes' FROM {runs} WHERE experiment_id % 20 = 0) p WHERE experiment_id IN (10, 20) GROUP BY 1) x WHERE a IS DISTINCT FROM b""")
def xp4_parameters(t):
    n = lambda end: F.concat("model", F.lit(end))
    given = F.create_map(n(".depth"), (F.col("experiment_id") * 3 % 8).cast("string"), n(".seed"), F.lit("42"))
    given = F.when(F.col("experiment_id") % 20 == 0, F.map_concat(given, F.create_map(n(".early"), F.lit("yes")))).otherwise(given)
    return X.changed_parameters(t.runs.select(F.col("experiment_id").alias("id"), given.alias("hyperparameters")), 10, 20)


@query("XP4", """SELECT name, a, b, round(b - a, 4) + 0.0 AS delta, CASE WHEN a > b THEN '10' WHEN b > a THEN '20' ELSE 'tie' END AS winner, CAST(rank() OVER (ORDER BY a DESC) AS INTEGER) AS rank_a, CAST(rank() OVER (ORDER BY b DESC) AS INTEGER) AS rank_b FROM (
SELECT model AS name, max(metric) FILTER (WHERE experiment_id = 10) AS a, max(metric) FILTER (WHERE experiment_id = 20) AS b FROM {runs} WHERE experiment_id IN (10, 20) GROUP BY 1) x""")
def xp4(t):
    return X.compare_values(t.runs.select(F.col("experiment_id").alias("id"), F.col("model").alias("name"), F.col("metric").alias("value")), 10, 20)


@query("XP5", union([f"SELECT 'all' AS problem_type, count(*) AS total, count(*) FILTER (WHERE status = 'complete') AS complete, {rnd('avg(score)')} AS mean_score FROM {{experiments}}",
                     f"SELECT problem_type, count(*), count(*) FILTER (WHERE status = 'complete'), {rnd('avg(score)')} FROM {{experiments}} GROUP BY 1"]))
def xp5(t):
    return X.statistics(t.experiments)


@query("XP6", "SELECT 'BUILDING' AS gone, (SELECT count(*) - 1 FROM {experiments} WHERE dataset_type = 'BUILDING') AS experiments_left")
def xp6(t):
    store = ExperimentStore(t.spark, scratch(t))
    rows = t.experiments.where("dataset_type = 'BUILDING'")
    first = rows.agg(F.min("id")).first()[0]
    full = rows.select(F.col("id").cast("string").alias("id"), "name", F.col("score").alias("best_score"), "status")
    blank = t.spark.createDataFrame([], _wide("experiments"))
    full = blank.unionByName(full.withColumns({"version": F.lit("0"), "gone": F.lit(False)}), allowMissingColumns=True)
    full.write.mode("append").parquet(f"{store.base}/experiments")
    for kind in ("results", "models", "fingerprints"):
        store.append(kind, [dict(id="1", experiment_id=str(first))])
    store.delete(str(first))
    n = store.newest("experiments").count() + sum(store.newest(k).count() for k in ("results", "models", "fingerprints"))
    return report(t.experiments, [("BUILDING", n)], "gone string, experiments_left long")


def _wide(kind):
    from tablewise.sources.experiment_store import SCHEMAS

    return SCHEMAS[kind] + ", version string, gone boolean"


@query("XP7", "SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM {experiments} WHERE problem_type = 'regression' ORDER BY score DESC, id LIMIT 20")
def xp7(t):
    return X.leaderboard(t.experiments, where=F.col("problem_type") == "regression").select("id", "score", "rank")


@query("XP8", f"SELECT id, dataset_type, score, r AS rank, n, {rnd('100.0 * (n - r) / n', 2)} AS percentile, {rnd('top - score')} AS gap FROM (SELECT id, dataset_type, score, row_number() OVER (PARTITION BY dataset_type ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY dataset_type) AS n, max(score) OVER (PARTITION BY dataset_type) AS top FROM {{experiments}}) x")
def xp8(t):
    return X.standing(t.experiments, "dataset_type")


@query("XP9", "SELECT experiment_id, count(*) AS total, count(*) FILTER (WHERE label = 'correct') AS correct, count(*) FILTER (WHERE label = 'incorrect') AS incorrect, count(*) FILTER (WHERE label = 'uncertain') AS uncertain, round(1.0 * count(*) FILTER (WHERE label = 'correct') / nullif(count(*) FILTER (WHERE label IN ('correct', 'incorrect')), 0), 4) AS accuracy FROM {annotations} GROUP BY 1")
def xp9(t):
    return X.annotation_summary(t.annotations)


@query("XP9_list", "SELECT id, label FROM {annotations} ORDER BY created_at DESC, id LIMIT 100")
def xp9_list(t):
    return X.annotations_newest_first(t.annotations).select("id", "label")


@query("XP10", """WITH bad AS (SELECT * FROM orders WHERE o_totalprice > 450000 AND o_orderstatus = 'F'),
z AS (SELECT abs((SELECT avg(o_totalprice) FROM bad) - avg(o_totalprice)) / stddev_samp(o_totalprice) AS z FROM orders),
c AS (SELECT o_orderstatus AS v, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM bad) AS pb FROM bad GROUP BY 1), a AS (SELECT o_orderstatus AS v, count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM orders) AS pa FROM orders GROUP BY 1)
SELECT 'o_totalprice' AS feature, 'value_cluster' AS kind, CAST(NULL AS VARCHAR) AS value, round(z, 2) AS strength FROM z WHERE z > 1.5 UNION ALL SELECT 'o_orderstatus', 'category_cluster', v, round(pb / greatest(pa, 0.01), 2) FROM c JOIN a USING (v) WHERE pb > 1.5 * pa AND pb > 0.2""")
def xp10(t):
    o = t.orders
    return X.failure_patterns(o, o.where("o_totalprice > 450000 and o_orderstatus = 'F'").select("o_orderkey"), "o_orderkey", ["o_totalprice", "o_custkey", "o_orderstatus"], top=5, limit=10)


@query("ML24", "SELECT id, score, cost FROM {experiments} e WHERE NOT EXISTS (SELECT 1 FROM {experiments} o WHERE o.score >= e.score AND o.cost <= e.cost AND (o.score > e.score OR o.cost < e.cost))")
def ml24(t):
    return X.pareto_front(t.experiments.select("id", "score", "cost"), "score", "cost")


@query("ML24_three", """WITH e AS (SELECT id, score, cost, id * 11 % 23 AS size FROM {experiments})
SELECT id, score, cost, size FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.score >= e.score AND o.cost <= e.cost AND o.size <= e.size AND (o.score > e.score OR o.cost < e.cost OR o.size < e.size))""")
def ml24_three(t):
    return X.skyline(t.experiments.select("id", "score", "cost", F.expr("id * 11 % 23").alias("size")), ["score"], ["cost", "size"])


# Metadata

FP = ["o_orderkey", "price", "cust", "sparse", "sentinel_price"]
FPC = [(a, b) for j, b in enumerate(FP) for a in FP[:j]]
COR = "(" + " + ".join("(" + " + ".join(f"abs(corr({a}, {b}))" for a in FP[:j]) + f") / {j}.0" for j, b in enumerate(FP) if j) + ") / 4.0"
ALL = FP + ["priority", "constant_col", "o_orderdate"]
DUP = f"(SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM {{dirty_orders}} GROUP BY {', '.join(ALL)}) g)"


@query("MD1", f"""SELECT count(*) AS n_rows, 8 AS n_cols, 0.625 AS numeric_ratio, 0.25 AS text_ratio, {rnd('(' + ' + '.join(f'100.0 * (count(*) - count({c})) / count(*)' for c in ALL) + ') / 8', 2)} AS missing_pct,
{rnd('(' + ' + '.join(f'count(DISTINCT {c})' for c in ALL) + ') / 8.0 / count(*)')} AS cardinality_ratio, {rnd(f'100.0 * {DUP} / count(*)', 2)} AS duplicate_pct,
{rnd('(' + ' + '.join(f'abs(skewness({c}))' for c in FP) + ') / 5')} AS skewness, {rnd('(' + ' + '.join(f'abs(kurtosis({c}))' for c in FP) + ') / 5')} AS kurtosis, {rnd(COR)} AS correlation,
'classification' AS target_type, count(DISTINCT priority) AS n_classes, (SELECT round((1.0 * max(n) / sum(n)) / greatest(1.0 * min(n) / sum(n), 0.01), 2) FROM (SELECT count(*) AS n FROM {{dirty_orders}} WHERE priority IS NOT NULL GROUP BY priority) c) AS imbalance,
CASE WHEN count(*) < 500 THEN 'tiny' WHEN count(*) < 5000 THEN 'small' WHEN count(*) < 50000 THEN 'medium' ELSE 'large' END AS size FROM {{dirty_orders}}""")
def md1(t):
    return M.table_fingerprint(t.dirty_orders, "priority")


@query("MD2", "WITH q AS (SELECT list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), e), 4) + 0.0 AS similarity FROM embeddings, q ORDER BY similarity DESC, vec_id LIMIT 3")
def md2(t):
    wanted = [float(v) for v in t.embeddings.where("vec_id = 0").first()["embedding"]]
    return M.most_similar(t.embeddings, "vec_id", "embedding", wanted, 3)


@query("MD2_vector")
def md2_vector(t):
    return M.table_fingerprint(t.orders, "o_orderpriority").select(M.fingerprint_vector().alias("vector"))


@query("MD3", "WITH s AS (SELECT id FROM {experiments} ORDER BY score DESC, id LIMIT 50), b AS (SELECT e.* FROM {experiments} e JOIN s USING (id)) SELECT dataset_type AS model, count(*) AS n, (SELECT round(avg(score), 4) FROM b) AS mean_score, (SELECT count(*) FROM b) AS based_on FROM b GROUP BY 1 ORDER BY n DESC, model LIMIT 3")
def md3(t):
    e = t.experiments
    return M.settings_advice(e.orderBy(F.desc("score"), "id").limit(50), e, model="dataset_type")


@query("MD3_similar", """WITH v AS (SELECT id, dataset_type, score, [score, (1 + cost) / 20.0, (id % 5) / 5.0] AS v FROM {experiments}), q AS (SELECT v AS w FROM v WHERE id = 1),
b AS (SELECT dataset_type, score FROM v, q ORDER BY round(list_cosine_similarity(v, w), 4) DESC, id LIMIT 50)
SELECT dataset_type AS model, count(*) AS n, (SELECT round(avg(score), 4) FROM b) AS mean_score, (SELECT count(*) FROM b) AS based_on FROM b GROUP BY 1 ORDER BY n DESC, model LIMIT 3""")
def md3_similar(t):
    e = t.experiments.withColumn("v", F.array(F.col("score"), (1 + F.col("cost")) / 20.0, (F.col("id") % 5) / 5.0))
    wanted = [float(x) for x in e.where("id = 1").first()["v"]]
    return M.settings_advice(M.most_similar(e, "id", "v", wanted, 50), e, model="dataset_type")


LN = ["o_orderkey", "price", "f1", "f2"]
LCOR = "(" + " + ".join("(" + " + ".join(f"abs(corr({a}, {b}))" for a in LN[:j]) + f") / {j}.0" for j, b in enumerate(LN) if j) + ") / 3.0"
DNA = f"""WITH m AS (SELECT count(*) AS n_rows, 5 AS n_features, 4 AS n_numeric, 1 AS n_categorical, round(5.0 / count(*), 6) AS dimensionality_ratio, ln(1 + count(*)) AS log_n_rows, 0.0 AS missing_pct, 0 AS cols_with_missing, 0.0 AS duplicate_pct,
({' + '.join(f'abs(skewness({c}))' for c in LN)}) / 4 AS mean_skewness, greatest({', '.join(f'abs(skewness({c}))' for c in LN)}) AS max_skewness, ({' + '.join(f'abs(kurtosis({c}))' for c in LN)}) / 4 AS mean_kurtosis,
({' + '.join(f'stddev_samp({c}) / abs(avg({c}))' for c in LN)}) / 4 AS mean_coefficient_of_variation, {LCOR} AS mean_abs_correlation, greatest({', '.join(f'abs(corr({a}, {b}))' for j, b in enumerate(LN) for a in LN[:j])}) AS max_abs_correlation, 0 AS highly_correlated_pairs,
(SELECT sum(n_outliers) FROM ({_outliers(LN, '{learnable}')}) o) / (4.0 * count(*)) AS outlier_density, count(DISTINCT target) AS n_classes, entropy(target) * ln(2) AS class_entropy,
greatest(sum(target), count(*) - sum(target)) * 1.0 / least(sum(target), count(*) - sum(target)) AS imbalance_ratio, 100.0 * least(sum(target), count(*) - sum(target)) / count(*) AS minority_pct,
count(DISTINCT o_orderpriority) AS mean_cardinality, count(DISTINCT o_orderpriority) AS max_cardinality, 0.2 AS categorical_ratio FROM {{learnable}})"""
DNA_NAMES = "n_rows n_features n_numeric n_categorical dimensionality_ratio log_n_rows missing_pct cols_with_missing duplicate_pct mean_skewness max_skewness mean_kurtosis mean_coefficient_of_variation mean_abs_correlation max_abs_correlation highly_correlated_pairs outlier_density n_classes class_entropy imbalance_ratio minority_pct mean_cardinality max_cardinality categorical_ratio".split()


@query("MD4", DNA + " " + union(f"SELECT '{k}' AS measure, {rnd(k, 6 if k == 'dimensionality_ratio' else 4)} AS value FROM m" for k in DNA_NAMES))
def md4(t):
    return M.dna(t.learnable, "target")


@query("MD6_contribute", DNA + " " + union(f"SELECT 'run_7' AS id, 'classification' AS problem_type, 'forest' AS best_model, 0.91 AS score, '{k}' AS measure, {rnd(k, 6 if k == 'dimensionality_ratio' else 4)} AS value FROM m" for k in DNA_NAMES))
def md6_contribute(t):
    return M.contribute(M.dna(t.learnable, "target"), "run_7", "forest", 0.91, "classification")


KNOW = "SELECT id, status AS best_model, score, 'n_rows' AS measure, CAST(1000 + id * 17 AS DOUBLE) AS value FROM {experiments} UNION ALL SELECT id, status, score, 'n_features', CAST(3 + id % 9 AS DOUBLE) FROM {experiments}"


@query("MD6", f"""WITH k AS ({KNOW}), w AS (SELECT 'n_rows' AS measure, CAST(count(*) AS DOUBLE) AS want FROM {{learnable}} UNION ALL SELECT 'n_features', 5.0),
s AS (SELECT id, max(best_model) AS best_model, avg(greatest(0.0, 1 - abs(value - want) / greatest(abs(value), abs(want), 1e-8))) AS sim FROM k JOIN w USING (measure) GROUP BY 1 ORDER BY sim DESC, id LIMIT 5),
v AS (SELECT best_model, count(*) AS n, sum(sim) AS v FROM s GROUP BY 1) SELECT best_model, n, round(v, 4) AS votes, round(v / greatest((SELECT sum(v) FROM v), 1.0), 2) AS confidence FROM v""")
def md6(t):
    e = t.experiments
    know = e.select("id", F.col("status").alias("best_model"), "score", F.lit("n_rows").alias("measure"), (1000.0 + F.col("id") * 17).alias("value")).union(
        e.select("id", "status", "score", F.lit("n_features"), (3.0 + F.col("id") % 9)))
    wanted = M.dna(t.learnable, "target").where("measure in ('n_rows', 'n_features')")
    return M.recommend(know, wanted, 5)


@query("MD6_stats", "SELECT status AS best_model, count(DISTINCT id) AS experiments, round(avg(score), 4) AS mean_score FROM {experiments} GROUP BY 1")
def md6_stats(t):
    return M.knowledge_stats(t.experiments.select("id", F.col("status").alias("best_model"), "score"))


@query("MD7", f"SELECT count(*) AS n_rows, 8 AS n_columns, 'priority' AS target, {rnd('(' + ' + '.join(f'100.0 * (count(*) - count({c})) / count(*)' for c in ALL) + ') / 8', 2)} AS missing_pct, (SELECT name FROM {{experiments}} ORDER BY score DESC, id LIMIT 1) AS best_model, (SELECT max(score) FROM {{experiments}}) AS best_score FROM {{dirty_orders}}")
def md7(t):
    from tablewise.operators.quality import table_quality

    top = X.leaderboard(t.experiments, limit=1).first()
    quality = table_quality(t.dirty_orders, "priority").first()["overall_score"]
    return M.overview_row(t.dirty_orders, "priority", top["name"], top["score"], quality, 100.0, "healthy").drop("quality", "fairness", "drift")
