"""Sampling, synthesis, clustering, anomalies, rules, topics and effects over the source tables."""

from pyspark.sql import functions as F

from tablewise.operators import anomalies as A
from tablewise.operators import clusters as C
from tablewise.operators import patterns as P
from tablewise.operators import sampling as S
from tablewise.operators.measures import report
from tablewise.plans.feature_plans import r
from tablewise.plans.registry import query
from tablewise.plans.sqltext import rnd, union

NUM = ["value", "near_copy", "small_int"]


def U(key, seed=42):
    return f"CAST('0x' || substr(md5({key} || ':{seed}'), 1, 13) AS BIGINT)"


@query("SM1", f"SELECT o_orderkey, target FROM (SELECT o_orderkey, target, row_number() OVER (PARTITION BY target ORDER BY {U('o_orderkey')}, o_orderkey) AS k, count(*) OVER (PARTITION BY target) AS n, count(*) OVER () AS t FROM {{learnable}}) x WHERE k <= greatest(1, floor(n * 2000.0 / t))")
def sm1(t):
    return S.stratified(t.learnable.select("o_orderkey", "target"), "target", "o_orderkey", 2000)


@query("SM2")
def sm2(t):
    return S.boundary(t.learnable, "target", "o_orderkey", ["f1", "f2"], 1000).select("o_orderkey", "target", "part")


@query("SM3")
def sm3(t):
    return S.diverse(t.learnable, "o_orderkey", ["price", "f1", "f2"], 1000).select("o_orderkey", "target")


@query("SM4", f"WITH s AS (SELECT target FROM (SELECT target, row_number() OVER (PARTITION BY target ORDER BY {U('o_orderkey')}, o_orderkey) AS k, count(*) OVER (PARTITION BY target) AS n, count(*) OVER () AS t FROM {{learnable}}) x WHERE k <= greatest(1, floor(n * 3000.0 / t))) SELECT CAST(target AS VARCHAR) AS label, round(count(*) / (SELECT CAST(count(*) AS DOUBLE) FROM {{learnable}}), 6) AS before, (SELECT round(count(*) FILTER (WHERE s.target = l.target) / CAST(count(*) AS DOUBLE), 6) FROM s) AS after, 'stratified' AS strategy FROM {{learnable}} l GROUP BY target")
def sm4(t):
    return r(S.subsample(t.learnable.select("o_orderkey", "target", "f1"), "target", "o_orderkey", 3000, ["f1"])[1], "before", "after", places=6)


@query("SM5", f"SELECT o_orderkey, CASE WHEN k <= round(n * 0.25) THEN 'test' ELSE 'train' END AS split FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY target ORDER BY {U('o_orderkey')}, o_orderkey) AS k, count(*) OVER (PARTITION BY target) AS n FROM {{learnable}}) x")
def sm5(t):
    return S.split(t.learnable.select("o_orderkey", "target"), "target", "o_orderkey").select("o_orderkey", "split")


@query("SM6", f"SELECT event_id, rare FROM (SELECT *, row_number() OVER (PARTITION BY rare ORDER BY {U('event_id')}, event_id) AS k, min(n) OVER () AS m FROM (SELECT event_id, value > 300 AS rare, count(*) OVER (PARTITION BY value > 300) AS n FROM events) x) y WHERE k <= m")
def sm6(t):
    return S.undersample(t.events.select("event_id", (F.col("value") > 300).alias("rare")), "rare", "event_id", least=5000)


def balance(df, label):
    return df.groupBy(label).agg(F.count("*").alias("n"), F.count_if("synthetic").alias("made"))


@query("SM7", "SELECT target, (SELECT max(n) FROM (SELECT count(*) AS n FROM {learnable} GROUP BY target) z) AS n, (SELECT max(n) FROM (SELECT count(*) AS n FROM {learnable} GROUP BY target) z) - count(*) AS made FROM {learnable} GROUP BY target")
def sm7(t):
    return balance(S.smote(t.learnable, "target", "o_orderkey", ["price", "f1", "f2"]), "target")


@query("SM8")
def sm8(t):
    return balance(S.adasyn(t.learnable, "target", "o_orderkey", ["price", "f1", "f2"]), "target")


@query("SM9")
def sm9(t):
    return balance(S.borderline_smote(t.learnable, "target", "o_orderkey", ["price", "f1", "f2"]), "target")


@query("SM10")
def sm10(t):
    return S.synthetic_numbers(t.skewed, NUM, t.skewed.count())


def _drawn(c, i):
    u = f"CAST('0x' || substr(md5(id || ':42:{200 + i}'), 1, 13) AS BIGINT) / 4503599627370496.0"
    return f"(SELECT id, {c} FROM (SELECT id, CAST(floor({u} * n) AS BIGINT) AS pos FROM (SELECT unnest(range(0, (SELECT count(*) FROM orders))) AS id) g, (SELECT count(*) AS n FROM orders) m) d JOIN (SELECT {c}, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) o USING (pos))"


@query("SM11", f"SELECT id, o_orderstatus, o_orderpriority FROM {_drawn('o_orderstatus', 0)} a JOIN {_drawn('o_orderpriority', 1)} b USING (id)")
def sm11(t):
    df = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return S.synthetic_categories(df, ["o_orderstatus", "o_orderpriority"], df.count(), "o_orderkey")


@query("SM12", "SELECT target, 5000 AS n FROM {learnable} GROUP BY 1")
def sm12(t):
    return S.enforce_shares(t.learnable, "target", "o_orderkey", {0: 0.5, 1: 0.5}, 10_000).groupBy("target").agg(F.count("*").alias("n"))


@query("SM13")
def sm13(t):
    made = S.synthetic_numbers(t.skewed, NUM, t.skewed.count())
    ev = t.events.select("event_id", "event_type")
    return S.synthetic_quality(t.skewed, made, NUM, []).union(
        S.synthetic_quality(ev, S.synthetic_categories(ev, ["event_type"], ev.count(), "event_id"), [], ["event_type"]))


# Clustering


@query("UN1")
def un1(t):
    return C.kmeans_scan(t.skewed, "event_id", NUM, 5)


CH = """WITH g AS (SELECT event_type AS g, count(*) AS n, avg(value) AS a, avg(small_int) AS b, var_pop(value) AS va, var_pop(small_int) AS vb FROM {skewed} GROUP BY 1),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * (pow(a - (SELECT avg(value) FROM {skewed}), 2) + pow(b - (SELECT avg(small_int) FROM {skewed}), 2))) AS bt, sum(n * (va + vb)) AS wt FROM g)"""


@query("UN2", CH + " SELECT k AS clusters, round(bt, 2) AS between, round(wt, 2) AS within, round((bt / (k - 1)) / (wt / (n - k)), 4) AS score FROM s")
def un2(t):
    return C.calinski_harabasz(t.skewed, ["value", "small_int"], "event_type")


@query("UN3")
def un3(t):
    return C.dbscan(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"]).groupBy("cluster").agg(F.count("*").alias("n"))


@query("UN4")
def un4(t):
    return C.hierarchical(t.skewed, "event_id", NUM, 4).groupBy("cluster").agg(F.count("*").alias("n"))


@query("UN5")
def un5(t):
    return C.mixtures(t.skewed, "event_id", ["value", "small_int"], 3)


@query("UN6")
def un6(t):
    return C.spectral(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"], 3).groupBy("cluster").agg(F.count("*").alias("n"))


@query("UN7", union(f"SELECT event_type AS cluster, count(*) AS size, {rnd('100.0 * count(*) / (SELECT count(*) FROM {skewed})', 1)} AS pct, '{c}' AS feature, {rnd(f'avg({c})', 3)} AS mean, {rnd(f'median({c})', 3)} AS median, {rnd(f'stddev_samp({c})', 3)} AS std, (SELECT {rnd(f'avg({c})', 3)} FROM {{skewed}}) AS overall_mean FROM {{skewed}} GROUP BY 1" for c in ("value", "near_copy")))
def un7(t):
    return C.cluster_profiles(t.skewed, ["value", "near_copy"], "event_type")


@query("UN7_stability")
def un7_stability(t):
    return C.stability(t.skewed, "event_id", NUM, 3, 3)


# Anomalies


@query("UN8")
def un8(t):
    return r(A.flag_top(A.isolation_scores(t.skewed, "event_id", NUM), 0.05), "score")


@query("UN9")
def un9(t):
    return r(A.flag_top(A.local_outlier_factor(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"]), 0.05), "score")


@query("UN10", "SELECT event_id AS id, round(z, 4) AS score, CASE WHEN z > 3 THEN 1 ELSE 0 END AS flag FROM (SELECT event_id, greatest(abs((value - a) / s), abs((small_int - b) / u)) AS z FROM {skewed}, (SELECT avg(value) AS a, stddev_pop(value) AS s, avg(small_int) AS b, stddev_pop(small_int) AS u FROM {skewed}) m) x")
def un10(t):
    return r(A.z_vote(t.skewed, "event_id", ["value", "small_int"]), "score")


@query("UN11", """WITH m AS (SELECT avg(value) AS a, avg(small_int) AS b, var_samp(value) AS va, var_samp(small_int) AS vb, covar_samp(value, small_int) AS c FROM {skewed}),
d AS (SELECT event_id, sqrt(((value - a) * (value - a) * vb - 2 * c * (value - a) * (small_int - b) + (small_int - b) * (small_int - b) * va) / (va * vb - c * c)) AS d FROM {skewed}, m)
SELECT event_id AS id, round(d, 4) AS score, CASE WHEN d > (SELECT quantile_cont(d, 0.95) FROM d) THEN 1 ELSE 0 END AS flag FROM d""")
def un11(t):
    return r(A.mahalanobis(t.skewed, "event_id", ["value", "small_int"]), "score")


@query("UN12")
def un12(t):
    return A.detection_summary(A.detect(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"]))


@query("UN12_top")
def un12_top(t):
    return A.top_anomalies(A.detect(t.customer, "c_custkey", ["c_acctbal", "c_nationkey"]))


@query("UN13")
def un13(t):
    return A.explain(t.skewed, "event_id", ["value", "small_int", "heavy"]).withColumn("features", F.array_join("features", ","))


@query("UN14")
def un14(t):
    return C.coordinates(t.skewed, "event_id", ["value", "heavy", "near_copy", "small_int"])[1]


@query("UN14_points")
def un14_points(t):
    return r(C.coordinates(t.skewed, "event_id", ["value", "heavy", "near_copy", "small_int"])[0], "pc1", "pc2")


# Rules, topics, effects

FLAGS = ["view_flag", "click_flag", "purchase_flag", "error_flag"]


def basket(t):
    return P.baskets(t.baskets.withColumn("key", F.concat_ws("-", "user_id", "day")), "key", FLAGS)


@query("UN15", "SELECT user_id || '-' || day AS id, concat_ws(',', " + ", ".join(f"CASE WHEN {f} = 1 THEN '{f}' END" for f in FLAGS) + ") AS items FROM {baskets}")
def un15(t):
    return basket(t).withColumn("items", F.array_join("items", ","))


SETS = union(f"SELECT '{','.join(sorted(s))}' AS items, {len(s)} AS k, count(*) FILTER (WHERE {' AND '.join(f'{f} = 1' for f in s)}) AS n, 1.0 * count(*) FILTER (WHERE {' AND '.join(f'{f} = 1' for f in s)}) / count(*) AS support FROM {{baskets}}"
             for n in (1, 2, 3) for s in __import__("itertools").combinations(FLAGS, n))


@query("UN16", f"SELECT items, n, round(support, 4) AS support FROM ({SETS}) s WHERE support >= 0.05")
def un16(t):
    return P.itemsets(basket(t)).select(F.array_join("items", ",").alias("items"), "n", F.round("support", 4).alias("support"))


def _rules():
    from itertools import combinations

    parts = []
    for n in (2, 3):
        for s in combinations(sorted(FLAGS), n):
            for c in s:
                a = [x for x in s if x != c]
                cond = lambda xs: " AND ".join(f"{x} = 1" for x in xs)
                parts.append(f"SELECT '{','.join(a)}' AS antecedent, '{c}' AS consequent, avg(CASE WHEN {cond(s)} THEN 1.0 ELSE 0.0 END) AS s, avg(CASE WHEN {cond(a)} THEN 1.0 ELSE 0.0 END) AS sa, avg(CASE WHEN {c} = 1 THEN 1.0 ELSE 0.0 END) AS sc FROM {{baskets}}")
    return union(parts)


@query("UN17", f"SELECT antecedent, consequent, round(s, 4) AS support, round(s / sa, 4) AS confidence, round(s / sa / sc, 4) AS lift, round(s - sa * sc, 6) + 0.0 AS leverage, round(CASE WHEN s < sa THEN least((1 - sc) / (1 - s / sa), 999.0) ELSE 999.0 END, 4) AS conviction FROM ({_rules()}) r WHERE s >= 0.02 AND s / sa >= 0.1 ORDER BY lift DESC LIMIT 100")
def un17(t):
    return P.rules(P.itemsets(basket(t), 0.02), 0.1)


@query("UN18")
def un18(t):
    return P.lda_topics(t.documents, "doc_id", "text", 4)[0]


@query("UN18_main")
def un18_main(t):
    return P.lda_topics(t.documents, "doc_id", "text", 4)[1].groupBy("topic").agg(F.count("*").alias("n"))


@query("UN18_measure")
def un18_measure(t):
    return report(t.documents, [("log_perplexity", P.lda_topics(t.documents, "doc_id", "text", 4)[2])], "measure string, value double")


@query("UN19")
def un19(t):
    return P.nmf_topics(t.documents, "doc_id", "text", 4, 200)[0]


@query("UN19_main")
def un19_main(t):
    return P.nmf_topics(t.documents, "doc_id", "text", 4, 200)[1].groupBy("topic").agg(F.count("*").alias("n"))


@query("UN19_measure")
def un19_measure(t):
    return report(t.documents, [("error", P.nmf_topics(t.documents, "doc_id", "text", 4, 200)[2])], "measure string, value double")


CP = [("value", "heavy"), ("value", "near_copy"), ("value", "small_int"), ("heavy", "near_copy"), ("heavy", "small_int"), ("near_copy", "small_int")]


@query("UN20", "SELECT CASE WHEN vb <= va THEN a ELSE b END AS source, CASE WHEN vb <= va THEN b ELSE a END AS target, round(abs(r), 4) AS strength, CASE WHEN abs(r) > 0.3 THEN 'causal' ELSE 'association' END AS kind FROM (" + union(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r, var_pop({a}) AS va, var_pop({b}) AS vb FROM {{skewed}}" for a, b in CP) + ") x WHERE abs(r) > 0.1")
def un20(t):
    return P.causal_edges(t.skewed, ["value", "heavy", "near_copy", "small_int"]).drop("p_value")


@query("UN21", "SELECT 'f1' AS treatment, 'target' AS outcome, round(regr_slope(target, f1), 6) AS plain, round((covar_pop(target, f1) * var_pop(f2) - covar_pop(target, f2) * covar_pop(f1, f2)) / (var_pop(f1) * var_pop(f2) - pow(covar_pop(f1, f2), 2)), 6) AS adjusted, true AS significant FROM {learnable}")
def un21(t):
    return P.causal_effect(t.learnable, "o_orderkey", "f1", "target", ["f2"]).select("treatment", "outcome", "plain", "adjusted", "significant")


@query("UN21_interval")
def un21_interval(t):
    return P.causal_effect(t.learnable, "o_orderkey", "f1", "target", ["f2"])
