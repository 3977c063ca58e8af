"""Drift, fairness and evaluation over derived predictions."""

from pyspark.sql import functions as F

from tablewise.operators import drift as D
from tablewise.operators import evaluation as E
from tablewise.operators import fairness as A
from tablewise.plans.registry import query
from tablewise.plans.sqltext import rnd, union


def sides(t):
    d = t.drift_sides
    return d.where("side = 0").drop("side"), d.where("side = 1").drop("side")


PSI = """WITH r AS (SELECT value AS x FROM {drift_sides} WHERE side = 0), c AS (SELECT value AS x FROM {drift_sides} WHERE side = 1),
e AS (SELECT list_sort(list_distinct(quantile_cont(x, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM r),
b AS (SELECT s, len(list_filter(list_slice(e, 2, -2), lambda v: v <= x)) AS b, x < e[1] OR x > e[-1] AS out FROM (SELECT 0 AS s, x FROM r UNION ALL SELECT 1, x FROM c) u, e),
n AS (SELECT b, count(*) FILTER (WHERE s = 0 AND NOT out) AS a, count(*) FILTER (WHERE s = 1 AND NOT out) AS k FROM b GROUP BY 1),
p AS (SELECT greatest(0.0001, 1.0 * a / (SELECT count(*) FROM r)) AS p, greatest(0.0001, 1.0 * k / (SELECT count(*) FROM c)) AS q FROM n),
psi AS (SELECT sum((q - p) * ln(q / p)) AS psi FROM p)"""
KS = """k0 AS (SELECT value AS x, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM {drift_sides} GROUP BY 1),
k1 AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () AS ca, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS cb, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM k0),
ks AS (SELECT max(na) AS na, max(nb) AS nb, max(abs(ca - cb)) AS d FROM k1),
kp AS (SELECT na, nb, d, least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101), lambda k: pow(-1, k - 1) * exp(-2 * k * k * d * d * na * nb / (na + nb)))))) AS p FROM ks)"""


@query("DR1", PSI + " SELECT 'value' AS \"column\", round(psi, 4) AS psi FROM psi")
def dr1(t):
    from tablewise.functions.moments import half_up
    from tablewise.operators.measures import report

    a, b = sides(t)
    return report(a, [(c, half_up(v)) for c, v in D.psi(a, b, ["value"]).items()], "column string, psi double")


@query("DR2", f"WITH {KS} SELECT 'value' AS \"column\", CAST(na AS BIGINT) AS n_reference, CAST(nb AS BIGINT) AS n_current, round(d, 6) AS statistic FROM kp")
def dr2(t):
    a, b = sides(t)
    return D.ks(a, b, ["value"]).withColumn("statistic", F.round("statistic", 6))


@query("DR3", f"""SELECT 'value' AS "column", {rnd('abs(avg(value) FILTER (WHERE side = 1) - avg(value) FILTER (WHERE side = 0)) / stddev_pop(value) FILTER (WHERE side = 0)')} AS mean_shift,
{rnd('avg(value) FILTER (WHERE side = 0)')} AS reference_mean, {rnd('avg(value) FILTER (WHERE side = 1)')} AS current_mean FROM {{drift_sides}}""")
def dr3(t):
    a, b = sides(t)
    return D.numeric_drift(a, b, ["value"]).select("column", "mean_shift", "reference_mean", "current_mean")


CAT = """cn AS (SELECT kind, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM {drift_sides} GROUP BY 1),
s AS (SELECT sum((q - p) * ln(q / p)) AS psi, sum((o - w) * (o - w) / w) AS chi2, count(*) AS k, max(nb) AS nb, count(*) FILTER (WHERE a = 0) AS new, count(*) FILTER (WHERE b = 0) AS lost FROM (
SELECT a, b, greatest(a / na, 0.0001) AS p, greatest(b / nb, 0.0001) AS q, greatest(b, 0.1) AS o, greatest(a, 0.1) * nb / na AS w, nb FROM (SELECT *, CAST(sum(a) OVER () AS DOUBLE) AS na, CAST(sum(b) OVER () AS DOUBLE) AS nb FROM cn) x) y)"""


@query("DR4", f"WITH {CAT} SELECT 'kind' AS \"column\", round(abs(psi), 4) AS psi, round(chi2, 4) AS chi2, round(sqrt(chi2 / (nb * (k - 1))), 4) AS cramers_v, new AS new_categories, lost AS lost_categories FROM s")
def dr4(t):
    a, b = sides(t)
    return D.categorical_drift(a, b, ["kind"]).drop("p_value", "status")


@query("DR4_new", "SELECT 'kind' AS \"column\", kind AS value, CASE WHEN a = 0 THEN 'new' ELSE 'lost' END AS change, greatest(a, b) AS n FROM (SELECT kind, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM {drift_sides} GROUP BY 1) x WHERE a = 0 OR b = 0")
def dr4_new(t):
    a, b = sides(t)
    return D.changed_categories(a, b, ["kind"])


STATUS = f"""SELECT 'value' AS "column", 'numerical' AS kind, round(psi, 4) AS psi, CASE WHEN psi > 0.25 OR p < 0.001 THEN 'high_drift' WHEN psi > 0.1 OR p < 0.05 THEN 'moderate_drift' ELSE 'no_drift' END AS status FROM psi, kp
UNION ALL SELECT 'kind', 'categorical', round(abs(psi), 4), CASE WHEN psi > 0.25 OR sqrt(chi2 / (nb * (k - 1))) > 0.3 OR chi2 > 100 THEN 'high_drift' ELSE 'no_drift' END FROM s"""


@query("DR5", f"{PSI}, {KS}, {CAT} {STATUS}")
def dr5(t):
    a, b = sides(t)
    return D.drift_status(a, b, ["value"], ["kind"]).drop("p_value")


@query("DR5_overall", f"{PSI}, {KS}, {CAT}, st AS ({STATUS}) SELECT *, CASE WHEN mean_psi > 0.25 OR high > 0.3 * columns THEN 'critical' WHEN mean_psi > 0.1 OR high > 0 THEN 'warning' ELSE 'healthy' END AS overall, mean_psi > 0.25 OR high > 0.3 * columns AS retrain FROM (SELECT count(*) AS columns, round(avg(psi), 4) AS mean_psi, count(*) FILTER (WHERE status = 'high_drift') AS high, count(*) FILTER (WHERE status = 'moderate_drift') AS moderate FROM st) z")
def dr5_overall(t):
    a, b = sides(t)
    return D.overall_status(D.drift_status(a, b, ["value"], ["kind"]))


@query("DR6", f"{PSI}, {KS}, {CAT}, st AS ({STATUS}) SELECT \"column\", CASE WHEN kind = 'numerical' THEN 'KS' ELSE 'chi-square' END AS test, psi, CASE WHEN kind = 'numerical' THEN (SELECT round(avg(x), 4) FROM r) END AS reference, CASE WHEN kind = 'numerical' THEN (SELECT round(avg(x), 4) FROM c) END AS current, status, (SELECT avg(psi) > 0.25 OR count(*) FILTER (WHERE status = 'high_drift') > 0.3 * count(*) FROM st) AS retrain FROM st")
def dr6(t):
    a, b = sides(t)
    return D.comparison(a, b, ["value"], ["kind"]).drop("p_value")


@query("DR7", f"{PSI}, {KS} SELECT round(psi, 4) AS psi, round(d, 4) AS ks, (SELECT round(avg(x), 4) FROM r) AS reference_mean, (SELECT round(stddev_pop(x), 4) FROM r) AS reference_std, (SELECT round(median(x), 4) FROM r) AS reference_median, (SELECT round(avg(x), 4) FROM c) AS current_mean, (SELECT round(stddev_pop(x), 4) FROM c) AS current_std, (SELECT round(median(x), 4) FROM c) AS current_median, CASE WHEN psi > 0.25 THEN 'critical' WHEN psi > 0.1 THEN 'warning' ELSE 'healthy' END AS status FROM psi, kp")
def dr7(t):
    a, b = sides(t)
    return D.prediction_drift(a, b, "value").drop("p_value")


ACC = "(SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM {predictions} WHERE model = 0)"


@query("DR9", f"""{PSI}, h AS (SELECT {ACC} AS a, psi, (SELECT 1.0 - avg(CASE WHEN price IS NULL THEN 0.0 ELSE 1.0 END) FROM {{dirty_orders}}) AS m FROM psi), s AS (SELECT *, round(100 * (0.5 * a + 0.3 * (1 - least(psi, 0.3)) + 0.2 * (1 - least(m, 0.3))), 2) AS health FROM h)
SELECT health, CASE WHEN health < 60 THEN 'Critical' WHEN health < 80 THEN 'Warning' ELSE 'Healthy' END AS level, concat_ws(',', CASE WHEN a < 0.8 THEN 'optimize_model' END, CASE WHEN psi > 0.1 THEN 'retrain_model' END) AS actions FROM s""")
def dr9(t):
    from tablewise.functions.moments import share
    from tablewise.operators.measures import measure

    a, b = sides(t)
    p = t.predictions.where("model = 0")
    acc = measure(p, a=share(F.col("label") == F.col("prediction")))["a"]
    gaps = measure(t.dirty_orders, m=share(F.col("price").isNull()))["m"]
    return D.health(p, acc, D.psi(a, b, ["value"])["value"], gaps)


# Fairness

FAIR = union(f"""SELECT '{c}' AS "column", {c} AS "group", count(*) AS size, count(*) FILTER (WHERE prediction = 1) AS pos, count(*) FILTER (WHERE label = 1) AS "real", count(*) FILTER (WHERE label = prediction) AS hit,
count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp, count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn, count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn
FROM {{predictions}} WHERE model = 1 GROUP BY 2 HAVING count(*) >= 5""" for c in ("lang", "source"))
RATES = f"SELECT *, 1.0 * pos / size AS pr, 1.0 * hit / size AS acc, 1.0 * tp / greatest(tp + fn, 1) AS tpr, 1.0 * fp / greatest(fp + tn, 1) AS fpr, 1.0 * tp / greatest(tp + fp, 1) AS prec FROM ({FAIR}) f"


@query("FA1", "SELECT 'c_nationkey' AS \"column\", 'nationality' AS category, count(DISTINCT c_nationkey) AS groups FROM customer UNION ALL SELECT 'country', 'nationality', count(DISTINCT n_name) FROM customer JOIN nation ON c_nationkey = n_nationkey")
def fa1(t):
    return A.sensitive_columns(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", F.col("n_name").alias("country"), "c_mktsegment"))


@query("FA2", f"SELECT \"column\", \"group\", size, round(pr, 4) AS positive_rate, round(acc, 4) AS accuracy, round(tpr, 4) AS tpr, round(fpr, 4) AS fpr, round(prec, 4) AS precision FROM ({RATES}) r")
def fa2(t):
    return A.group_rates(t.predictions.where("model = 1"), ["lang", "source"], "label", "prediction")


@query("FA3", f"""WITH g AS (SELECT "column", count(*) AS groups, max(pr) - min(pr) AS dp, (CASE WHEN min(pr) > 0 THEN min(pr) ELSE 0.001 END) / (CASE WHEN max(pr) > 0 THEN max(pr) ELSE 0.001 END) AS di, max(tpr) - min(tpr) AS tg, max(fpr) - min(fpr) AS fg FROM ({RATES}) r GROUP BY 1),
s AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN dp > 0.1 THEN 25 ELSE 0 END - CASE WHEN dp > 0.2 THEN 25 ELSE 0 END - CASE WHEN di < 0.8 THEN 20 ELSE 0 END - CASE WHEN tg > 0.1 THEN 15 ELSE 0 END - CASE WHEN fg > 0.1 THEN 15 ELSE 0 END) AS INTEGER) AS score FROM g)
SELECT "column", groups, round(dp, 4) AS parity_gap, round(di, 4) AS disparate_impact, round(tg, 4) AS tpr_gap, round(fg, 4) AS fpr_gap, score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade,
concat_ws(',', CASE WHEN dp > 0.1 THEN 'reweight' END, CASE WHEN di < 0.8 THEN 'remove_proxies' END, CASE WHEN tg > 0.15 THEN 'equalize_odds' END) AS mitigations FROM s""")
def fa3(t):
    return A.fairness_audit(t.predictions.where("model = 1"), ["lang", "source"], "label", "prediction")


@query("FA4", "SELECT p.doc_id, p.label, p.prediction, d.lang, d.source FROM {predictions} p JOIN documents d ON p.doc_id = d.doc_id WHERE p.model = 0")
def fa4(t):
    return A.attach_sensitive(t.predictions.where("model = 0").select("doc_id", "label", "prediction"), t.documents, "doc_id", ["lang", "source"])


@query("FA5", f"""WITH r AS (SELECT "column", "group", round(1.0 * "real" / size, 4) AS d, round(1.0 * pos / size, 4) AS p FROM ({FAIR}) f),
g AS (SELECT "column", count(*) AS groups, round(max(d) - min(d), 4) AS data_gap, round(max(p) - min(p), 4) AS prediction_gap FROM r GROUP BY 1),
h AS (SELECT "column", first("group" ORDER BY round(p - d, 6) DESC, "group") AS most_gained, first("group" ORDER BY round(p - d, 6), "group") AS most_lost FROM r GROUP BY 1),
x AS (SELECT *, CASE WHEN data_gap > 0.01 THEN prediction_gap / data_gap WHEN prediction_gap > 0.01 THEN 999.0 ELSE 1.0 END AS f FROM g JOIN h USING ("column"))
SELECT "column", groups, data_gap, prediction_gap, round(f, 4) AS factor, CASE WHEN f > 1.5 THEN 'critical' WHEN f > 1.1 THEN 'warning' WHEN f >= 0.9 THEN 'neutral' ELSE 'good' END AS severity, most_gained, most_lost FROM x""")
def fa5(t):
    return A.bias_amplification(t.predictions.where("model = 1"), ["lang", "source"], "label", "prediction")


# Evaluation


@query("EV1", """WITH c AS (SELECT DISTINCT label AS class FROM {predictions}), s AS (SELECT class, count(*) FILTER (WHERE label = class) AS support, count(*) FILTER (WHERE prediction = class) AS said, count(*) FILTER (WHERE label = class AND prediction = class) AS tp FROM {predictions}, c WHERE model = 1 GROUP BY 1)
SELECT class, round(1.0 * tp / said, 4) AS precision, round(1.0 * tp / support, 4) AS recall, round(2.0 * tp / (said + support), 4) AS f1, support FROM s""")
def ev1(t):
    return E.per_class(t.predictions.where("model = 1"))


CURVE = """c AS (SELECT model, prob AS score, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg FROM {predictions} GROUP BY 1, 2),
k AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(neg) OVER (PARTITION BY model ORDER BY score DESC) AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(neg) OVER (PARTITION BY model) AS n FROM c)"""


@query("EV2", f"WITH {CURVE} SELECT model, score, round(fp / n, 4) AS fpr, round(tp / p, 4) AS tpr FROM k")
def ev2(t):
    return E.curve(t.predictions, ["model"]).select("model", "score", F.round("fpr", 4).alias("fpr"), F.round("tpr", 4).alias("tpr"))


@query("EV2_auc", f"WITH {CURVE}, z AS (SELECT model, fp / n AS x, tp / p AS y, lag(fp / n, 1, 0) OVER (PARTITION BY model ORDER BY score DESC) AS x0, lag(tp / p, 1, 0) OVER (PARTITION BY model ORDER BY score DESC) AS y0 FROM k) SELECT model, round(sum((x - x0) * (y + y0) / 2), 4) AS auc FROM z GROUP BY 1")
def ev2_auc(t):
    return E.roc_auc(E.curve(t.predictions, ["model"]), ["model"])


RANKED = """SELECT k AS class, round((sum(r) FILTER (WHERE hit) - count(*) FILTER (WHERE hit) * (count(*) FILTER (WHERE hit) + 1) / 2.0) / (count(*) FILTER (WHERE hit) * count(*) FILTER (WHERE NOT hit)), 4) AS auc FROM (
SELECT k, hit, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS r FROM (
SELECT 'en' AS k, lang = 'en' AS hit, prob AS s FROM {predictions} WHERE model = 1 AND lang IS NOT NULL UNION ALL SELECT 'de', lang = 'de', 1 - prob FROM {predictions} WHERE model = 1 AND lang IS NOT NULL
UNION ALL SELECT 'fr', lang = 'fr', n_chars FROM {predictions} WHERE model = 1 AND lang IS NOT NULL) x) y GROUP BY 1"""


@query("EV2_rest", RANKED)
def ev2_rest(t):
    p = t.predictions.where("model = 1").withColumn("other", 1 - F.col("prob"))
    return E.one_against_rest(p, "lang", {"en": "prob", "de": "other", "fr": "n_chars"})


@query("EV3", f"WITH {CURVE} SELECT model, score, round(1.0 * tp / (tp + fp), 4) AS precision, round(1.0 * tp / p, 4) AS recall FROM k")
def ev3(t):
    return E.curve(t.predictions, ["model"]).select("model", "score", F.round("precision", 4).alias("precision"), F.round("tpr", 4).alias("recall"))


@query("EV3_ap", f"WITH {CURVE} SELECT model, round(sum(1.0 * pos / p * tp / (tp + fp)), 4) AS average_precision FROM k GROUP BY 1")
def ev3_ap(t):
    return E.average_precision(E.curve(t.predictions, ["model"]), ["model"])


@query("EV4", f"SELECT {rnd('avg(label - prediction)')} AS mean, {rnd('stddev_pop(label - prediction)')} AS std, {rnd('skewness(label - prediction)')} AS skew, count(*) AS n FROM {{reg_predictions}}")
def ev4(t):
    return E.residuals(t.reg_predictions)


@query("EV4_hist", "SELECT CAST(b AS INTEGER) AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 30)) AS b) r LEFT JOIN (SELECT least(CAST(floor((e - lo) / ((hi - lo) / 30)) AS BIGINT), 29) AS b, count(*) AS n FROM (SELECT label - prediction AS e FROM {reg_predictions}) x, (SELECT min(label - prediction) AS lo, max(label - prediction) AS hi FROM {reg_predictions}) m GROUP BY 1) h USING (b)")
def ev4_hist(t):
    return E.residual_histogram(t.reg_predictions).select("bin", "n")


@query("EV4_qq", "WITH r AS (SELECT e, row_number() OVER (ORDER BY e) - 1 AS k, count(*) OVER () AS n FROM (SELECT label - prediction AS e FROM {reg_predictions}) x) SELECT CAST(k AS INTEGER) AS rank, round(e, 4) + 0.0 AS observed FROM r WHERE k IN (SELECT CAST(floor(i * (n - 1) / 99.0) AS BIGINT) FROM (SELECT unnest(range(0, 100)) AS i) g, (SELECT count(*) AS n FROM {reg_predictions}) c)")
def ev4_qq(t):
    return E.qq_points(t.reg_predictions).drop("theoretical")


@query("EV5", f"WITH {CURVE}, z AS (SELECT model, score, tp, row_number() OVER (PARTITION BY model ORDER BY score) - 1 AS i, count(*) OVER (PARTITION BY model) - 1 AS m FROM k), g AS (SELECT unnest(range(0, 20)) AS j) SELECT DISTINCT model, score, CAST(tp AS BIGINT) AS tp FROM z, g WHERE m < 20 OR i = CAST(floor(j * m / 19.0) AS BIGINT)")
def ev5(t):
    return E.thin(E.curve(t.predictions, ["model"]).select("model", "score", "tp"), "score", 20, ["model"])


CAL = "SELECT CAST(least(floor(prob * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(label) AS observed, avg(prob) AS predicted FROM {predictions} WHERE model = 0 GROUP BY 1"


@query("EV6", f"SELECT bin, n, round(observed, 4) AS observed, round(predicted, 4) AS predicted FROM ({CAL}) c")
def ev6(t):
    return E.calibration(t.predictions.where("model = 0")).select("bin", "n", F.round("observed", 4).alias("observed"), F.round("predicted", 4).alias("predicted"))


@query("EV6_summary", f"SELECT round(e, 4) AS ece, (SELECT round(avg((prob - label) * (prob - label)), 4) FROM {{predictions}} WHERE model = 0) AS brier, e < 0.05 AS well_calibrated, CAST(greatest(0, round(100 - e * 1000)) AS DOUBLE) AS reliability, CASE WHEN e < 0.03 THEN 'excellent' WHEN e < 0.07 THEN 'good' WHEN e < 0.15 THEN 'fair' ELSE 'poor' END AS badge FROM (SELECT sum(n * abs(observed - predicted)) / sum(n) AS e FROM ({CAL}) c) z")
def ev6_summary(t):
    return E.calibration_summary(t.predictions.where("model = 0"))


@query("EV10", "SELECT doc_id, round(s, 4) AS stability, n AS tests, CASE WHEN s >= 0.8 THEN 'stable_correct' WHEN s >= 0.5 THEN 'unstable' WHEN s > 0 THEN 'mostly_wrong' ELSE 'stable_incorrect' END AS band FROM (SELECT doc_id, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS s, count(*) AS n FROM {predictions} GROUP BY 1) x")
def ev10(t):
    return E.fold_stability(t.predictions, "doc_id")


BAND = "CASE WHEN s >= 0.8 THEN 'easy' WHEN s >= 0.5 THEN 'medium' WHEN s >= 0.2 THEN 'hard' ELSE 'very_hard' END AS band"
VOTES = "SELECT doc_id, prediction AS majority, n AS agreeing, votes FROM (SELECT doc_id, prediction, count(*) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS votes, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, prediction) AS r FROM {predictions} GROUP BY 1, 2) v WHERE r = 1"


@query("EV11", f"SELECT doc_id, round(s, 4) AS score, CAST(c AS BIGINT) AS \"right\", n AS models, majority, {BAND} FROM (SELECT doc_id, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS s, sum(CASE WHEN label = prediction THEN 1 ELSE 0 END) AS c, count(*) AS n FROM {{predictions}} GROUP BY 1) x JOIN ({VOTES}) v USING (doc_id)")
def ev11(t):
    return E.difficulty(t.predictions, "doc_id")


@query("EV11_reg", f"WITH e AS (SELECT o_orderkey, avg(abs(label - prediction)) AS e FROM {{reg_predictions}} GROUP BY 1), q AS (SELECT quantile_cont(e, 0.95) AS q FROM e) SELECT o_orderkey, round(s, 4) AS score, {BAND} FROM (SELECT o_orderkey, 1 - least(e / q, 1.0) AS s FROM e, q) z")
def ev11_reg(t):
    return E.regression_difficulty(t.reg_predictions, "o_orderkey")


@query("EV12", f"SELECT doc_id, label, majority FROM (SELECT doc_id, max(toxic) AS label, count(*) FILTER (WHERE toxic = prediction) AS c, count(*) AS n FROM {{predictions}} GROUP BY 1) x JOIN ({VOTES}) v USING (doc_id) WHERE c = 0 AND n >= 3")
def ev12(t):
    return E.suspected_labels(t.predictions, "doc_id", "toxic")


def _contrast(cols, flag, other, table, least):
    return union(f"SELECT * FROM (SELECT '{c}' AS feature, round(h, 4) AS hard_mean, round(e, 4) AS easy_mean, round(abs(h - e) / s, 4) AS effect, CASE WHEN h > e THEN 'higher' ELSE 'lower' END AS direction FROM (SELECT avg({c}) FILTER (WHERE {flag}) AS h, avg({c}) FILTER (WHERE {other}) AS e, stddev_samp({c}) AS s FROM {table}) z{i}) y{i} WHERE effect > {least}" for i, c in enumerate(cols))


@query("EV13", _contrast(["o_totalprice", "o_custkey", "err"], "o_totalprice > 250000", "NOT o_totalprice > 250000", "(SELECT o.*, label - prediction AS err FROM orders o JOIN {reg_predictions} USING (o_orderkey))", 0.5))
def ev13(t):
    df = t.orders.join(t.reg_predictions.select("o_orderkey", (F.col("label") - F.col("prediction")).alias("err")), "o_orderkey")
    return E.contrast(df, F.col("o_totalprice") > 250000, ["o_totalprice", "o_custkey", "err"])


PAIRS = [(0, 1), (0, 2), (1, 2)]
DIS = union(f"SELECT '{a}' AS model_a, '{b}' AS model_b, round(100.0 * avg(CASE WHEN x.prediction <> y.prediction THEN 1.0 ELSE 0.0 END), 1) AS disagreement_pct FROM {{predictions}} x JOIN {{predictions}} y ON x.doc_id = y.doc_id WHERE x.model = {a} AND y.model = {b}" for a, b in PAIRS)


@query("EV14", DIS)
def ev14(t):
    return E.disagreement(t.predictions, "doc_id", [0, 1, 2])


@query("EV15", f"SELECT zone, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM (SELECT CASE WHEN 1.0 * agreeing / votes >= 0.8 THEN 'high_trust' WHEN 1.0 * agreeing / votes >= 0.5 THEN 'medium_trust' ELSE 'danger_zone' END AS zone FROM ({VOTES}) v) z GROUP BY 1")
def ev15(t):
    return E.zone_summary(E.consensus_zones(t.predictions, "doc_id"))


@query("EV15_contrary", f"SELECT model, round(avg(disagreement_pct), 2) AS mean_pct FROM (SELECT model_a AS model, disagreement_pct FROM ({DIS}) a UNION ALL SELECT model_b, disagreement_pct FROM ({DIS}) b) z GROUP BY 1")
def ev15_contrary(t):
    return E.most_contrary(E.disagreement(t.predictions, "doc_id", [0, 1, 2]))


@query("EV15_zone_features", _contrast(["n_chars"], "zone = 'medium_trust'", "zone = 'high_trust'", f"(SELECT n_chars, CASE WHEN 1.0 * agreeing / votes >= 0.8 THEN 'high_trust' ELSE 'medium_trust' END AS zone FROM ({VOTES}) v JOIN documents USING (doc_id))", 0.0))
def ev15_zone_features(t):
    z = E.consensus_zones(t.predictions, "doc_id").join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return E.contrast(z, F.col("zone") == "medium_trust", ["n_chars"], F.col("zone") == "high_trust", 0.0)


SPLIT_VOTES = "(SELECT doc_id, max(n_chars) AS n_chars, CASE WHEN count(DISTINCT vote) = 3 THEN 'danger_zone' WHEN count(DISTINCT vote) = 1 THEN 'high_trust' ELSE 'medium_trust' END AS zone FROM (SELECT doc_id, n_chars, CASE WHEN n_chars > 1500 THEN 10 + model ELSE prediction END AS vote FROM {predictions}) s GROUP BY 1)"


@query("EV15_danger", _contrast(["n_chars"], "zone = 'danger_zone'", "zone = 'high_trust'", SPLIT_VOTES, 0.3))
def ev15_danger(t):
    votes = t.predictions.withColumn("prediction", F.when(F.col("n_chars") > 1500, 10 + F.col("model")).otherwise(F.col("prediction")))
    z = E.consensus_zones(votes, "doc_id").join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return E.contrast(z, F.col("zone") == "danger_zone", ["n_chars"], F.col("zone") == "high_trust", 0.3)


@query("EV16", f"SELECT doc_id, majority AS point, round(1.0 * agreeing / votes, 4) AS agreement, round(greatest(p, 1 - p), 4) AS confidence, CASE WHEN 1.0 * agreeing / votes >= 0.8 THEN 'HIGH' WHEN 1.0 * agreeing / votes >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS reliability FROM ({VOTES}) v JOIN (SELECT doc_id, avg(prob) AS p FROM {{predictions}} GROUP BY 1) z USING (doc_id)")
def ev16(t):
    return E.class_bands(t.predictions, "doc_id")


@query("EV16_reg", "WITH p AS (SELECT o_orderkey, prediction FROM {reg_predictions} UNION ALL SELECT o_orderkey, label FROM {reg_predictions}), r AS (SELECT max(prediction) - min(prediction) AS r FROM p), s AS (SELECT o_orderkey, avg(prediction) AS m, stddev_pop(prediction) AS s FROM p GROUP BY 1) SELECT o_orderkey, round(m, 6) AS point, round(m - 2 * s, 6) AS lower, round(m + 2 * s, 6) AS upper, round(greatest(0, 1 - s / r * 3), 6) AS agreement, CASE WHEN 1 - s / r * 3 >= 0.7 THEN 'HIGH' WHEN 1 - s / r * 3 >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS reliability FROM s, r")
def ev16_reg(t):
    p = t.reg_predictions
    return E.regression_bands(p.select("o_orderkey", "prediction").union(p.select("o_orderkey", "label")), "o_orderkey", places=6)


CALIB = "SELECT * FROM {reg_predictions} WHERE o_orderpriority <= '3-MEDIUM'"


def _order_statistic(scores):
    """Conformal quantile of the column e of a statement, by linear interpolation of order statistics."""
    return f"""(SELECT v[CAST(floor(p) AS BIGINT) + 1] + (p - floor(p)) * (v[CAST(least(floor(p) + 2, n) AS BIGINT)] - v[CAST(floor(p) AS BIGINT) + 1]) FROM (
SELECT v, n, least(1.0, ceil((n + 1) * 0.95) / n) * (n - 1) AS p FROM (SELECT list_sort(list(e)) AS v, CAST(count(*) AS DOUBLE) AS n FROM ({scores}) x) y) z)"""


MARGIN = _order_statistic(f"SELECT abs(label - prediction) AS e FROM ({CALIB}) c")


@query("EV17", f"SELECT round({MARGIN}, 4) AS margin")
def ev17(t):
    from tablewise.operators.measures import report

    p = t.reg_predictions
    return report(p, [(round(E.conformal_margin(p.where("o_orderpriority <= '3-MEDIUM'")), 4),)], "margin double")


@query("EV18", f"SELECT o_orderkey, round(prediction - m, 2) AS lower, round(prediction + m, 2) AS upper FROM {{reg_predictions}}, (SELECT {MARGIN} AS m) z WHERE o_orderpriority > '3-MEDIUM'")
def ev18(t):
    p = t.reg_predictions
    m = E.conformal_margin(p.where("o_orderpriority <= '3-MEDIUM'"))
    return E.conformal_intervals(p.where("o_orderpriority > '3-MEDIUM'"), m).select("o_orderkey", F.round("lower", 2).alias("lower"), F.round("upper", 2).alias("upper"))


THR = _order_statistic("SELECT CASE WHEN label = 1 THEN 1 - prob ELSE prob END AS e FROM {predictions} WHERE model = 0")


@query("EV18_sets", f"SELECT round(avg(greatest(1, k)), 4) AS mean_size, round(100.0 * avg(CASE WHEN greatest(1, k) = 1 THEN 1.0 ELSE 0.0 END), 1) AS single_pct FROM (SELECT CASE WHEN prob <= t THEN 1 ELSE 0 END + CASE WHEN 1 - prob <= t THEN 1 ELSE 0 END AS k FROM {{predictions}}, (SELECT {THR} AS t) z WHERE model = 1) s")
def ev18_sets(t):
    p = t.predictions
    return E.set_summary(E.conformal_sets(p.where("model = 1"), E.conformal_threshold(p.where("model = 0"))))


SL = "(SELECT * FROM {predictions} WHERE model = 2)"
SLICES = f"""SELECT feature, slice, n, round(s, 4) AS score, round(s - o, 4) + 0.0 AS gap FROM (
SELECT 'n_chars' AS feature, 'q' || (b + 1) AS slice, count(*) AS n, avg(r) AS s FROM (SELECT CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END AS r, len(list_filter(list_slice((SELECT list_sort(list_distinct(quantile_cont(CAST(n_chars AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]))) FROM {SL}), 2, -2), lambda e: e < n_chars)) AS b FROM {SL}) x GROUP BY 1, 2
UNION ALL SELECT 'lang', lang, count(*), avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM {SL} GROUP BY 2
UNION ALL SELECT 'source', source, count(*), avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FROM {SL} WHERE source IN (SELECT source FROM {SL} GROUP BY 1 ORDER BY count(*) DESC, source LIMIT 10) GROUP BY 2) u,
(SELECT avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS o FROM {SL}) v WHERE n >= 10"""


@query("EV19", SLICES)
def ev19(t):
    return E.slices(t.predictions.where("model = 2"), ["n_chars", "lang", "source"])


@query("EV19_sides", f"SELECT *, 'worst' AS side FROM (SELECT * FROM ({SLICES}) a ORDER BY score, feature, slice LIMIT 3) w UNION ALL SELECT *, 'best' FROM (SELECT * FROM ({SLICES}) b ORDER BY score DESC, feature, slice LIMIT 3) z")
def ev19_sides(t):
    return E.worst_and_best(E.slices(t.predictions.where("model = 2"), ["n_chars", "lang", "source"]), 3)


@query("EV19_reg", """WITH b AS (SELECT label, prediction, 'q' || (1 + len(list_filter(list_slice((SELECT list_sort(list_distinct(quantile_cont(CAST(o_orderkey AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 1.0]))) FROM {reg_predictions}), 2, -2), lambda e: e < o_orderkey))) AS slice FROM {reg_predictions})
SELECT 'o_orderkey' AS feature, slice, count(*) AS n, round(1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)), 4) AS score, round(1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) - (SELECT 1 - sum((label - prediction) * (label - prediction)) / (var_pop(label) * count(*)) FROM b), 4) + 0.0 AS gap FROM b GROUP BY 2""")
def ev19_reg(t):
    return E.slices(t.reg_predictions, ["o_orderkey"], classification=False)


@query("EV20", f"""SELECT kind, what, score, impact FROM (SELECT 'subgroup' AS kind, feature || '=' || slice AS what, score, round(-gap * n / (SELECT count(*) FROM {SL}), 4) AS impact FROM ({SLICES}) s WHERE gap < -0.08
UNION ALL SELECT 'class', CAST(label AS VARCHAR), round(r, 4), round((0.8 - r) * n / (SELECT count(*) FROM {SL}), 4) FROM (SELECT label, count(*) AS n, avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) AS r FROM {SL} GROUP BY 1) c WHERE n >= 3 AND r < 0.7
UNION ALL SELECT 'volume', CAST(3 * count(*) AS VARCHAR), round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 4), 0.02 FROM {SL} HAVING count(*) < 5000 AND avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) < 0.85) z ORDER BY impact DESC, kind, what LIMIT 15""")
def ev20(t):
    p = t.predictions
    return E.prescriptions(p.where("model = 0"), p.where("model = 2"), ["n_chars", "lang", "source"], limit=15)


@query("EV23", "SELECT count(*) FILTER (WHERE greatest(prob, 1 - prob) < 0.6) AS near, round(100.0 * count(*) FILTER (WHERE greatest(prob, 1 - prob) < 0.6) / count(*), 2) AS near_pct, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END) FILTER (WHERE greatest(prob, 1 - prob) < 0.6), 4) AS accuracy FROM {predictions} WHERE model = 0")
def ev23(t):
    return E.boundary_rows(t.predictions.where("model = 0"))


POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]
BOOT = f"""SELECT CAST(d AS INTEGER) AS draw, round(sum(w * r) / sum(w), 4) AS score FROM (SELECT d, r, CASE {' '.join(f'WHEN u < {e!r} THEN {k}' for k, e in enumerate(POISSON))} ELSE 8 END AS w FROM (
SELECT d, CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END AS r, CAST('0x' || substr(md5(doc_id || ':42:' || d), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM {{predictions}}, (SELECT unnest(range(0, 20)) AS d) g WHERE model = 1) x) y GROUP BY 1"""


@query("EV24", BOOT)
def ev24(t):
    return E.bootstrap_scores(t.predictions.where("model = 1"), "doc_id")


@query("EV24_spread", f"SELECT *, CASE WHEN std < 0.01 THEN 'very_stable' WHEN std < 0.03 THEN 'stable' WHEN std < 0.06 THEN 'moderate' ELSE 'unstable' END AS grade FROM (SELECT round(avg(score), 4) AS mean, round(stddev_pop(score), 4) AS std FROM ({BOOT}) b) z")
def ev24_spread(t):
    return E.bootstrap_spread(E.bootstrap_scores(t.predictions.where("model = 1"), "doc_id"))


@query("ML12", f"""WITH s AS (SELECT k, count(*) FILTER (WHERE label = k) AS "real", count(*) FILTER (WHERE prediction = k) AS said, count(*) FILTER (WHERE label = k AND prediction = k) AS tp, count(*) AS n FROM {{predictions}}, (SELECT DISTINCT label AS k FROM {{predictions}}) c WHERE model = 1 GROUP BY 1),
{CURVE}, z AS (SELECT fp / n AS x, tp / p AS y, lag(fp / n, 1, 0) OVER (ORDER BY score DESC) AS x0, lag(tp / p, 1, 0) OVER (ORDER BY score DESC) AS y0 FROM k WHERE model = 1)
SELECT round(1.0 * sum(tp) / max(n), 4) AS accuracy, round(sum("real" * 1.0 / n * tp / said), 4) AS precision, round(1.0 * sum(tp) / max(n), 4) AS recall, round(sum("real" * 1.0 / n * 2.0 * tp / (said + "real")), 4) AS f1, (SELECT round(sum((x - x0) * (y + y0) / 2), 4) FROM z) AS auc FROM s""")
def ml12(t):
    return E.classification_measures(t.predictions.where("model = 1"))


@query("ML12_confusion", "SELECT label, prediction, count(*) AS n FROM {predictions} WHERE model = 1 GROUP BY 1, 2")
def ml12_confusion(t):
    return E.confusion(t.predictions.where("model = 1"))


@query("ML13", """SELECT round(avg(abs(e)), 4) AS mae, round(avg(e * e), 2) AS mse, round(sqrt(avg(e * e)), 4) AS rmse, round(1 - avg(e * e) / var_pop(label), 4) AS r2, round(100 * avg(abs(e / label)) FILTER (WHERE label <> 0), 4) AS mape, round(max(abs(e)), 4) AS max_error,
round(1 - avg(e * e) / var_pop(label) * (count(*) - 1) / (count(*) - 2), 4) AS adjusted_r2, round(1 - var_pop(e) / var_pop(label), 4) AS explained_variance FROM (SELECT label, label - prediction AS e FROM {reg_predictions}) x""")
def ml13(t):
    return E.regression_measures(t.reg_predictions)
