"""Exploration and quality of the source tables."""

from pyspark.sql import functions as F

from tablewise.operators import explore as E
from tablewise.operators import quality as D
from tablewise.plans.profile_plans import ORD, _hist, rounded_hist
from tablewise.plans.registry import query
from tablewise.plans.sqltext import long_form, rnd, union

SKEWED = ["event_id", "user_id", "value", "heavy", "near_copy", "small_int"]
DUP = "(SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM {dirty_orders} GROUP BY o_orderkey, price, cust, sparse, sentinel_price, priority, constant_col, o_orderdate) g)"
MISS = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c, _ in ORD)


@query("ED1", f"""SELECT count(*) AS n_rows, 8 AS n_columns, 5 AS n_numeric, 2 AS n_text, 1 AS n_datetime, sum(m) AS missing_cells,
{rnd('100.0 * sum(m) / (count(*) * 8)', 2)} AS missing_pct, {DUP} AS duplicate_rows, {rnd(f'100.0 * {DUP} / count(*)', 2)} AS duplicate_pct
FROM (SELECT {MISS} AS m FROM {{dirty_orders}}) x""")
def ed1(t):
    return E.overview(t.dirty_orders)


def _dist(c, table):
    return (f"SELECT '{c}' AS \"column\", count({c}) AS n, {rnd(f'avg({c})')} AS mean, {rnd(f'median({c})')} AS median, {rnd(f'stddev_samp({c})')} AS std, "
            f"{rnd(f'min({c})')} AS min, {rnd(f'max({c})')} AS max, {rnd(f'skewness({c})')} AS skewness, {rnd(f'kurtosis({c})')} AS kurtosis, "
            f"{rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)')} AS q25, {rnd(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)')} AS q75 FROM {table}")


@query("ED2", union(_dist(c, "{skewed}") for c in SKEWED))
def ed2(t):
    return E.distributions(t.skewed, SKEWED)


@query("ED3", _hist("{skewed}", ["value", "near_copy"], "CAST(least(30, floor(sqrt(count(value)))) AS BIGINT)"))
def ed3(t):
    from tablewise.operators.profile import column_histograms

    return rounded_hist(column_histograms(t.skewed, ["value", "near_copy"], lambda n: min(30, int(n**0.5))))


K2 = """SELECT "column", n, round(k2, 4) AS k2, round(exp(-k2 / 2), 6) + 0.0 AS p_value, exp(-k2 / 2) > 0.05 AS is_normal FROM (
SELECT "column", n, pow(asinh(y / alpha) / sqrt(0.5 * ln(w2)), 2) +
 pow((1 - 2 / (9 * a) - sign(d) * pow(abs(1 - 2 / a) / abs(d), 1.0 / 3)) / sqrt(2 / (9 * a)), 2) AS k2 FROM (
SELECT *, 1 + x * sqrt(2 / (a - 4)) AS d FROM (
SELECT *, 6 + 8 / root * (2 / root + sqrt(1 + 4 / (root * root))) AS a, sqrt(2.0 / (w2 - 1)) AS alpha FROM (
SELECT "column", n, g1 * sqrt((n + 1.0) * (n + 3) / (6.0 * (n - 2))) AS y,
 sqrt(2 * (3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
 (b2 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS root FROM (%s) s0) s1) s2) s3) s4"""


@query("ED4", K2 % union(
    f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS n, skewness({c}) * (count({c}) - 2) / sqrt(1.0 * count({c}) * (count({c}) - 1)) AS g1, kurtosis_pop({c}) + 3 AS b2 FROM {{skewed}}" for c in ("value", "near_copy", "small_int")))
def ed4(t):
    return E.normality(t.skewed, ["value", "near_copy", "small_int"])


@query("ED5", """SELECT "column", near_zero_variance, n_modes, n_modes >= 2 AS is_multimodal FROM (SELECT "column", min(nz) AS near_zero_variance, CAST(count(*) FILTER (WHERE n > p AND n > q) AS BIGINT) AS n_modes FROM (
SELECT "column", n, lag(n) OVER (PARTITION BY "column" ORDER BY bin) AS p, lead(n) OVER (PARTITION BY "column" ORDER BY bin) AS q, false AS nz FROM (""" + _hist("{skewed}", ["value", "near_copy", "small_int"], "CAST(20 AS BIGINT)") + ") h) g GROUP BY 1) z")
def ed5(t):
    return E.modality(t.skewed, ["value", "near_copy", "small_int"])


@query("ED6", f"""SELECT "column", value, n, round(100.0 * n / (SELECT count(*) FROM {{text_numbers}}), 2) AS pct, "distinct", "distinct" > 50 AS high_cardinality,
"distinct" = (SELECT count(*) FROM {{text_numbers}}) AS potential_id, "column" = 'date_text' AS potential_datetime FROM (
SELECT "column", value, n, count(*) OVER (PARTITION BY "column") AS "distinct", row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rank
FROM (SELECT "column", value, count(*) AS n FROM ({long_form('{text_numbers}', ['share_text', 'flag_text', 'level_text', 'date_text'], 'VARCHAR')}) m GROUP BY 1, 2) f) r WHERE rank <= 15""")
def ed6(t):
    return E.text_distribution(t.text_numbers, ["share_text", "flag_text", "level_text", "date_text"])


PAIRS = [(a, b) for i, a in enumerate(SKEWED) for b in SKEWED[i + 1:]]


@query("ED7", "SELECT feature_1, feature_2, correlation, CASE WHEN abs(correlation) > 0.7 THEN 'strong' WHEN abs(correlation) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM (" + union(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, {rnd(f'corr({a}, {b})')} AS correlation FROM {{skewed}}" for a, b in PAIRS) + ") x")
def ed7(t):
    return E.correlation_matrix(t.skewed)


def _missing(cols):
    return union(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, {rnd(f'100.0 * (count(*) - count({c})) / count(*)', 2)} AS pct FROM {{dirty_orders}}" for c in cols)


@query("ED8", f"SELECT * FROM ({_missing([c for c, _ in ORD])}) x WHERE missing > 0")
def ed8(t):
    return E.missing_by_column(t.dirty_orders)


CO = [(a, b) for a, b in (("sparse", "cust"), ("sparse", "price"), ("sparse", "priority"), ("price", "cust"), ("price", "priority"), ("cust", "priority"))]


@query("ED9", "SELECT * FROM (" + union(
    f"SELECT least('{a}', '{b}') AS column_1, greatest('{a}', '{b}') AS column_2, round(1.0 * count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) / count(*) FILTER (WHERE {a} IS NULL OR {b} IS NULL), 3) AS overlap, count(*) FILTER (WHERE {a} IS NULL AND {b} IS NULL) AS both_missing FROM {{co_gaps}}"
    for a, b in (("a", "b"), ("a", "c"), ("b", "c"))) + ") x WHERE overlap > 0.5")
def ed9(t):
    return E.co_missing(t.co_gaps).select(F.least("column_1", "column_2").alias("column_1"), F.greatest("column_1", "column_2").alias("column_2"), "overlap", "both_missing")


def _outliers(cols, table):
    return union(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} < lo OR {c} > hi) AS n_outliers, {rnd(f'100.0 * count(*) FILTER (WHERE {c} < lo OR {c} > hi) / count({c})', 2)} AS pct, "
        f"{rnd('min(lo)')} AS lower_bound, {rnd('min(hi)')} AS upper_bound, {rnd(f'min({c})')} AS min, {rnd(f'max({c})')} AS max FROM {table}, "
        f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {table}) z) f{i}"
        for i, c in enumerate(cols))


@query("ED10", f"SELECT * FROM ({_outliers(SKEWED, '{skewed}')}) x WHERE n_outliers > 0")
def ed10(t):
    return E.outlier_table(t.skewed)


@query("ED11", """SELECT label, n, round(100.0 * n / sum(n) OVER (), 2) AS pct, round(1.0 * max(n) OVER () / min(n) OVER (), 2) AS imbalance_ratio, max(n) OVER () > 3 * min(n) OVER () AS is_imbalanced
FROM (SELECT CAST(target AS VARCHAR) AS label, count(*) AS n FROM {learnable} GROUP BY 1) c""")
def ed11(t):
    return E.target_classes(t.learnable, "target")


@query("ED11_corr", union(f"SELECT '{c}' AS feature, {rnd(f'corr(target, {c})')} AS correlation, abs(corr(target, {c})) > 0.95 AS leakage FROM {{learnable}}" for c in ("o_orderkey", "price", "f1", "f2")))
def ed11_corr(t):
    return E.target_correlations(t.learnable, "target")


@query("ED12", f"""SELECT 'missing' AS rule, 'high' AS severity, 'sparse' AS "column", pct AS value FROM ({_missing(['sparse'])}) a WHERE pct > 30
UNION ALL SELECT 'multicollinearity', 'high', 'price,sparse', {rnd('corr(price, sparse)')} FROM {{dirty_orders}}
UNION ALL SELECT 'skewed', 'medium', c, g FROM ({union(f"SELECT '{c}' AS c, {rnd(f'skewness({c})')} AS g FROM {{dirty_orders}}" for c, k in ORD if k == 'numeric')}) b WHERE abs(g) > 2
UNION ALL SELECT 'multimodal', 'low', "column", CAST(n_modes AS DOUBLE) FROM (SELECT "column", count(*) FILTER (WHERE n > p AND n > q) AS n_modes FROM (
SELECT "column", n, lag(n) OVER (PARTITION BY "column" ORDER BY bin) AS p, lead(n) OVER (PARTITION BY "column" ORDER BY bin) AS q FROM ({_hist("{dirty_orders}", [c for c, k in ORD if k == "numeric"], "CAST(20 AS BIGINT)")}) h) g GROUP BY 1) z WHERE n_modes >= 2
UNION ALL SELECT 'outliers', 'medium', "column", pct FROM (SELECT * FROM ({_outliers([c for c, k in ORD if k == 'numeric'], '{dirty_orders}')}) o WHERE n_outliers > 0 ORDER BY n_outliers DESC LIMIT 3) q WHERE pct > 5
UNION ALL SELECT 'duplicates', 'medium', '', {rnd(f'100.0 * {DUP} / count(*)', 2)} FROM {{dirty_orders}} HAVING {rnd(f'100.0 * {DUP} / count(*)', 2)} > 5""")
def ed12(t):
    return E.insights(t.dirty_orders)


@query("ED13", f"""SELECT CASE WHEN pct > 60 THEN 'high' ELSE 'medium' END AS priority, 'Missing Data' AS category, CASE WHEN pct > 60 THEN 'drop' ELSE 'impute' END AS action, "column", pct AS value
FROM (SELECT * FROM ({_missing([c for c, _ in ORD])}) a WHERE missing > 0 ORDER BY missing DESC LIMIT 5) a WHERE pct > 5
UNION ALL SELECT 'high', 'Multicollinearity', 'drop', 'sparse', {rnd('corr(price, sparse)')} FROM {{dirty_orders}}
UNION ALL SELECT 'high', 'Multicollinearity', 'drop', 'sentinel_price', {rnd('corr(sentinel_price, sparse)')} FROM {{dirty_orders}}
UNION ALL SELECT 'low', 'Distribution', 'log', c, g FROM ({union(f"SELECT '{c}' AS c, {rnd(f'skewness({c})')} AS g FROM {{dirty_orders}}" for c, k in ORD if k == 'numeric')}) b WHERE abs(g) > 2""")
def ed13(t):
    return E.recommendations(t.dirty_orders)


def _q(c, table, kind):
    """Column measures as one row, for the quality statements."""
    if kind == "numeric":
        return (f"SELECT '{c}' AS \"column\", 'numeric' AS kind, count(*) AS n, count({c}) AS known, count(DISTINCT {c}) AS u, 0 AS numtext, round(skewness({c}), 3) + 0.0 AS skew, "
                f"CASE WHEN min(iqr) > 0 THEN count(*) FILTER (WHERE {c} < q1 - 3 * iqr OR {c} > q3 + 3 * iqr) ELSE 0 END AS extreme, "
                f"CASE WHEN min(iqr) > 0 THEN round(100.0 * count(*) FILTER (WHERE {c} < q1 - 1.5 * iqr OR {c} > q3 + 1.5 * iqr) / count({c}), 2) ELSE 0 END AS outlier_pct, "
                f"CASE WHEN min(q2) > 0 THEN count(*) FILTER (WHERE {c} < 0) ELSE 0 END AS negatives FROM {table}, "
                f"(SELECT q1, q2, q3, q3 - q1 AS iqr FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q2, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {table}) z) f_{c}")
    num = f"count(try_cast(replace(trim({c}), ',', '') AS DOUBLE))" if kind == "text" else "0"
    return f"SELECT '{c}', '{kind}', count(*), count({c}), count(DISTINCT {c}), {num}, NULL, 0, 0, 0 FROM {table}"


QM = union(_q(c, "{dirty_orders}", k) for c, k in ORD)
PARTS = f"""SELECT *, 0.35 * completeness + 0.25 * consistency + 0.25 * validity + 0.15 * uniqueness AS s FROM (SELECT *, 100.0 * known / n AS completeness,
CASE WHEN kind = 'text' AND numtext > 0.2 * known AND numtext < 0.8 * known THEN 40.0 ELSE 100.0 END AS consistency,
CASE WHEN 1.0 * extreme / known > 0.05 THEN 80.0 ELSE 100.0 END AS validity,
CASE WHEN kind = 'numeric' THEN least(100.0, 200.0 * u / n) WHEN 1.0 * u / n > 0.95 THEN 30.0 WHEN 1.0 * u / n < 0.001 AND n > 100 THEN 40.0 ELSE 80.0 END AS uniqueness FROM ({QM}) m) p"""
GRADE = "CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C' WHEN s >= 50 THEN 'D' ELSE 'F' END"


@query("DQ1", f"SELECT \"column\", {rnd('s', 1)} AS score, {GRADE} AS grade, {rnd('completeness', 1)} AS completeness, {rnd('consistency', 1)} AS consistency, {rnd('validity', 1)} AS validity, {rnd('uniqueness', 1)} AS uniqueness FROM ({PARTS}) q")
def dq1(t):
    return D.column_quality(t.dirty_orders)


@query("DQ2", f"SELECT \"column\", extreme, {rnd('100.0 * extreme / known', 2)} AS extreme_pct, 1.0 * extreme / known > 0.05 AS penalised, negatives, negatives > 0 AND negatives < 0.05 * known AS suspicious_negatives FROM ({QM}) q WHERE kind = 'numeric'")
def dq2(t):
    return D.validity_findings(t.dirty_orders)


@query("DQ3", f"""SELECT "column", skew AS skewness, CASE WHEN skew IS NULL THEN NULL WHEN abs(skew) < 0.5 THEN 'normal' WHEN skew > 1.5 THEN 'highly_right_skewed' WHEN skew > 0 THEN 'right_skewed'
WHEN skew < -1.5 THEN 'highly_left_skewed' ELSE 'left_skewed' END AS distribution, CAST(outlier_pct AS DOUBLE) AS outlier_pct,
concat_ws(',', CASE WHEN completeness < 70 THEN 'drop_or_impute' WHEN completeness < 95 THEN 'impute' END, CASE WHEN outlier_pct > 5 THEN 'clip_outliers' END,
CASE WHEN abs(skew) > 1.5 THEN 'log_transform' END, CASE WHEN kind = 'text' AND uniqueness < 40 THEN 'review_column' END) AS actions FROM ({PARTS}) q""")
def dq3(t):
    return D.quality_actions(t.dirty_orders)


@query("DQ4", f"SELECT round(s, 1) AS overall_score, {GRADE} AS overall_grade, n_columns, high, medium, low FROM (SELECT avg(s) AS s, count(*) AS n_columns, count(*) FILTER (WHERE s >= 80) AS high, count(*) FILTER (WHERE s >= 50 AND s < 80) AS medium, count(*) FILTER (WHERE s < 50) AS low FROM ({PARTS}) q WHERE \"column\" <> 'priority') z")
def dq4(t):
    return D.table_quality(t.dirty_orders, "priority")


@query("DQ5", f"""WITH c AS (SELECT priority, count(*) AS n FROM {{dirty_orders}} WHERE priority IS NOT NULL GROUP BY 1),
m AS (SELECT count(*) AS n, round(100.0 * sum({MISS}) / (count(*) * 8), 2) AS miss, round(100.0 * {DUP} / count(*), 2) AS dup FROM {{dirty_orders}}),
k AS (SELECT 'rows_per_feature' AS "check", round(n / 7.0, 2) AS value, CASE WHEN n / 7.0 >= 20 THEN 'pass' WHEN n / 7.0 >= 10 THEN 'warning' ELSE 'fail' END AS status FROM m
UNION ALL SELECT 'min_class', min(n), CASE WHEN min(n) >= 50 THEN 'pass' WHEN min(n) >= 20 THEN 'warning' ELSE 'fail' END FROM c
UNION ALL SELECT 'mean_class', floor(avg(n)), CASE WHEN avg(n) >= 100 THEN 'pass' WHEN avg(n) >= 30 THEN 'warning' ELSE 'fail' END FROM c
UNION ALL SELECT 'class_balance', round(1.0 * max(n) / min(n), 1), CASE WHEN 1.0 * max(n) / min(n) <= 2 THEN 'pass' WHEN 1.0 * max(n) / min(n) <= 5 THEN 'warning' ELSE 'fail' END FROM c
UNION ALL SELECT 'missing_pct', miss, CASE WHEN miss <= 5 THEN 'pass' WHEN miss <= 20 THEN 'warning' ELSE 'fail' END FROM m
UNION ALL SELECT 'feature_diversity', 7, 'pass' UNION ALL SELECT 'duplicate_pct', dup, CASE WHEN dup <= 1 THEN 'pass' WHEN dup <= 10 THEN 'warning' ELSE 'fail' END FROM m)
SELECT "check", CAST(value AS DOUBLE) AS value, status FROM k UNION ALL SELECT 'verdict', count(*) FILTER (WHERE status = 'fail'),
CASE WHEN count(*) FILTER (WHERE status = 'fail') >= 2 THEN 'insufficient' WHEN count(*) FILTER (WHERE status = 'fail') = 1 OR count(*) FILTER (WHERE status = 'warning') >= 2 THEN 'marginal' ELSE 'sufficient' END FROM k""")
def dq5(t):
    return D.sufficiency(t.dirty_orders, "priority")


@query("DQ6")
def dq6(t):
    return D.reframings(t.skewed, "heavy", "regression").union(D.reframings(t.learnable, "target", "classification")).union(
        D.reframings(t.dirty_orders, "priority", "classification"))
