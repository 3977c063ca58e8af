"""Profiles of the source tables."""

from pyspark.sql import functions as F

from tablewise.operators import profile as P
from tablewise.plans.registry import query
from tablewise.plans.sqltext import long_form, rnd, union

ORD = [("o_orderkey", "numeric"), ("price", "numeric"), ("cust", "numeric"), ("sparse", "numeric"), ("sentinel_price", "numeric"),
       ("priority", "text"), ("constant_col", "text"), ("o_orderdate", "datetime")]


def _profile(c, kind, table):
    stats = (f"{rnd(f'avg({c})')}, {rnd(f'stddev_samp({c})')}, {rnd(f'min({c})')}, {rnd(f'max({c})')}" if kind == "numeric"
             else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)")
    return (f"SELECT '{c}', '{kind}', count(*) - count({c}), {rnd(f'100.0 * (count(*) - count({c})) / count(*)', 2)}, count(DISTINCT {c}), "
            f"{rnd(f'100.0 * count(DISTINCT {c}) / count(*)', 2)}, {stats} FROM {table}")


@query("PR1", 'SELECT * FROM (' + union(_profile(c, k, "{dirty_orders}") for c, k in ORD) +
       ') x("column", kind, missing, missing_pct, "distinct", distinct_pct, mean, std, min, max)')
def pr1(t):
    return P.column_profile(t.dirty_orders)


@query("PR1_top", f"SELECT * FROM (SELECT \"column\", value, n, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM (SELECT \"column\", value, count(*) AS n FROM ({long_form('part', ['p_name', 'p_brand', 'p_type'], 'VARCHAR')}) m GROUP BY 1, 2) f) r WHERE rank <= 5")
def pr1_top(t):
    return P.top_value_profile(t.part)


@query("PR2", f"""SELECT count(*) AS n_rows, 8 AS n_columns, sum(m) AS missing_cells, {rnd('100.0 * sum(m) / (count(*) * 8)', 2)} AS missing_pct,
(SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM {{dirty_orders}} GROUP BY ALL) g) AS duplicate_rows,
{rnd('100.0 * (SELECT sum(k - 1) FROM (SELECT count(*) AS k FROM {dirty_orders} GROUP BY o_orderkey, price, cust, sparse, sentinel_price, priority, constant_col, o_orderdate) g) / count(*)', 2)} AS duplicate_pct
FROM (SELECT {' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c, _ in ORD)} AS m FROM {{dirty_orders}}) x""".replace(
    "SELECT count(*) AS k FROM {dirty_orders} GROUP BY ALL", "SELECT count(*) AS k FROM {dirty_orders} GROUP BY o_orderkey, price, cust, sparse, sentinel_price, priority, constant_col, o_orderdate"))
def pr2(t):
    return P.table_totals(t.dirty_orders)


@query("PR3", "SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1")
def pr3(t):
    return P.class_distribution(t.orders, "o_orderpriority")


@query("PR5", """SELECT 'price' AS target, 'regression' AS problem_type, count(DISTINCT price) AS "distinct", count(*) AS n_rows FROM {learnable}
UNION ALL SELECT 'o_totalprice', 'regression', count(DISTINCT o_totalprice), count(*) FROM orders
UNION ALL SELECT 'o_orderpriority', 'classification', count(DISTINCT o_orderpriority), count(*) FROM orders""")
def pr5(t):
    found = P.detect_target(t.learnable)
    return (P.detect_problem_type(t.learnable, found)
            .union(P.detect_problem_type(t.orders, "o_totalprice"))
            .union(P.detect_problem_type(t.orders, "o_orderpriority")))


@query("PR6", "SELECT \"column\", mean_length, mean_words, space_share, distinct_ratio, (mean_length > 20 AND distinct_ratio > 0.3 AND mean_words > 3 AND space_share > 0.5) OR (mean_length > 50 AND mean_words > 5) AS is_text FROM (" + union(
    f"""SELECT '{c}' AS "column", {rnd(f'avg(length({c}))')} AS mean_length,
    {rnd(f"avg(CASE WHEN trim({c}) = '' THEN 0 ELSE len(regexp_split_to_array(trim({c}, ' '), '[ \\t\\n\\x0B\\f\\r]+')) END)")} AS mean_words,
    {rnd(f"avg(CASE WHEN regexp_matches({c}, '[ \\t\\n\\x0B\\f\\r]') THEN 1.0 ELSE 0.0 END)")} AS space_share,
    {rnd(f'1.0 * count(DISTINCT {c}) / count({c})')} AS distinct_ratio FROM documents""" for c in ("text", "lang", "source")) + ") x")
def pr6(t):
    return P.text_shape(t.documents)


@query("PR7")
def pr7(t):
    return P.semantic_types(t.text_numbers).unionAll(P.semantic_types(t.orders))


def _hist(table, columns, bins):
    return f"""SELECT b."column", CAST(b.bin AS INTEGER) AS bin, coalesce(h.n, 0) AS n, {rnd('b.mn + b.bin * (b.mx - b.mn) / b.k')} AS lo, {rnd('b.mn + (b.bin + 1) * (b.mx - b.mn) / b.k')} AS hi
FROM (SELECT "column", mn, mx, k, unnest(range(0, k)) AS bin FROM (SELECT "column", min(value) AS mn, max(value) AS mx, {bins} AS k FROM ({long_form(table, columns)}) m GROUP BY 1) s) b
LEFT JOIN (SELECT m."column", least(CAST(floor((value - mn) / ((mx - mn) / k)) AS BIGINT), k - 1) AS bin, count(*) AS n FROM ({long_form(table, columns)}) m
JOIN (SELECT "column", min(value) AS mn, max(value) AS mx, {bins} AS k FROM ({long_form(table, columns)}) m2 GROUP BY 1) s ON m."column" = s."column" WHERE value IS NOT NULL GROUP BY 1, 2) h
ON b."column" = h."column" AND b.bin = h.bin"""


def rounded_hist(df):
    return df.select("column", "bin", "n", (F.round("lo", 4) + F.lit(0.0)).alias("lo"), (F.round("hi", 4) + F.lit(0.0)).alias("hi"))


@query("PR8", _hist("lineitem", ["l_quantity", "l_extendedprice", "l_discount"], "CAST(least(30, greatest(5, count(value) // 10)) AS BIGINT)"))
def pr8(t):
    return rounded_hist(P.column_histograms(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query("PR9", "SELECT \"column\", round(greatest(mn, q1 - 1.5 * (q3 - q1)), 4) + 0.0 AS whisker_low, round(q1, 4) AS q1, round(q2, 4) AS median, round(q3, 4) AS q3, round(least(mx, q3 + 1.5 * (q3 - q1)), 4) AS whisker_high, mean FROM (" + union(
    f"SELECT '{c}' AS \"column\", min({c}) AS mn, max({c}) AS mx, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3, {rnd(f'avg({c})')} AS mean FROM {{skewed}}" for c in ("value", "heavy", "near_copy")) + ") x")
def pr9(t):
    return P.box_plots(t.skewed, ["value", "heavy", "near_copy"])


@query("PR10", "SELECT event_id, value, user_id FROM events ORDER BY CAST('0x' || substr(md5(event_id || ':42'), 1, 13) AS BIGINT), event_id LIMIT 500")
def pr10(t):
    return P.scatter_sample(t.events, ["value", "user_id"], "event_id")


@query("PR11", f"SELECT \"column\", value, n, rank FROM (SELECT \"column\", value, n, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM (SELECT \"column\", value, count(*) AS n FROM ({long_form('documents', ['lang', 'source'], 'VARCHAR')}) m GROUP BY 1, 2) f) r WHERE rank <= 20")
def pr11(t):
    return P.top_value_profile(t.documents, ["lang", "source"], 20)


@query("PR12", union(
    [f"SELECT '{c}' AS \"column\", {rnd(f'min({c})')} AS min, {rnd(f'max({c})')} AS max, {rnd(f'avg({c})')} AS mean, {rnd(f'median({c})')} AS median, {rnd(f'(max({c}) - min({c})) / 100.0', 6)} AS step, CAST(NULL AS VARCHAR) AS mode FROM part" for c in ("p_size", "p_retailprice")] +
    [f"SELECT '{c}', NULL, NULL, NULL, NULL, NULL, (SELECT {c} FROM part GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1)" for c in ("p_brand", "p_type")]))
def pr12(t):
    return P.input_ranges(t.part, ["p_size", "p_retailprice", "p_brand", "p_type"])
