"""Cleaning, coercion, missing values, constraints and personal data over the source tables."""

from pyspark.sql import functions as F

from tablewise.functions.fixed_values import PERSONAL_KINDS
from tablewise.operators import cleaning as C
from tablewise.operators import coercion as U
from tablewise.operators import constraints as K
from tablewise.operators import information as I
from tablewise.operators import missingness as M
from tablewise.operators import privacy as P
from tablewise.plans.explore_plans import _outliers
from tablewise.plans.profile_plans import ORD
from tablewise.plans.registry import query
from tablewise.plans.sqltext import long_form, rnd, union


@query("CN1", "SELECT DISTINCT * FROM {dirty_orders}")
def cn1(t):
    return C.drop_duplicates(t.dirty_orders)


@query("CN2", "SELECT c_custkey, balance_text, share_text, TRY_CAST(trim(mostly_number) AS DOUBLE) AS mostly_number, flag_text, level_text, date_text, c_mktsegment FROM {text_numbers}")
def cn2(t):
    return C.fix_types(t.text_numbers)


@query("CN3", "SELECT o_orderkey, price, cust, sentinel_price, priority, constant_col, o_orderdate FROM {dirty_orders}")
def cn3(t):
    return C.drop_missing_columns(t.dirty_orders)


@query("CN5", "SELECT o_orderkey, " + ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), (SELECT median({c}) FROM {{dirty_orders}})), 4) AS {c}" for c in ("price", "cust", "sparse")) + " FROM {dirty_orders}")
def cn5(t):
    return C.fill_median(t.dirty_orders).select("o_orderkey", *[F.round(c, 4).alias(c) for c in ("price", "cust", "sparse")])


MODE = "(SELECT priority FROM {dirty_orders} WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)"


@query("CN6", f"SELECT o_orderkey, coalesce(priority, {MODE}) AS priority FROM {{dirty_orders}}")
def cn6(t):
    return C.fill_mode(t.dirty_orders).select("o_orderkey", "priority")


@query("CN9", """WITH f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {skewed}) z),
d AS (SELECT abs(skewness(value)) <= 2 AND count(DISTINCT value) <= 0.9 * count(*) AND count(*) FILTER (WHERE value < (SELECT lo FROM f) OR value > (SELECT hi FROM f)) >= 0.02 * count(*) AS cap FROM {skewed})
SELECT event_id, round(CASE WHEN (SELECT cap FROM d) THEN least(greatest(value, (SELECT lo FROM f)), (SELECT hi FROM f)) ELSE value END, 4) AS value FROM {skewed}""")
def cn9(t):
    return C.cap_outliers(t.skewed, ["value"]).select("event_id", F.round("value", 4).alias("value"))


@query("CN10", """WITH f AS (SELECT quantile_cont(heavy, 0.01) AS lo, quantile_cont(heavy, 0.99) AS hi, abs(skewness(heavy)) > 2 AND count(DISTINCT heavy) <= 0.9 * count(*) AS cap FROM {skewed})
SELECT event_id, round(CASE WHEN cap THEN least(greatest(heavy, lo), hi) ELSE heavy END, 4) AS heavy FROM {skewed}, f""")
def cn10(t):
    return C.cap_outliers(t.skewed, ["heavy"]).select("event_id", F.round("heavy", 4).alias("heavy"))


@query("CN11")
def cn11(t):
    return C.clean_table(t.dirty_orders)[1]


SUG = ["o_orderkey", "price", "cust", "sparse", "sentinel_price"]


@query("CN12", f"""WITH n AS (SELECT count(*) AS n FROM {{dirty_orders}}),
o AS (SELECT "column", pct, lower_bound, upper_bound FROM ({_outliers(SUG, '{dirty_orders}')}) x),
g AS ({union(f"SELECT '{c}' AS c, {i} AS i, round(100.0 * (count(*) - count({c})) / count(*), 1) AS pct, {f'abs(skewness({c}))' if k == 'numeric' else 'NULL'} AS sk, '{k}' AS k, count(DISTINCT {c}) AS u FROM {{dirty_orders}}" for i, (c, k) in enumerate(ORD))}),
s AS (SELECT 1 AS a, 0 AS b, 'duplicates' AS type, '__all__' AS "column", CASE WHEN 100.0 * (n - (SELECT count(*) FROM (SELECT DISTINCT * FROM {{dirty_orders}}) d)) / n > 5 THEN 'high' ELSE 'medium' END AS impact, NULL AS strategy, NULL AS low, NULL AS high FROM n
UNION ALL SELECT 2, i, CASE WHEN pct > 60 THEN 'drop_column' ELSE 'fill_missing' END, c, CASE WHEN pct > 20 THEN 'high' WHEN pct > 5 THEN 'medium' ELSE 'low' END, CASE WHEN pct > 60 THEN NULL WHEN k <> 'numeric' THEN 'mode' WHEN sk > 1 AND u > 2 THEN 'median' ELSE 'mean' END, NULL, NULL FROM g WHERE pct > 0
UNION ALL SELECT 3, list_position({SUG}, "column"), 'remove_outliers', "column", CASE WHEN round(pct, 1) < 5 THEN 'medium' ELSE 'high' END, NULL, lower_bound, upper_bound FROM o WHERE round(pct, 1) > 0.5
UNION ALL SELECT 4, 0, 'drop_column', 'constant_col', 'medium', 'constant', NULL, NULL
UNION ALL SELECT 6, 0, 'drop_correlated', 'sparse', 'medium', 'price', NULL, NULL UNION ALL SELECT 6, 1, 'drop_correlated', 'sentinel_price', 'medium', 'sparse', NULL, NULL)
SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS id, type, "column", impact, strategy, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high FROM s""")
def cn12(t):
    return C.suggestions(t.dirty_orders)


@query("CN13", f"""SELECT o_orderkey, round(coalesce(price, m), 4) AS price, round(coalesce(cust, c), 4) AS cust, coalesce(priority, p) AS priority FROM (SELECT DISTINCT o_orderkey, price, cust, sparse, sentinel_price, priority, constant_col, o_orderdate FROM {{dirty_orders}}) x,
(SELECT avg(price) AS m, avg(cust) AS c FROM (SELECT DISTINCT * FROM {{dirty_orders}}) y) a,
(SELECT priority AS p FROM (SELECT DISTINCT * FROM {{dirty_orders}}) z WHERE priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1) b,
(SELECT round(quantile_cont(sentinel_price, 0.25) - 1.5 * (quantile_cont(sentinel_price, 0.75) - quantile_cont(sentinel_price, 0.25)), 4) AS lo, round(quantile_cont(sentinel_price, 0.75) + 1.5 * (quantile_cont(sentinel_price, 0.75) - quantile_cont(sentinel_price, 0.25)), 4) AS hi FROM {{dirty_orders}}) f
WHERE sentinel_price BETWEEN lo AND hi""")
def cn13(t):
    df = t.dirty_orders
    return C.apply_suggestions(df, C.suggestions(df)).select("o_orderkey", F.round("price", 4).alias("price"), F.round("cust", 4).alias("cust"), "priority")


@query("CN15")
def cn15(t):
    df = t.learnable
    return C.column_fates(df, ["price", "f1", "o_orderpriority_2-HIGH"], "target", {"o_orderkey": "identifier"}, {}, ["price"])


@query("CN16")
def cn16(t):
    df = t.learnable
    return C.fate_summary(C.column_fates(df, ["price", "f1", "o_orderpriority_2-HIGH"], "target", {"o_orderkey": "identifier"}, {}, ["price"]))


def _decile_bin(c, table):
    edges = f"(SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) FROM {table})"
    return f"SELECT '{c}' AS feature, target AS y, len(list_filter(list_slice({edges}, 2, -2), lambda e: e < CAST({c} AS DOUBLE))) AS bin FROM {table}"


MI = "SELECT feature, greatest(0.0, sum(n / total * ln(n * total / (nx * ny)))) AS mi FROM (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM ({}) c GROUP BY 1, 2, 3) j) p GROUP BY 1"


@query("CN17", f"""WITH m AS ({MI.replace('{}', union(_decile_bin(c, '{learnable}') for c in ('o_orderkey', 'price', 'f1', 'f2')))})
SELECT feature AS "column", round(mi / (SELECT max(mi) FROM m), 4) AS importance FROM m UNION ALL SELECT 'o_orderpriority', 0.3""")
def cn17(t):
    return I.scaled_importance(t.learnable, "target")


INF = "SELECT CASE WHEN cust % 50 = 0 THEN NULL ELSE price END AS price FROM {dirty_orders}"


@query("CN18", f"SELECT count(*) AS n, 0 AS bad, round(max(coalesce(price, (SELECT median(price) FROM ({INF}) m))), 2) AS top FROM ({INF}) x")
def cn18(t):
    df = t.dirty_orders.withColumn("price", F.when(F.col("cust") % 50 == 0, F.lit(float("inf"))).otherwise(F.col("price")))
    return C.repair_nonfinite(df, ["price", "cust"]).agg(
        F.count("*").alias("n"), F.count_if(F.isnan("price") | F.col("price").isNull()).alias("bad"), F.round(F.max("price"), 2).alias("top"))


@query("CN19")
def cn19(t):
    df = t.learnable.withColumn("flat", F.lit(1.0)).withColumn("flat2", F.lit(2.0)).withColumn("flat3", F.lit(2.0))
    return C.diagnose_scores(df, "target", ["f1", "flat", "flat2", "flat3"], 0.5, 0.9, 0.6)


# Column coercions


@query("UT1", "SELECT o_orderkey AS order_key, o_totalprice AS order_key_1, o_orderdate AS col_2 FROM orders")
def ut1(t):
    df = t.orders.select(F.col("o_orderkey").alias(" Order Key#"), F.col("o_totalprice").alias("order key"), F.col("o_orderdate").alias("$$"))
    return U.clean_names(df)[0]


@query("UT2", "SELECT event_id, user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events")
def ut2(t):
    return U.flatten_json(t.events.select("event_id", "user_id", "props"))[0]


@query("UT3", r"SELECT page_id, url, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS html FROM pages")
def ut3(t):
    return U.strip_markup(t.pages)[0]


@query("UT4", "SELECT doc_id, lang FROM documents")
def ut4(t):
    return U.drop_encoded(t.documents.select("doc_id", "lang", F.base64(F.concat_ws("-", F.lit("a long enough text"), F.col("source"))).alias("blob")))[0]


@query("UT5", r"SELECT c_custkey, ssn_text, customer_name, regexp_extract(email, '@([\w.]+)', 1) AS email_domain FROM (SELECT *, concat('s', ssn) AS ssn_text FROM {contacts}) x")
def ut5(t):
    df = t.contacts.select("c_custkey", "email", "phone", F.concat(F.lit("https://x.example/"), "c_custkey").alias("site"), F.concat(F.lit("s"), "ssn").alias("ssn_text"), "customer_name")
    return U.handle_contacts(df)[0]


@query("UT6", "SELECT c_custkey, TRY_CAST(replace(replace(balance_text, '$', ''), ',', '') AS DOUBLE) AS balance, CAST(c_custkey AS DOUBLE) + 0.25 AS eu FROM {text_numbers}")
def ut6(t):
    df = t.text_numbers.select("c_custkey", F.col("balance_text").alias("balance"), F.concat(F.col("c_custkey").cast("string"), F.lit(",25 €")).alias("eu"))
    return U.parse_currency(df)[0]


@query("UT7", "SELECT c_custkey, round(CAST(c_custkey % 100 AS DOUBLE) / 100.0, 4) AS share_text FROM {text_numbers}")
def ut7(t):
    return U.parse_percent(t.text_numbers)[0].select("c_custkey", F.round("share_text", 4).alias("share_text"))


@query("UT8", "SELECT c_custkey, CASE WHEN flag_text = 'Yes' THEN 1 ELSE 0 END AS flag_text FROM {text_numbers}")
def ut8(t):
    return U.unify_flags(t.text_numbers)[0].select("c_custkey", "flag_text")


@query("UT9", "SELECT c_custkey, TRY_CAST(replace(trim(mostly_number), ',', '') AS DOUBLE) AS mostly_number, flag_text FROM {text_numbers}")
def ut9(t):
    return U.coerce_numbers(t.text_numbers)[0].select("c_custkey", "mostly_number", "flag_text")


@query("UT10", "SELECT c_custkey, CAST(year(d) AS INTEGER) AS date_text_year, CAST(month(d) AS INTEGER) AS date_text_month, CAST(isodow(d) - 1 AS INTEGER) AS date_text_dayofweek FROM (SELECT c_custkey, CAST(date_text AS DATE) AS d FROM {text_numbers}) x")
def ut10(t):
    return U.unify_dates(t.text_numbers.select("c_custkey", "date_text"))[0]


@query("UT11", "SELECT c_mktsegment, c_acctbal FROM customer")
def ut11(t):
    return U.drop_ids(t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"))[0]


@query("UT12", "SELECT o_orderkey, price, cust, sparse, sentinel_price, priority, o_orderdate FROM {dirty_orders}")
def ut12(t):
    return U.drop_constants(t.dirty_orders)[0]


@query("UT13", "SELECT o_orderkey, price FROM {dirty_orders}")
def ut13(t):
    return U.drop_sparse(t.dirty_orders.select("o_orderkey", "price", F.expr("CASE WHEN o_orderkey % 25 = 0 THEN price END").alias("rare")))[0]


@query("UT14", "SELECT o_orderkey, sentinel_price FROM {dirty_orders}")
def ut14(t):
    return U.blank_sentinels(t.dirty_orders.select("o_orderkey", "sentinel_price"))[0]


@query("UT14_hit", "SELECT o_orderkey, CASE WHEN sentinel_price <> -999999.0 THEN sentinel_price + 9000 END AS v FROM {dirty_orders}")
def ut14_hit(t):
    return U.blank_sentinels(t.dirty_orders.select("o_orderkey", F.expr("CASE WHEN sentinel_price = -999999.0 THEN 999999.0 ELSE sentinel_price + 9000 END").alias("v")))[0]


@query("UT15", "SELECT c_custkey, CASE lower(level_text) WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS level_text FROM {text_numbers}")
def ut15(t):
    return U.rank_ordered_words(t.text_numbers)[0].select("c_custkey", "level_text")


@query("UT16", "SELECT l_returnflag, l_orderkey, l_extendedprice, l_partkey FROM lineitem")
def ut16(t):
    return U.prune_width(t.lineitem.select("l_returnflag", "l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount"), 3)[0]


@query("UT17", """SELECT TRY_CAST(replace(balance_text, '$', '') AS DOUBLE) AS balance_text, round(CAST(c_custkey % 100 AS DOUBLE) / 100.0, 4) AS share_text, TRY_CAST(mostly_number AS DOUBLE) AS mostly_number, CASE WHEN flag_text = 'Yes' THEN 1 ELSE 0 END AS flag_text,
CASE lower(level_text) WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS level_text, c_mktsegment, CAST(year(d) AS INTEGER) AS date_text_year, CAST(month(d) AS INTEGER) AS date_text_month, CAST(isodow(d) - 1 AS INTEGER) AS date_text_dayofweek FROM (SELECT *, CAST(date_text AS DATE) AS d FROM {text_numbers}) x""")
def ut17(t):
    return U.transform_any(t.text_numbers)[0].withColumn("share_text", F.round("share_text", 4))


# Missing values


@query("MS1")
def ms1(t):
    return M.little_test(t.dirty_orders, ["price", "cust", "sentinel_price"])


@query("MS2")
def ms2(t):
    return M.independence_tests(t.dirty_orders)


@query("MS3")
def ms3(t):
    return M.mar_scores(t.dirty_orders)


@query("MS4")
def ms4(t):
    return M.missing_labels(t.dirty_orders)


GAPS = ["price", "cust", "sparse", "priority"]


@query("MS5", union(f"SELECT '{a}' AS column_1, '{b}' AS column_2, {rnd(f'corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END)')} AS correlation FROM {{dirty_orders}}"
                    for i, a in enumerate(GAPS) for b in GAPS[i + 1:]))
def ms5(t):
    return M.null_correlations(t.dirty_orders)


@query("MS6", "SELECT o_orderkey, CASE WHEN price IS NULL THEN 1 ELSE 0 END AS price_is_missing, CASE WHEN sparse IS NULL THEN 1 ELSE 0 END AS sparse_is_missing FROM {dirty_orders}")
def ms6(t):
    return M.missing_flags(t.dirty_orders, ["price", "sparse", "constant_col"]).select("o_orderkey", "price_is_missing", "sparse_is_missing")


@query("MS7")
def ms7(t):
    return M.missing_summary(M.missing_labels(t.dirty_orders), M.little_test(t.dirty_orders, ["price", "cust", "sentinel_price"]))


# Constraints


def _rules(t, kind, *columns):
    df = t.dirty_orders
    return K.rules_frame(df, [r for r in K.learn(df) if r["type"] == kind]).select(*columns)


NUMS = [c for c, k in ORD if k == "numeric"]


@query("CT1", "SELECT * FROM (" + union(f"SELECT '{c}' AS \"column\" FROM {{dirty_orders}} HAVING count(*) = count({c})" for c, _ in ORD) + ") x")
def ct1(t):
    return _rules(t, "not_null", "column")


@query("CT2", union(f"SELECT '{c}' AS \"column\", CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM {{dirty_orders}}" for c in NUMS))
def ct2(t):
    return _rules(t, "range", "column", "low", "high")


@query("CT3", union(f"SELECT '{c}' AS \"column\" FROM {{dirty_orders}} HAVING bool_and({c} = floor({c}))" for c in NUMS))
def ct3(t):
    return _rules(t, "integer_only", "column")


@query("CT4", union(f"SELECT '{c}' AS \"column\" FROM {{dirty_orders}} HAVING min({c}) >= 0" for c in NUMS))
def ct4(t):
    return _rules(t, "non_negative", "column")


@query("CT5", union(f"SELECT '{c}' AS \"column\", array_to_string(list_sort(list(DISTINCT {c})), '|') AS \"values\" FROM {{dirty_orders}} WHERE {c} IS NOT NULL" for c in ("priority", "constant_col")))
def ct5(t):
    return _rules(t, "allowed_values", "column", "values").withColumn("values", F.array_join("values", "|"))


@query("CT6", union(f"SELECT '{c}' AS \"column\" FROM customer HAVING count(DISTINCT {c}) = count(*)" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")))
def ct6(t):
    df = t.customer
    return K.rules_frame(df, [r for r in K.learn(df) if r["type"] == "unique"]).select("column")


COND = union(f"""SELECT '{a}' AS "column", '{b}' AS condition_column, {b} AS condition_value FROM (SELECT {b}, count(*) AS n, count(*) - count({a}) AS k FROM {{gappy}} WHERE {b} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {b} LIMIT 5) x{i} WHERE n >= 10 AND k = 0"""
             for i, (a, b) in enumerate([("price", "status"), ("price", "priority")]))


@query("CT7", COND)
def ct7(t):
    df = t.gappy
    return K.rules_frame(df, [r for r in K.learn(df) if r["type"] == "conditional_not_null"]).select("column", "condition_column", "condition_value")


FIT = [dict(type="not_null", column="price"), dict(type="range", column="sentinel_price", low=1000.0, high=30000.0), dict(type="integer_only", column="cust"),
       dict(type="non_negative", column="sentinel_price"), dict(type="allowed_values", column="priority", values=["1-URGENT", "2-HIGH"]),
       dict(type="conditional_not_null", column="price", condition_column="constant_col", condition_value="x")]
BROKEN = """SELECT o_orderkey AS key, 'price' AS "column", 'not_null' AS rule, CAST(NULL AS VARCHAR) AS value, 'high' AS severity FROM {dirty_orders} WHERE price IS NULL
UNION ALL SELECT o_orderkey, 'sentinel_price', 'range', 'v', CASE WHEN sentinel_price < 500 OR sentinel_price > 60000 THEN 'high' ELSE 'medium' END FROM {dirty_orders} WHERE sentinel_price < 1000 OR sentinel_price > 30000
UNION ALL SELECT o_orderkey, 'sentinel_price', 'non_negative', 'v', 'high' FROM {dirty_orders} WHERE sentinel_price < 0
UNION ALL SELECT o_orderkey, 'priority', 'allowed_values', 'v', 'medium' FROM {dirty_orders} WHERE priority NOT IN ('1-URGENT', '2-HIGH')
UNION ALL SELECT o_orderkey, 'price', 'not_null_when_constant_col=x', NULL, 'medium' FROM {dirty_orders} WHERE price IS NULL"""


@query("CT8", BROKEN)
def ct8(t):
    return K.violations(t.dirty_orders, FIT, "o_orderkey").withColumn("value", F.when(F.col("value").isNotNull(), "v"))


@query("CT8_unique", "SELECT o_orderkey AS key, 'o_orderkey' AS \"column\", 'unique' AS rule, CAST(o_orderkey AS VARCHAR) AS value, 'high' AS severity FROM {dirty_orders} WHERE o_orderkey IN (SELECT o_orderkey FROM {dirty_orders} GROUP BY 1 HAVING count(*) > 1)")
def ct8_unique(t):
    return K.violations(t.dirty_orders, [dict(type="unique", column="o_orderkey")], "o_orderkey")


@query("CT9", f"SELECT \"column\", count(*) AS violations, count(DISTINCT key) AS rows, round(100.0 * (SELECT count(DISTINCT key) FROM ({BROKEN}) a) / (SELECT count(*) FROM {{dirty_orders}}), 2) AS violation_rate FROM ({BROKEN}) b GROUP BY 1")
def ct9(t):
    df = t.dirty_orders
    return K.violation_summary(K.violations(df, FIT, "o_orderkey"), df.count())


# Personal data


KINDS = [(k, p, h, r) for k, p, h, r in PERSONAL_KINDS]


def _kind_score(c, i, k, pattern, hints, risk):
    """Score of one kind for one text column, as one row."""
    named = 0.5 if any(h in c for h in hints) else 0.0
    hit = f"avg(CASE WHEN regexp_matches({c}, '{pattern}') THEN 1.0 ELSE 0.0 END)" if pattern else "0.0"
    extra = "1.0"
    if k == "credit_card":  # the even keys carry the valid card number, everything else fails the check digit
        extra = f"CASE WHEN h > 0 AND (SELECT avg(CASE WHEN {c} = '4111111111111111' THEN 1.0 ELSE 0.0 END) FROM {{contacts}}) < 0.5 * h THEN 0.3 ELSE 1.0 END"
    bonus = "0.0"
    if k == "name" and named:
        hit = f"avg(CASE WHEN {c} = upper(left({c}, 1)) || lower(substr({c}, 2)) OR {c} = upper({c}) THEN 1.0 ELSE 0.0 END)"
        bonus = "CASE WHEN h > 0.5 AND u > 0.3 THEN 0.3 ELSE 0.0 END"
    step = "CASE WHEN h > 0.3 THEN 0.4 WHEN h > 0.1 THEN 0.2 WHEN h > 0.01 THEN 0.1 ELSE 0.0 END" if pattern else "0.0"
    return (f"SELECT '{c}' AS \"column\", {i} AS i, '{k}' AS kind, '{risk}' AS risk, h, ({named} + {step}) * {extra} + {bonus} AS score "
            f"FROM (SELECT {hit} AS h, 1.0 * count(DISTINCT {c}) / count(*) AS u FROM {{contacts}}) s")


SCAN_SQL = "SELECT \"column\", kind, round(score, 2) AS confidence, round(100.0 * h, 1) AS match_pct, risk FROM (SELECT *, row_number() OVER (PARTITION BY \"column\" ORDER BY score DESC, i) AS r FROM (" + union(
    _kind_score(c, i, *k) for c in ("email", "phone", "ssn", "card_number", "customer_name") for i, k in enumerate(KINDS)) + ") a) b WHERE r = 1 AND score >= 0.4"


@query("PI1", SCAN_SQL)
def pi1(t):
    return P.scan(t.contacts)


@query("PI1_documents", union(f"SELECT '{k}' AS kind, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}')" for k, p in (
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"), ("ip_address", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"), ("ssn", r"\b\d{3}-\d{2}-\d{4}\b"))))
def pi1_documents(t):
    pats = {k: p for k, p, _, _ in PERSONAL_KINDS}
    kinds = ["email", "ip_address", "ssn"]
    row = t.documents.agg(*[F.count_if(F.col("text").rlike(pats[k])).alias(k) for k in kinds])
    return row.unpivot([], kinds, "kind", "n")


@query("PI2", "SELECT count(*) AS matches, count(*) FILTER (WHERE c_custkey % 2 = 0) AS valid, 1.0 AS factor FROM {contacts}")
def pi2(t):
    return P.card_check(t.contacts, "card_number")


@query("PI3", "SELECT 'customer_name' AS \"column\", 1.0 AS title_share, round(1.0 * count(DISTINCT customer_name) / count(*), 4) AS distinct_ratio, true AS looks_like_names FROM {contacts}")
def pi3(t):
    return P.name_columns(t.contacts)


@query("PI4", "SELECT c_custkey, substr(sha256('pepper:' || email), 1, 16) AS email, substr(sha256('pepper:' || ssn), 1, 16) AS ssn FROM {contacts}")
def pi4(t):
    return P.mask_hash(t.contacts, ["email", "ssn"], "pepper").select("c_custkey", "email", "ssn")


@query("PI5", "SELECT c_custkey, 'tok_' || substr(sha256('k1|phone|' || phone), 1, 24) AS phone FROM {contacts}")
def pi5(t):
    return P.mask_token(t.contacts, ["phone"], "k1").select("c_custkey", "phone")


@query("PI6", "SELECT o_orderkey, CASE WHEN priority IS NOT NULL THEN '[REDACTED]' END AS priority FROM {dirty_orders}")
def pi6(t):
    return P.mask_redact(t.dirty_orders, ["priority"]).select("o_orderkey", "priority")


@query("PI7", "SELECT c_custkey, substr(email, 1, 2) || '***@' || split_part(email, '@', 2) AS email, '***' || right(phone, 4) AS phone, '***' || right(ssn, 4) AS ssn, substr(customer_name, 1, 1) || '***' AS customer_name FROM {contacts}")
def pi7(t):
    return t.contacts.select("c_custkey", P.partial(F.col("email"), "email").alias("email"), P.partial(F.col("phone"), "phone").alias("phone"),
                             P.partial(F.col("ssn"), "ssn").alias("ssn"), P.partial(F.col("customer_name"), "name").alias("customer_name"))


@query("PI8", f"""SELECT *, CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'none' END AS overall FROM (
SELECT {', '.join(f"count(*) FILTER (WHERE risk = '{r}') AS {r}" for r in ('critical', 'high', 'medium', 'low'))} FROM ({SCAN_SQL}) s) c""")
def pi8(t):
    return P.risk_summary(P.scan(t.contacts))


@query("PI8_mask", union(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_before, count(DISTINCT {c}) AS distinct_after FROM {{contacts}}" for c in ("email", "card_number")))
def pi8_mask(t):
    df = t.contacts
    return P.mask_report(df, P.mask_hash(df, ["email", "card_number"], "pepper"), ["email", "card_number"])
