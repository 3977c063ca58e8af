"""Inputs derived from the source tables. Each text gives the same rows in Spark and in the oracle."""

DERIVED = {
    "dirty_orders": """
SELECT o_orderkey,
  CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 20 IN (3, 4) THEN NULL ELSE o_custkey END AS cust,
  CASE WHEN o_orderkey % 4 <> 0 THEN NULL ELSE o_totalprice END AS sparse,
  CASE WHEN o_orderkey % 50 = 7 THEN -999999.0 ELSE o_totalprice / 10 END AS sentinel_price,
  CASE WHEN o_orderkey % 15 = 5 THEN NULL ELSE o_orderpriority END AS priority,
  'x' AS constant_col, o_orderdate
FROM {orders}
UNION ALL
SELECT o_orderkey, o_totalprice, o_custkey, o_totalprice, o_totalprice / 10, o_orderpriority, 'x', o_orderdate
FROM {orders} WHERE o_totalprice < 6000
UNION ALL
SELECT o_orderkey, o_totalprice, o_custkey, o_totalprice, o_totalprice / 10, o_orderpriority, 'x', o_orderdate
FROM {orders} WHERE o_totalprice < 6000""",
    "co_gaps": """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS a,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 1 THEN NULL ELSE o_custkey END AS b,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS c
FROM {orders}""",
    "gappy_orders": """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_totalprice END AS price,
  CASE WHEN o_orderkey % 20 IN (3, 4) THEN NULL ELSE o_custkey END AS cust, o_custkey % 11 AS o_shippriority
FROM {orders}""",
    "gappy": """
SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority,
  CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' THEN NULL ELSE o_totalprice END AS price
FROM {orders}""",
    "text_numbers": """
SELECT c_custkey,
  concat('$', CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR(20))) AS balance_text,
  concat(CAST(c_custkey % 100 AS VARCHAR(10)), '%') AS share_text,
  CASE WHEN c_custkey % 25 = 0 THEN 'n/a' ELSE CAST(c_custkey AS VARCHAR(20)) END AS mostly_number,
  CASE WHEN c_custkey % 3 = 0 THEN 'Yes' ELSE 'no' END AS flag_text,
  CASE c_custkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'Medium' ELSE 'high' END AS level_text,
  concat('20', lpad(CAST(c_custkey % 20 AS VARCHAR(4)), 2, '0'), '-', lpad(CAST(c_custkey % 12 + 1 AS VARCHAR(4)), 2, '0'),
         '-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR(4)), 2, '0')) AS date_text,
  c_mktsegment
FROM {customer}""",
    "contacts": """
SELECT c_custkey,
  concat('user', CAST(c_custkey AS VARCHAR(20)), '@mail', CAST(c_custkey % 7 AS VARCHAR(2)), '.example.com') AS email,
  concat('555-', lpad(CAST(c_custkey % 1000 AS VARCHAR(4)), 3, '0'), '-', lpad(CAST(c_custkey % 10000 AS VARCHAR(5)), 4, '0')) AS phone,
  concat(lpad(CAST(c_custkey % 900 + 100 AS VARCHAR(4)), 3, '0'), '-12-', lpad(CAST(c_custkey % 10000 AS VARCHAR(5)), 4, '0')) AS ssn,
  CASE WHEN c_custkey % 2 = 0 THEN '4111111111111111' ELSE '4111111111111112' END AS card_number,
  c_name AS customer_name
FROM {customer}""",
    "skewed": """
SELECT event_id, user_id, event_type, value,
  exp(value / 60.0) AS heavy, value * 2.0 + event_id % 5 AS near_copy, event_id % 13 AS small_int
FROM {events}""",
    "drift_sides": """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS side,
  CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN value ELSE value * 1.3 END AS value,
  CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' AND event_id % 5 = 0 THEN 'new_kind' ELSE event_type END AS kind
FROM {events}""",
    "predictions": "\nUNION ALL\n".join(
        f"""SELECT d.doc_id, {m} AS model, l.quality AS label, l.toxic, d.lang, d.source, d.n_chars,
  CASE WHEN (d.doc_id * 7 + {m} * 3) % 10 < {m} + 1 THEN 1 - l.quality ELSE l.quality END AS prediction,
  CAST(((d.doc_id * 37 + {m} * 11) % 100) AS DOUBLE) / 100.0 AS prob
FROM {{documents}} d JOIN {{labels}} l ON d.doc_id = l.doc_id"""
        for m in range(3)
    ),
    "reg_predictions": """
SELECT o_orderkey, o_orderpriority, o_totalprice AS label,
  o_totalprice * (0.9 + (o_orderkey % 21) / 100.0) AS prediction
FROM {orders}""",
    "series": """
SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total
FROM {events} GROUP BY event_type, CAST(ts AS DATE)""",
    "baskets": """
SELECT user_id, CAST(ts AS DATE) AS day,
  max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS view_flag,
  max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS click_flag,
  max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS purchase_flag,
  max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS error_flag
FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "learnable": """
SELECT o_orderkey, o_totalprice AS price, o_custkey % 17 AS f1, o_orderkey % 11 AS f2, o_orderpriority,
  CASE WHEN (o_custkey % 17) * 3 + (o_orderkey % 11) * 2 > 50 THEN 1 ELSE 0 END AS target
FROM {orders}""",
    "experiments": """
SELECT c_custkey AS id, concat('exp_', CAST(c_custkey AS VARCHAR(10))) AS name, c_mktsegment AS dataset_type,
  CASE WHEN c_custkey % 3 = 0 THEN 'regression' ELSE 'classification' END AS problem_type,
  CAST(50 + c_custkey * 13 % 50 AS DOUBLE) / 100.0 AS score, c_custkey * 7 % 19 AS cost,
  CASE WHEN c_custkey % 4 = 0 THEN 'created' ELSE 'complete' END AS status
FROM {customer}""",
    "runs": """
SELECT c_custkey AS experiment_id, 'forest' AS model, CAST(c_custkey * 7 % 31 AS DOUBLE) / 31.0 AS metric FROM {customer}
UNION ALL SELECT c_custkey, 'linear', CAST(c_custkey * 11 % 37 AS DOUBLE) / 37.0 + 0.001 FROM {customer}
UNION ALL SELECT c_custkey, 'boosted', CAST(c_custkey * 5 % 41 AS DOUBLE) / 41.0 + 0.002 FROM {customer}""",
    "annotations": """
SELECT event_id AS id, user_id AS experiment_id, ts AS created_at, value,
  CASE event_type WHEN 'click' THEN 'correct' WHEN 'view' THEN 'correct' WHEN 'error' THEN 'incorrect' ELSE 'uncertain' END AS label
FROM {events}""",
}
