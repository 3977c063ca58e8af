"""Query operators over the source tables."""

from tablewise.operators import query as Q
from tablewise.plans.registry import query
from tablewise.plans.sqltext import rnd, union

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("QR1", "SELECT l_orderkey, l_partkey, l_quantity, l_shipdate FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03 AND l_returnflag = 'R'")
def qr1(t):
    return Q.filter_rows(t.lineitem, "l_quantity > 45 AND l_discount < 0.03 AND l_returnflag = 'R'").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


@query("QR2", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice > 300000")
def qr2(t):
    return Q.select_columns(t.orders, ["O_ORDERKEY", "totalprice", "orderpriority", "absent"], "o_totalprice > 300000")


@query("QR4", "SELECT * FROM {dirty_orders} WHERE priority IS DISTINCT FROM '1-URGENT'")
def qr4(t):
    return Q.compare_rows(t.dirty_orders, "priority", "!=", "1-URGENT")


@query("QR5", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def qr5(t):
    return Q.top_rows(t.orders.select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("QR6", f"SELECT count(*) FILTER (WHERE l_quantity >= 25) AS matching, count(*) AS total, {rnd('100.0 * count(*) FILTER (WHERE l_quantity >= 25) / count(*)', 2)} AS percent FROM lineitem")
def qr6(t):
    return Q.count_matching(t.lineitem, Q.comparison("l_quantity", ">=", "25"))


@query("QR7", "SELECT p_type AS value, count(*) AS n FROM part WHERE p_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def qr7(t):
    return Q.value_counts(t.part, "p_type")


@query("QR8", "SELECT count(*) AS n_rows FROM lineitem")
def qr8(t):
    return Q.row_count(t.lineitem)


@query("QR9", "SELECT l_returnflag, " + ", ".join(f"{rnd(f'avg({c})')} AS {c}" for c in LINE_NUM) + " FROM lineitem GROUP BY 1")
def qr9(t):
    return Q.group_by(t.lineitem, "l_returnflag", "mean", LINE_NUM)


@query("QR9_all", union(
    f"SELECT o_orderpriority, '{f}' AS agg, {rnd(f'{f}(o_totalprice)')} AS o_totalprice FROM orders GROUP BY 1" for f in ("sum", "count", "max", "min")))
def qr9_all(t):
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [Q.group_by(t.orders, "o_orderpriority", f, ["o_totalprice"]).select(
        "o_orderpriority", F.lit(f).alias("agg"), F.round(F.col("o_totalprice").cast("double"), 4).alias("o_totalprice"))
        for f in ("sum", "count", "max", "min")]
    return reduce(lambda a, b: a.union(b), parts)


@query("QR10", union(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, {rnd(f'avg({c})')} AS mean, {rnd(f'stddev_samp({c})')} AS std, "
    f"{rnd(f'min({c})')} AS min, {rnd(f'quantile_cont({c}, 0.25)')} AS q25, {rnd(f'quantile_cont({c}, 0.5)')} AS q50, "
    f"{rnd(f'quantile_cont({c}, 0.75)')} AS q75, {rnd(f'max({c})')} AS max FROM lineitem" for c in LINE_NUM))
def qr10(t):
    return Q.describe(t.lineitem, LINE_NUM)


@query("QR10_text", union(
    f"SELECT '{c}' AS \"column\", (SELECT count({c}) FROM part) AS count, (SELECT count(DISTINCT {c}) FROM part) AS \"unique\", {c} AS top, n AS freq "
    f"FROM (SELECT {c}, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, {c} LIMIT 1) x{i}" for i, c in enumerate(["p_name", "p_brand", "p_type"])))
def qr10_text(t):
    return Q.describe_text(t.part, ["p_name", "p_brand", "p_type"])


@query("QR11", union(f"SELECT '{f}' AS measure, {rnd(f'{f}(o_totalprice)')} AS value FROM orders" for f in ("avg", "sum", "max", "min", "median")))
def qr11(t):
    from functools import reduce

    from pyspark.sql import functions as F

    parts = [Q.scalar(t.orders, "o_totalprice", f).select(F.lit("avg" if f == "mean" else f).alias("measure"), "value")
             for f in ("mean", "sum", "max", "min", "median")]
    return reduce(lambda a, b: a.union(b), parts)


@query("QR12", "SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total, true AS truncated FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 200")
def qr12(t):
    from pyspark.sql import functions as F

    df = t.orders.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice").orderBy("o_orderkey")
    head, more, total = Q.cut_result(df, 200, with_total=True)
    return head.select("*", F.lit(total).cast("long").alias("total"), F.lit(more).alias("truncated"))
