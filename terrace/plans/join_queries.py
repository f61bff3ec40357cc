"""Queries of the join, aggregate and level-of-detail operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators.spread import beside, percentiles
from .catalogue import query


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(t):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    return (
        t("lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"),
            F.round(F.sum(price * (1 - discount)), 2).alias("sum_disc_price"), F.round(F.sum(price * (1 - discount) * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg(price), 4).alias("avg_price"), F.round(F.avg(discount), 4).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
    )


def _orders(t):
    return t("orders").select("o_orderkey", "o_custkey")


def _customers(t):
    return t("customer").select("c_custkey", "c_name")


_SIDES = "orders {} JOIN customer ON o_custkey = c_custkey"
_KEYS = [("o_custkey", "c_custkey")]


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM " + _SIDES.format("INNER"))
def join_inner(t):
    return J.join(_orders(t), _customers(t), _KEYS)


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM " + _SIDES.format("LEFT"))
def join_left(t):
    return J.join(_orders(t), _customers(t), _KEYS, "left")


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM " + _SIDES.format("RIGHT"))
def join_right(t):
    return J.join(_orders(t), _customers(t), _KEYS, "right")


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM " + _SIDES.format("FULL"))
def join_full(t):
    return J.join(_orders(t), _customers(t), _KEYS, "full")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def join_left_only(t):
    return J.join(_orders(t), _customers(t), _KEYS, "leftOnly")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_right_only(t):
    return J.join(_orders(t), _customers(t), _KEYS, "rightOnly")


@query("SELECT o_orderkey, o_custkey, c_custkey, c_name FROM " + _SIDES.format("FULL") + " WHERE o_custkey IS NULL OR c_custkey IS NULL")
def join_not_inner(t):
    return J.join(_orders(t), _customers(t), _KEYS, "notInner")


# The same joins over all orders and customers; rows without a match come from keys set to NULL on both sides.
def _all_orders(t):
    return t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("o_key"))


def _all_customers(t):
    return t("customer").select(F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey")).alias("c_key"), "c_name")


_WHOLE_ORDERS = "(SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS o_key FROM orders) o"
_WHOLE_CUSTOMERS = "(SELECT CASE WHEN c_custkey % 5 <> 0 THEN c_custkey END AS c_key, c_name FROM customer) c"
_WHOLE = "SELECT o_orderkey, o_key, c_key, c_name FROM " + _WHOLE_ORDERS + " {} JOIN " + _WHOLE_CUSTOMERS + " ON o_key = c_key"
_WHOLE_KEYS = [("o_key", "c_key")]


@query(_WHOLE.format("INNER"))
def join_inner_whole(t):
    return J.join(_all_orders(t), _all_customers(t), _WHOLE_KEYS)


@query(_WHOLE.format("LEFT"))
def join_left_whole(t):
    return J.join(_all_orders(t), _all_customers(t), _WHOLE_KEYS, "left")


@query(_WHOLE.format("RIGHT"))
def join_right_whole(t):
    return J.join(_all_orders(t), _all_customers(t), _WHOLE_KEYS, "right")


@query(_WHOLE.format("FULL"))
def join_full_whole(t):
    return J.join(_all_orders(t), _all_customers(t), _WHOLE_KEYS, "full")


@query("SELECT o_orderkey, o_key FROM " + _WHOLE_ORDERS + " WHERE NOT EXISTS (SELECT 1 FROM " + _WHOLE_CUSTOMERS + " WHERE c_key = o_key)")
def join_left_only_whole(t):
    return J.join(_all_orders(t), _all_customers(t), _WHOLE_KEYS, "leftOnly")


@query("SELECT c_key, c_name FROM " + _WHOLE_CUSTOMERS + " WHERE NOT EXISTS (SELECT 1 FROM " + _WHOLE_ORDERS + " WHERE c_key = o_key)")
def join_right_only_whole(t):
    return J.join(_all_orders(t), _all_customers(t), _WHOLE_KEYS, "rightOnly")


@query(_WHOLE.format("FULL") + " WHERE o_key IS NULL OR c_key IS NULL")
def join_not_inner_whole(t):
    return J.join(_all_orders(t), _all_customers(t), _WHOLE_KEYS, "notInner")


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return J.cross(t("nation").select("n_name"), t("region").select("r_name"))


@query("""SELECT a.l_orderkey, a.l_linenumber, b.l_orderkey AS k2, b.l_linenumber AS n2, b.l_tax FROM lineitem a JOIN lineitem b
ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""")
def join_multikey(t):
    a = t("lineitem").select("l_orderkey", "l_linenumber")
    b = t("lineitem").select(F.col("l_orderkey").alias("k2"), F.col("l_linenumber").alias("n2"), "l_tax")
    return J.join(a, b, [("l_orderkey", "k2"), ("l_linenumber", "n2")])


@query("""WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END AS k FROM customer),
y AS (SELECT n_name, CASE WHEN n_nationkey % 3 <> 0 THEN n_nationkey END AS k2 FROM nation)
SELECT c_custkey, k, n_name, k2 FROM x JOIN y ON k IS NOT DISTINCT FROM k2""")
def join_nulls_match(t):
    x = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("k"))
    y = t("nation").select("n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("k2"))
    return J.join(x, y, [("k", "k2")], nulls_match=True)


@query("""SELECT l_orderkey, l_linenumber, band FROM lineitem JOIN (SELECT i AS band, i * 7.5 AS low, i * 7.5 + 10 AS high FROM range(7) r(i)) b
ON l_quantity >= low AND l_quantity < high""")
def join_range(t):
    bands = t.spark.range(7).select(F.col("id").alias("band"), (F.col("id") * 7.5).alias("low"), (F.col("id") * 7.5 + 10).alias("high"))
    return J.range_join(t("lineitem"), bands, "l_quantity", "low", "high", 5.0).select("l_orderkey", "l_linenumber", "band")


@query("""SELECT l_orderkey, l_linenumber, band FROM lineitem JOIN (SELECT i AS band, i * 7.5 AS low, i * 7.5 + 10 AS high FROM range(7) r(i)) b
ON l_quantity >= low AND l_quantity < high""")
def join_range_whole(t):
    bands = t.spark.range(7).select(F.col("id").alias("band"), (F.col("id") * 7.5).alias("low"), (F.col("id") * 7.5 + 10).alias("high"))
    return J.range_join(t("lineitem"), bands, "l_quantity", "low", "high", 5.0).select("l_orderkey", "l_linenumber", "band")


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events
WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_as_of(t):
    seen = t("events").where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("last_purchase"))
    return J.as_of(t("events").select("event_id", "user_id", "ts"), seen, "user_id", "ts", "at", ["last_purchase"]).select("event_id", "last_purchase")


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events
WHERE event_type = 'purchase' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_as_of_by_day(t):
    """The same, spread over the days of each key."""
    seen = t("events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("last_purchase"))
    df = J.as_of(t("events").select("event_id", "user_id", "ts"), seen, "user_id", "ts", "at", ["last_purchase"], lambda at: F.date_trunc("day", at))
    return df.select("event_id", "last_purchase")


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_related(t):
    df = J.related(t("supplier"), t("nation"), [("s_nationkey", "n_nationkey")], ["n_name", "n_regionkey"])
    return J.related(df, t("region"), [("n_regionkey", "r_regionkey")], ["r_name"]).select("s_suppkey", "n_name", "r_name")


@query("""SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def join_lookup(t):
    return J.lookup(t("orders").select("o_orderkey", "o_custkey"), t("customer"), [("o_custkey", "c_custkey")], "c_mktsegment").select("o_orderkey", "c_mktsegment")


@query("""SELECT n_nationkey, v.c_mktsegment FROM nation LEFT JOIN (SELECT c_nationkey, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END AS c_mktsegment
FROM (SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 OR c_mktsegment = 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer) GROUP BY 1) v ON n_nationkey = c_nationkey""")
def join_lookup_whole(t):
    segment = F.when((F.col("c_nationkey") % 2 == 0) | (F.col("c_mktsegment") == "BUILDING"), F.col("c_mktsegment"))
    return J.lookup(t("nation").select("n_nationkey"), t("customer").select("c_nationkey", segment.alias("c_mktsegment")), [("n_nationkey", "c_nationkey")], "c_mktsegment")


@query("""SELECT n_nationkey, n_name, balance, customers FROM nation LEFT JOIN (SELECT c_nationkey, round(sum(c_acctbal), 2) AS balance, count(*) AS customers
FROM customer GROUP BY 1) ON n_nationkey = c_nationkey""")
def join_blend(t):
    measures = {"balance": F.round(F.sum("c_acctbal"), 2), "customers": F.count("*")}
    return J.blend(t("nation").select("n_nationkey", "n_name"), t("customer"), [("n_nationkey", "c_nationkey")], measures)


@query("SELECT DISTINCT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_orphans(t):
    return J.orphans(t("customer"), t("orders"), "c_custkey", "o_custkey")


@query("SELECT max(n) <= 1 AS is_unique, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)")
def join_key_is_unique(t):
    return J.is_unique(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("""SELECT l_shipmode_like AS kind, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_quantity) AS lo, max(l_quantity) AS hi, count(l_quantity) AS n,
count(DISTINCT l_suppkey) AS d, round(median(l_extendedprice), 4) AS med, round(stddev_samp(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp,
round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, count(*) AS r FROM (SELECT *, l_returnflag AS l_shipmode_like FROM lineitem) GROUP BY 1""")
def agg_all_functions(t):
    q = "l_quantity"
    df = t("lineitem").withColumn("kind", F.col("l_returnflag"))
    out = A.group(df, ["kind"], [(q, "SUM", "s"), (q, "AVG", "a"), (q, "MIN", "lo"), (q, "MAX", "hi"), (q, "COUNT", "n"), ("l_suppkey", "COUNTD", "d"), ("l_extendedprice", "MEDIAN", "med"),
                                 (q, "STDEV", "sd"), (q, "STDEVP", "sdp"), (q, "VAR", "v"), (q, "VARP", "vp"), ("*", "COUNT", "r")])
    return out.withColumns({c: F.round(c, 2 if c == "s" else 4) for c in ("s", "a", "med", "sd", "sdp", "v", "vp")})


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90,
round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cs, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY 1""")
def agg_percentile_corr_covar(t):
    p = F.col("l_extendedprice")
    others = t("lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", p), 6).alias("r"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cs"), F.round(F.covar_pop("l_quantity", "l_discount"), 6).alias("cp"),
    )
    shares = percentiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", {"p25": 0.25, "p90": 0.9})
    return beside(others, shares, ["l_returnflag"]).withColumns({c: F.round(c, 4) for c in ("p25", "p90")})


@query("""SELECT l_orderkey, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS flag FROM lineitem GROUP BY 1""")
def agg_attr(t):
    return t("lineitem").groupBy("l_orderkey").agg(A.attr(F.col("l_returnflag")).alias("flag"))


@query("""SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS finished, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open,
count(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_custkey END) AS pending_customers, 1 AS present FROM orders GROUP BY 1""")
def agg_conditional(t):
    s = F.col("o_orderstatus")
    return t("orders").groupBy("o_orderpriority").agg(
        F.round(A.sum_if(s == "F", F.col("o_totalprice")), 2).alias("finished"), A.count_if(s == "O").alias("open"),
        A.countd_if(s == "P", F.col("o_custkey")).alias("pending_customers"), A.present().alias("present"),
    )


@query("""SELECT l_suppkey, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS share,
sum(l_tax) / nullif(sum(l_tax) - sum(l_tax), 0) AS undefined FROM lineitem GROUP BY 1""")
def agg_ratio(t):
    price, tax = F.col("l_extendedprice"), F.sum("l_tax")
    return t("lineitem").groupBy("l_suppkey").agg(F.round(A.ratio(F.sum(price * F.col("l_discount")), F.sum(price)), 6).alias("share"), A.ratio(tax, tax - tax).alias("undefined"))


_TOTALS = """SELECT r_name, n_name, CAST(grouping(r_name) + grouping(n_name) AS INT) AS level, round(sum(c_acctbal), 2) AS balance, round(avg(c_acctbal), 4) AS mean FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY {}"""


def _located(t):
    df = J.related(t("customer"), t("nation"), [("c_nationkey", "n_nationkey")], ["n_name", "n_regionkey"])
    return J.related(df, t("region"), [("n_regionkey", "r_regionkey")], ["r_name"])


@query(_TOTALS.format("ROLLUP (r_name, n_name)"))
def agg_subtotals(t):
    return A.totals(_located(t), ["r_name", "n_name"], {"balance": F.round(F.sum("c_acctbal"), 2), "mean": F.round(F.avg("c_acctbal"), 4)})


@query(_TOTALS.format("GROUPING SETS ((r_name, n_name), ())"))
def agg_grand_total(t):
    return A.totals(_located(t), ["r_name", "n_name"], {"balance": F.round(F.sum("c_acctbal"), 2), "mean": F.round(F.avg("c_acctbal"), 4)}, grand_only=True)


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS y, CAST(quarter(o_orderdate) AS BIGINT) AS q, CAST(month(o_orderdate) AS BIGINT) AS m,
count(*) AS n FROM orders GROUP BY ROLLUP (1, 2, 3)""")
def agg_date_hierarchy(t):
    d = F.col("o_orderdate")
    return t("orders").select(F.year(d).cast("bigint").alias("y"), F.quarter(d).cast("bigint").alias("q"), F.month(d).cast("bigint").alias("m")).rollup("y", "q", "m").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS customer_total FROM orders")
def lod_fixed(t):
    return A.fixed(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], F.round(F.sum("o_totalprice"), 2), "customer_total").drop("o_totalprice")


@query("SELECT o_orderkey, round((SELECT avg(o_totalprice) FROM orders), 4) AS overall FROM orders")
def lod_fixed_table(t):
    return A.fixed(t("orders").select("o_orderkey", "o_totalprice"), [], F.round(F.avg("o_totalprice"), 4), "overall").drop("o_totalprice")


@query("""SELECT o_orderpriority, round(avg(v), 4) AS mean_customer_total FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders)
JOIN (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1) USING (o_custkey) GROUP BY 1""")
def lod_fixed_then_average(t):
    df = A.fixed_then(t("orders"), ["o_orderpriority"], ["o_custkey"], F.sum("o_totalprice"), F.avg, "mean_customer_total")
    return df.withColumn("mean_customer_total", F.round("mean_customer_total", 4))


@query("""SELECT l_suppkey, round(l_tax_sum / nullif(l_price_sum, 0), 8) AS tax_share, count(*) AS n FROM lineitem
JOIN (SELECT l_suppkey, sum(l_tax) AS l_tax_sum, sum(l_extendedprice) AS l_price_sum FROM lineitem GROUP BY 1) USING (l_suppkey) GROUP BY 1, 2""")
def lod_fixed_ratio_dimension(t):
    df = A.fixed(t("lineitem"), ["l_suppkey"], F.round(A.ratio(F.sum("l_tax"), F.sum("l_extendedprice")), 8), "tax_share")
    return df.groupBy("l_suppkey", "tax_share").agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(max(v), 2) AS best FROM (SELECT o_orderpriority, o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY 1")
def lod_include(t):
    df = A.include(t("orders"), ["o_orderpriority"], ["o_custkey"], F.sum("o_totalprice"), F.max, "best")
    return df.withColumn("best", F.round("best", 2))


@query("""SELECT l_returnflag, l_linestatus, n, flag_n FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
JOIN (SELECT l_returnflag, count(*) AS flag_n FROM lineitem GROUP BY 1) USING (l_returnflag)""")
def lod_exclude(t):
    return A.exclude(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_linestatus"], F.count("*"), {"n": F.count("*")}, "flag_n")


@query("""SELECT r_name, round(avg(m), 4) AS mean_best FROM (SELECT r_name, n_name, max(v) AS m FROM (SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) AS v FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""")
def lod_nested(t):
    inner = _located(t).groupBy("r_name", "n_name", "c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    df = A.include(inner, ["r_name"], ["n_name"], F.max("v"), F.avg, "mean_best")
    return df.withColumn("mean_best", F.round("mean_best", 4))
