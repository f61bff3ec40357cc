"""Queries of the business measures and of what else the model offers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import joins as J
from ..operators import kpi
from ..streaming import incremental
from .catalogue import query


@query("""SELECT l_returnflag, round(sum(l_extendedprice) / count(*), 4) AS revenue_per_transaction, round(sum(l_quantity) / count(DISTINCT l_orderkey), 4) AS items_per_basket,
round(count(DISTINCT l_orderkey) / sum(l_quantity), 6) AS conversion_rate, round(sum(l_extendedprice) / avg(l_quantity), 2) AS inventory_turnover, round(sum(l_quantity) / sum(l_quantity + 5), 6) AS sell_through_rate,
round(sum(l_extendedprice) / count(DISTINCT l_suppkey), 2) AS customer_lifetime_value FROM lineitem GROUP BY 1""")
def kpi_retail(t):
    price, quantity = F.col("l_extendedprice"), F.col("l_quantity")
    over = {
        "revenue_per_transaction": (4, price), "items_per_basket": (4, quantity, F.col("l_orderkey")), "conversion_rate": (6, F.col("l_orderkey"), quantity), "inventory_turnover": (2, price, quantity),
        "sell_through_rate": (6, quantity, quantity + 5), "customer_lifetime_value": (2, price, F.col("l_suppkey")),
    }
    return t("lineitem").groupBy("l_returnflag").agg(*[F.round(kpi.RETAIL[n](*c), places).alias(n) for n, (places, *c) in over.items()])


@query("""SELECT l_linestatus, round(sum(l_extendedprice) - sum(l_extendedprice * l_discount), 2) AS net_revenue, round((sum(l_extendedprice) - sum(l_extendedprice * l_tax)) / sum(l_extendedprice), 6) AS gross_margin,
round(sum(l_tax) / sum(l_extendedprice), 9) AS operating_expense_ratio, round(sum(l_quantity) - sum(l_linenumber), 2) AS budget_variance, round((sum(l_quantity) - sum(l_linenumber)) / sum(l_linenumber), 6) AS budget_variance_share,
round(sum(l_quantity) / (sum(l_extendedprice) / 365), 6) AS days_sales_outstanding FROM lineitem GROUP BY 1""")
def kpi_finance(t):
    price, quantity, line = F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_linenumber")
    over = {
        "net_revenue": (2, price, price * F.col("l_discount")), "gross_margin": (6, price, price * F.col("l_tax")), "operating_expense_ratio": (9, F.col("l_tax"), price), "budget_variance": (2, quantity, line),
        "budget_variance_share": (6, quantity, line), "days_sales_outstanding": (6, quantity, price),
    }
    return t("lineitem").groupBy("l_linestatus").agg(*[F.round(kpi.FINANCE[n](*c), places).alias(n) for n, (places, *c) in over.items()])


@query("""SELECT event_type, round(sum(value) / count(*), 6) AS average_length_of_stay, round(count(CASE WHEN user_id % 7 = 0 THEN 1 END) / count(*), 6) AS readmission_rate, round(sum(value) / sum(value + 1), 6) AS bed_occupancy_rate,
round(avg(value), 6) AS satisfaction_score, round(count(CASE WHEN user_id % 11 = 0 THEN 1 END) / count(*), 6) AS mortality_rate, round(avg(value), 6) AS emergency_wait FROM events GROUP BY 1""")
def kpi_health(t):
    v, status = F.col("value"), F.when(F.col("user_id") % 11 == 0, "Expired").otherwise("Home")
    over = {
        "average_length_of_stay": (v,), "readmission_rate": (F.col("user_id") % 7 == 0,), "bed_occupancy_rate": (v, v + 1), "satisfaction_score": (v,), "mortality_rate": (status,), "emergency_wait": (v,),
    }
    return t("events").groupBy("event_type").agg(*[F.round(kpi.HEALTH[n](*c), 6).alias(n) for n, c in over.items()])


@query("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT a.month, round(a.v, 2) AS revenue, round(sum(a.v) OVER (PARTITION BY year(a.month) ORDER BY a.month), 2) AS revenue_ytd, round(b.v, 2) AS revenue_prior_year, round((a.v - b.v) / b.v, 6) AS sales_growth
FROM m a LEFT JOIN m b ON b.month = a.month - INTERVAL 1 YEAR""")
def kpi_revenue_over_time(t):
    df = kpi.revenue_over_time(t("orders"), F.col("o_orderdate"), F.col("o_totalprice"))
    return df.withColumns({"revenue": F.round("revenue", 2), "revenue_ytd": F.round("revenue_ytd", 2), "revenue_prior_year": F.round("revenue_prior_year", 2), "sales_growth": F.round("sales_growth", 6)})


@query("""SELECT c_mktsegment, o_orderpriority, CAST(year(o_orderdate) AS INT) AS y, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""")
def agg_pre_aggregated(t):
    """Aggregates by the join's key first, so that the dimension meets one row for each key and not one for each fact."""
    facts = t("orders").groupBy("o_custkey", "o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("s"))
    df = J.related(facts, t("customer"), [("o_custkey", "c_custkey")], ["c_mktsegment"]).where("c_mktsegment is not null")
    return df.groupBy("c_mktsegment", "o_orderpriority", "y").agg(F.round(F.sum("s"), 2).alias("total"))


@query("SELECT CAST(substr(o_orderpriority, 1, 1) AS INT) AS k, count(*) AS n FROM orders JOIN region ON CAST(substr(o_orderpriority, 1, 1) AS INT) = r_regionkey GROUP BY 1")
def join_on_calculation(t):
    df = t("orders").withColumn("k", F.substring("o_orderpriority", 1, 1).cast("int"))
    return J.join(df, t("region"), [("k", "r_regionkey")]).groupBy("k").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND (l_shipdate > o_orderdate + INTERVAL 100 DAY OR l_quantity > 49)""")
def join_equality_and_condition(t):
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.make_dt_interval(F.lit(100))
    df = J.join(t("orders"), t("lineitem"), [("o_orderkey", "l_orderkey")])
    return df.where(late | (F.col("l_quantity") > 49)).select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-30' AND o_orderdate < TIMESTAMP '1998-08-02'""")
def stream_refresh_range(t):
    r = incremental.refresh_range(F.lit(dt.datetime(1998, 8, 1)))
    return t("orders").where((F.col("o_orderdate") >= r["refresh_from"]) & (F.col("o_orderdate") < r["end"])).select("o_orderkey")


@query("""SELECT user_id, min(ts) AS session_start, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def stream_sessions(t):
    df = t("events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return df.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1""")
def stream_tumbling(t):
    df = incremental.windowed(t("events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "30 minutes", [], {"n": F.count("*")})
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1""")
def stream_latest(t):
    last = t("events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("last"))
    return last.select("user_id", "last.event_type", "last.value")


@query("SELECT l_shipmonth AS m, l_returnflag, n FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_shipmonth, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n > 10")
def filter_after_aggregate(t):
    df = t("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("m"), "l_returnflag").agg(F.count("*").alias("n"))
    return df.where("n > 10")


@query("""SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= 3""")
def order_top_in_group(t):
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t("customer").withColumn("i", F.row_number().over(w)).where("i <= 3").select("c_mktsegment", "c_custkey", "c_acctbal")


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def clean_json_property(t):
    from ..operators.cleaning import json_field

    return t("events").select("event_id", json_field(F.col("props"), "$.k").alias("k"))
