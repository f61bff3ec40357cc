"""Queries of joins beyond one equality, and of mergeable sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar as L
from ..operators import sketches as K
from ..shared import materialised
from .catalogue import query


@query("SELECT c_mktsegment, count(*) AS n, count(DISTINCT s_suppkey) AS suppliers FROM customer JOIN supplier ON c_nationkey = s_nationkey OR c_custkey = s_suppkey GROUP BY 1")
def join_or(t):
    """Of the pairs only numbers are asked for, so they are counted and not made."""
    return L.counted_any(t("customer"), t("supplier"), [[("c_nationkey", "s_nationkey")], [("c_custkey", "s_suppkey")]], ["c_mktsegment"], "n", {"suppliers": "s_suppkey"})


@query("SELECT c_custkey, s_suppkey FROM (SELECT *, nullif(c_nationkey, 3) AS a FROM customer) LEFT JOIN (SELECT *, CASE WHEN s_nationkey < 2 THEN s_nationkey END AS b FROM supplier) ON a = b OR c_custkey = s_suppkey")
def join_or_left(t):
    customers = t("customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("a"))
    suppliers = t("supplier").select("s_suppkey", F.when(F.col("s_nationkey") < 2, F.col("s_nationkey")).alias("b"))
    return L.join_any(customers, suppliers, [[("a", "b")], [("c_custkey", "s_suppkey")]], "left").select("c_custkey", "s_suppkey")


_CAMPAIGNS = """(SELECT *, TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey % 1500 AS INT)) AS s_from, TIMESTAMP '1995-01-01' + to_days(CAST(s_suppkey % 1500 + s_suppkey % 20 AS INT)) AS s_to FROM supplier)"""


@query(f"""SELECT s_suppkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, o_orderdate + to_days(CAST(o_orderkey % 5 + 1 AS INT)) AS o_end FROM orders) JOIN {_CAMPAIGNS}
ON o_orderdate < s_to AND s_from < o_end AND s_from < s_to GROUP BY 1""")
def join_overlap(t):
    """Orders that are open for some days, and campaigns of a few weeks; one of no days overlaps nothing."""
    after = lambda c, days: c + F.make_dt_interval(days.cast("int"))
    orders = t("orders").withColumn("o_end", after(F.col("o_orderdate"), F.col("o_orderkey") % 5 + 1))
    begin, key = F.lit("1995-01-01").cast("timestamp_ntz"), F.col("s_suppkey")
    suppliers = t("supplier").withColumns({"s_from": after(begin, key % 1500), "s_to": after(begin, key % 1500 + key % 20)})
    pairs = L.join_overlap(orders, suppliers, ("o_orderdate", "o_end"), ("s_from", "s_to"), 7 * 86400)
    return pairs.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH v AS (SELECT DISTINCT p_name || ' ' || p_type AS s FROM part), g AS (SELECT s, list_distinct(list_transform(range(1, length(s)), lambda i: substr(lower(s), i, 2))) AS x FROM v),
j AS (SELECT a.s AS name, b.s AS other, len(list_intersect(a.x, b.x)) AS i, len(a.x) AS p, len(b.x) AS q FROM g a, g b)
SELECT name, other, round(i / (p + q - i), 9) AS similarity FROM j WHERE i / (p + q - i) >= 0.6 AND name < other""")
def join_similar(t):
    names = t("part").select(F.concat("p_name", F.lit(" "), "p_type").alias("name"))
    return L.similar_values(names, names.withColumnRenamed("name", "other"), "name", "other", 0.6).where("name < other").withColumn("similarity", F.round("similarity", 9))


_SKETCHED = {"customers": ("distinct", "o_custkey"), "price": ("quantiles", "o_totalprice"), "n": ("count", "o_totalprice"), "total": ("sum", "o_totalprice")}


def _by_year(t):
    """Kept by day and priority, rolled up to months and from there to years."""
    daily = materialised(K.pre_aggregated(t("orders"), [F.to_date("o_orderdate").alias("day"), "o_orderpriority"], _SKETCHED))
    monthly = K.rolled_up(daily, [F.date_trunc("month", "day").alias("month")], _SKETCHED)
    return K.rolled_up(monthly, [F.year("month").alias("y")], _SKETCHED)


def _against_rows(t):
    found = _by_year(t).select("y", "n", "total", K.distinct_estimate("customers").alias("estimate"), K.quantile_estimate("price", 0.5).alias("median"))
    exact = t("orders").withColumn("y", F.year("o_orderdate")).join(found.select(F.col("y").alias("_y"), "median"), F.col("y") == F.col("_y"))
    exact = exact.groupBy("y").agg(F.count_distinct("o_custkey").alias("customers"), F.avg((F.col("o_totalprice") <= F.col("median")).cast("double")).alias("median_rank"))
    return found.join(exact, "y")


@query("""SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_custkey) AS customers, true AS customers_near, true AS median_near FROM orders GROUP BY 1""")
def agg_rolled_sketches(t):
    """Sketches rolled up from days to years: the distinct count comes within a twentieth, the median's rank within three per cent of all rows."""
    df = _against_rows(t)
    near = F.abs(F.col("estimate") - F.col("customers")) <= 0.05 * F.col("customers")
    return df.select("y", "n", F.round("total", 2).alias("total"), "customers", near.alias("customers_near"), (F.abs(F.col("median_rank") - 0.5) <= 0.03).alias("median_near"))


@query()
def agg_sketch_errors(t):
    """The estimates themselves, and how far they are off."""
    df = _against_rows(t)
    return df.select("y", "customers", "estimate", (F.abs(F.col("estimate") - F.col("customers")) / F.col("customers")).alias("error"), "median", (F.col("median_rank") - 0.5).alias("rank_error"))
