"""Queries of forecasts with intervals, reference bands, the clock and geometry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import scalar as S
from ..operators import analytics as N
from .catalogue import query

_MONTHLY = """m AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY mon) AS i, count(*) OVER (PARTITION BY p) AS n FROM (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS mon, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)),
f AS (SELECT p, avg(v) FILTER (i <= 12) AS l, (avg(v) FILTER (i > 12 AND i <= 24) - avg(v) FILTER (i <= 12)) / 12 AS b, list(v ORDER BY i) FILTER (i <= 12) AS s, max(n) AS n FROM m GROUP BY p)"""


def _monthly(t):
    return t("orders").groupBy(F.col("o_orderpriority").alias("p"), F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("mon")).agg(F.count("*").alias("v"))


@query(f"""WITH RECURSIVE {_MONTHLY}, h AS (SELECT p, CAST(12 AS BIGINT) AS i, l, b, list_transform(s, lambda x: x - l) AS s, 0.0::DOUBLE AS e, n FROM f
UNION ALL SELECT p, i + 1, l2, 0.1 * (l2 - l) + 0.9 * b, list_concat(s[2:], [0.3 * (v - l2) + 0.7 * s[1]]), e + (v - l - b - s[1]) * (v - l - b - s[1]), n
FROM (SELECT h.p, h.i, h.l, h.b, h.s, h.e, h.n, m.v, 0.4 * (m.v - h.s[1]) + 0.6 * (h.l + h.b) AS l2 FROM h JOIN m ON m.p = h.p AND m.i = h.i + 1)),
w AS (SELECT k, 1 + sum(CASE WHEN k > 1 THEN pow(0.4 * (1 + (k - 1) * 0.1) + CASE WHEN (k - 1) % 12 = 0 THEN 0.18 ELSE 0 END, 2) ELSE 0 END) OVER (ORDER BY k) AS q FROM range(1, 15) r(k))
SELECT p, CAST(k AS INT) AS step, round(l + k * b + s[(k - 1) % 12 + 1], 6) AS forecast, round(l + k * b + s[(k - 1) % 12 + 1] - 1.96 * sqrt(e / (n - 12)) * sqrt(q), 6) AS low,
round(l + k * b + s[(k - 1) % 12 + 1] + 1.96 * sqrt(e / (n - 12)) * sqrt(q), 6) AS high FROM h, w WHERE i = n""")
def analytics_seasonal_forecast(t):
    """Fourteen months after each series, with its season and the interval, by given parameters."""
    df = N.seasonal_forecast(_monthly(t), ["p"], "mon", "v", 14, 12, (0.4, 0.1, 0.3))
    return df.withColumns({c: F.round(c, 6) for c in ("forecast", "low", "high")})


@query()
def analytics_fitted_forecast(t):
    """The same with parameters fitted to each series."""
    return N.seasonal_forecast(_monthly(t), ["p"], "mon", "v", 14, 12)


@query("""WITH c AS (SELECT l_returnflag AS r, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC, l_quantity) AS k FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, max(c.q) AS mode, 30.0::DOUBLE AS target, round(quantile_cont(l_quantity, 0.9), 6) AS p90,
round(quantile_cont(l_quantity, 0.2), 6) AS first_fifth, round(avg(l_quantity) - stddev_samp(l_quantity), 6) AS below, round(avg(l_quantity) + stddev_samp(l_quantity), 6) AS above
FROM lineitem JOIN c ON c.r = l_returnflag AND c.k = 1 GROUP BY 1""")
def analytics_reference_set(t):
    wanted = {"mean": "mean", "median": "median", "mode": "mode", "target": ("constant", 30.0), "p90": ("percentile", 0.9), "first_fifth": ("quantile", 1, 5), "below": ("deviations", -1), "above": ("deviations", 1)}
    df = N.reference_set(t("lineitem"), "l_quantity", wanted, ["l_returnflag"])
    return df.withColumns({c: F.round(c, 6) for c in wanted if c not in ("mode", "target")})


@query("""SELECT o_orderstatus, CAST((o_totalprice >= a)::INT + (o_totalprice >= b)::INT + (o_totalprice >= 400000.0)::INT AS INT) AS band, count(*) AS n FROM orders
JOIN (SELECT o_orderstatus AS s, quantile_cont(o_totalprice, 0.25) AS a, avg(o_totalprice) AS b FROM orders GROUP BY 1) ON s = o_orderstatus GROUP BY 1, 2""")
def analytics_bands(t):
    df = N.banded(t("orders"), "o_totalprice", [("percentile", 0.25), "mean", ("constant", 400000.0)], ["o_orderstatus"])
    return df.groupBy("o_orderstatus", "band").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, DATE '1999-06-15' AS today, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-06-15') AS age, o_orderdate <= TIMESTAMP '1999-06-15 13:30:00' AS past FROM orders""")
def scalar_clock(t):
    """TODAY and NOW with a clock that stands still."""
    clock = dt.datetime(1999, 6, 15, 13, 30)
    today, day = S.today(clock), F.col("o_orderdate").cast("date")
    return t("orders").select("o_orderkey", today.alias("today"), F.date_diff(today, day).cast("bigint").alias("age"), (F.col("o_orderdate").cast("timestamp") <= S.now(clock)).alias("past"))


@query("""SELECT n_nationkey, c_custkey FROM (SELECT n_nationkey, n_nationkey * 3 + 10.25 AS cx, n_nationkey % 5 * 20 + 10.25 AS cy, 8.0 + n_nationkey % 7 AS r FROM nation)
JOIN (SELECT c_custkey, c_acctbal / 100 AS x, c_custkey % 97 AS y FROM customer) ON abs(x - cx) + abs(y - cy) < r""")
def geo_inside(t):
    """Customers as points, and a diamond for each nation, without those on its sides."""
    key = F.col("n_nationkey")
    x, y, r = key * 3 + 10.25, key % 5 * 20 + 10.25, 8.0 + key % 7
    corners = [(x - r, y), (x, y + r), (x + r, y), (x, y - r)]
    rings = t("nation").select("n_nationkey", G.make_line(*[G.make_point(a, b) for a, b in corners]).alias("ring"))
    points = t("customer").select("c_custkey", G.make_point(F.col("c_acctbal") / 100, F.col("c_custkey") % 97).alias("at"))
    return G.join_inside(points, rings, "at", "ring", 10.0, edges=False).select("n_nationkey", "c_custkey")


@query("""WITH p AS (SELECT *, c_acctbal / 100 AS x, CAST(c_custkey % 97 AS DOUBLE) AS y FROM customer), s AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2,
lead(x) OVER w IS NOT NULL AS open FROM p WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT c_nationkey, count(*)::INT AS points, round(abs(sum(x * y2 - x2 * y)) / 2, 4) AS area, round(sum(CASE WHEN open THEN sqrt((x - x2) * (x - x2) + (y - y2) * (y - y2)) ELSE 0 END), 4) AS length FROM s GROUP BY 1""")
def geo_collected(t):
    """Each nation's customers as one line, and as a ring."""
    point = G.make_point(F.col("c_acctbal") / 100, F.col("c_custkey") % 97)
    df = t("customer").groupBy("c_nationkey").agg(G.collect(point, F.col("c_custkey")).alias("line"))
    return df.select("c_nationkey", F.size("line").alias("points"), F.round(G.area(F.col("line")), 4).alias("area"), F.round(G.line_length(F.col("line")), 4).alias("length"))
