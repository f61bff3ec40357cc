"""Queries of ranks, frames and recursions over partitions of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import places as P
from .catalogue import query


@query("""SELECT l_shipdate, l_orderkey, l_linenumber, CAST(rank() OVER d AS BIGINT) AS rk, CAST(dense_rank() OVER d AS BIGINT) AS dr, count(*) OVER (ORDER BY l_shipdate DESC RANGE UNBOUNDED PRECEDING) AS rm, round(percent_rank() OVER d, 9) AS rp,
CAST(row_number() OVER w AS BIGINT) AS i, count(*) OVER () - CAST(row_number() OVER w AS BIGINT) AS to_last, lag(l_orderkey, 3) OVER w AS before, lead(l_shipdate, 1) OVER w AS after FROM lineitem WINDOW d AS (ORDER BY l_shipdate DESC), w AS (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber)""")
def calc_rank_lineitem(t):
    """Over the whole table, which no window lays in one task."""
    wanted = {"rk": "rank", "dr": "dense", "rm": "modified", "rp": "percent", "i": "index", "to_last": "last"}
    df = t("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    df = P.positions(df, [], [("l_shipdate", True)], wanted, ["l_orderkey", "l_linenumber"], [("before", "l_orderkey", -3), ("after", "l_shipdate", 1)])
    return df.withColumn("rp", F.round("rp", 9))


@query("""SELECT user_id, event_id, round(median(value) OVER w, 6) AS med, round(quantile_cont(value, 0.8) OVER w, 6) AS p80, count(DISTINCT event_type) OVER w AS kinds FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 20 PRECEDING AND 5 FOLLOWING)""")
def calc_framed_events(t):
    wanted = {"med": ("percentile", "value", 0.5), "p80": ("percentile", "value", 0.8), "kinds": ("countd", "event_type")}
    df = P.framed(t("events").select("user_id", "ts", "event_id", "value", "event_type"), ["user_id"], [("ts", False), ("event_id", False)], -20, 5, wanted)
    return df.select("user_id", "event_id", F.round("med", 6).alias("med"), F.round("p80", 6).alias("p80"), "kinds")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT a.user_id, a.event_id, round(sum(pow(2.0 / 3.0, a.i - b.i) / 3.0 * b.value), 6) AS level FROM o a JOIN o b ON a.user_id = b.user_id AND b.i <= a.i AND b.i > a.i - 200 GROUP BY 1, 2""")
def calc_previous_events(t):
    """A third of each value and two thirds of the level before it; in SQL the last 200 values, as the others weigh nothing."""
    df = t("events").select("user_id", "ts", "event_id", "value")
    df = P.previous_affine(df, ["user_id"], [("ts", False), ("event_id", False)], F.lit(2 / 3), F.col("value") / 3, 0.0, "level")
    return df.select("user_id", "event_id", F.round("level", 6).alias("level"))
