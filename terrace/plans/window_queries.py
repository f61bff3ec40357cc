"""Queries of the table-calculation and reshape operators."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import reshape as R
from ..operators import tablecalc as W
from ..operators.spread import running_total
from .catalogue import query

_MONTHS = """WITH m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate) AS mon, round(sum(o_totalprice), 2) AS v, count(*) AS n FROM orders GROUP BY 1, 2) """


def _months(t):
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    return t("orders").groupBy(F.col("o_orderpriority").alias("p"), month.alias("mon")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"), F.count("*").alias("n"))


def _by():
    return Window.partitionBy("p").orderBy("mon")


def _out(df, *columns):
    return df.select("p", F.date_format("mon", "yyyy-MM").alias("month"), *columns)


_KEY = "p, strftime(mon, '%Y-%m') AS month, "


@query(_MONTHS + "SELECT " + _KEY + """round(sum(v) OVER w, 2) AS s, round(avg(v) OVER w, 4) AS a, count(v) OVER w AS c, min(v) OVER w AS lo, max(v) OVER w AS hi
FROM m WINDOW w AS (PARTITION BY p ORDER BY mon ROWS UNBOUNDED PRECEDING)""")
def calc_running(t):
    v = F.col("v")
    return _out(
        _months(t), F.round(W.running(F.sum, v, _by()), 2).alias("s"), F.round(W.running(F.avg, v, _by()), 4).alias("a"), W.running(F.count, v, _by()).alias("c"),
        W.running(F.min, v, _by()).alias("lo"), W.running(F.max, v, _by()).alias("hi"),
    )


@query(_MONTHS + "SELECT " + _KEY + """round(sum(v) OVER w, 2) AS s3, round(avg(v) OVER (PARTITION BY p), 4) AS mean, round(stddev_samp(v) OVER w, 2) AS sd3, round(var_pop(v) OVER w, 0) AS vp3
FROM m WINDOW w AS (PARTITION BY p ORDER BY mon ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def calc_window(t):
    v = F.col("v")
    return _out(_months(t), F.round(W.windowed(F.sum, v, _by(), -2, 0), 2).alias("s3"), F.round(W.windowed(F.avg, v, _by()), 4).alias("mean"),
                F.round(W.windowed(F.stddev_samp, v, _by(), -2, 0), 2).alias("sd3"), F.round(W.windowed(F.var_pop, v, _by(), -2, 0), 0).alias("vp3"))


@query(_MONTHS + "SELECT " + _KEY + """round(median(v) OVER (PARTITION BY p ORDER BY mon ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 2) AS med,
round(quantile_cont(v, 0.8) OVER (PARTITION BY p), 2) AS p80, count(DISTINCT n) OVER (PARTITION BY p) AS dn FROM m""")
def calc_window_median_percentile(t):
    v = F.col("v")
    return _out(_months(t), F.round(W.window_median(v, _by(), -3, 3), 2).alias("med"), F.round(W.window_percentile(v, 0.8, _by()), 2).alias("p80"), W.window_countd(F.col("n"), _by()).cast("bigint").alias("dn"))


@query(_MONTHS + "SELECT " + _KEY + """round(corr(v, n) OVER w, 6) AS r, round(covar_samp(v, n) OVER w, 2) AS cs, round(covar_pop(v, n) OVER w, 2) AS cp FROM m WINDOW w AS (PARTITION BY p)""")
def calc_window_corr(t):
    w = Window.partitionBy("p")
    return _out(_months(t), F.round(F.corr("v", "n").over(w), 6).alias("r"), F.round(F.covar_samp("v", "n").over(w), 2).alias("cs"), F.round(F.covar_pop("v", "n").over(w), 2).alias("cp"))


@query(_MONTHS + "SELECT " + _KEY + """CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS dr, CAST(row_number() OVER (PARTITION BY p ORDER BY n DESC, mon) AS BIGINT) AS ru,
count(*) OVER (PARTITION BY p ORDER BY n DESC RANGE UNBOUNDED PRECEDING) AS rm, round(percent_rank() OVER (PARTITION BY p ORDER BY n), 6) AS rp FROM m WINDOW w AS (PARTITION BY p ORDER BY n DESC)""")
def calc_rank(t):
    w = Window.partitionBy("p").orderBy(F.desc("n"))
    unique = Window.partitionBy("p").orderBy(F.desc("n"), "mon")
    return _out(_months(t), F.rank().over(w).cast("bigint").alias("rk"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.row_number().over(unique).cast("bigint").alias("ru"),
                W.rank_modified(w).alias("rm"), F.round(F.percent_rank().over(Window.partitionBy("p").orderBy("n")), 6).alias("rp"))


@query(_MONTHS + "SELECT " + _KEY + """CAST(row_number() OVER w AS BIGINT) AS idx, CAST(1 - row_number() OVER w AS BIGINT) AS f, CAST(count(*) OVER (PARTITION BY p) - row_number() OVER w AS BIGINT) AS l,
count(*) OVER (PARTITION BY p) AS size, lag(v, 1) OVER w AS before, lead(v, 2) OVER w AS after FROM m WINDOW w AS (PARTITION BY p ORDER BY mon)""")
def calc_positions(t):
    v = F.col("v")
    return _out(_months(t), W.index(_by()).cast("bigint").alias("idx"), W.first(_by()).cast("bigint").alias("f"), W.last(_by()).cast("bigint").alias("l"), W.size(_by()).alias("size"),
                W.lookup(v, -1, _by()).alias("before"), W.lookup(v, 2, _by()).alias("after"))


@query(_MONTHS + "SELECT " + _KEY + """round(v / sum(v) OVER (PARTITION BY p), 8) AS share, round(v - lag(v) OVER w, 2) AS diff, round((v - lag(v) OVER w) / nullif(abs(lag(v) OVER w), 0), 8) AS pct
FROM m WINDOW w AS (PARTITION BY p ORDER BY mon)""")
def calc_quick(t):
    v = F.col("v")
    return _out(_months(t), F.round(W.percent_of_total(v, _by()), 8).alias("share"), F.round(W.difference(v, _by()), 2).alias("diff"), F.round(W.percent_difference(v, _by()), 8).alias("pct"))


@query("""WITH m AS (SELECT o_orderpriority AS p, o_orderstatus AS s, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1, 2)
SELECT p, s, mean, total_mean FROM m JOIN (SELECT o_orderpriority AS p, round(avg(o_totalprice), 4) AS total_mean FROM orders GROUP BY 1) USING (p)""")
def calc_total(t):
    from ..operators import aggregates as A

    df = t("orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("s"), "o_totalprice")
    mean = F.round(F.avg("o_totalprice"), 4)
    return A.exclude(df, ["p", "s"], ["s"], mean, {"mean": mean}, "total_mean")


@query(_MONTHS + """, o AS (SELECT p, mon, n, row_number() OVER (PARTITION BY p ORDER BY mon) AS i FROM m)
SELECT a.p, strftime(a.mon, '%Y-%m') AS month, round(sum(pow(0.5, a.i - b.i + 1) * b.n), 6) AS level FROM o a JOIN o b ON a.p = b.p AND b.i <= a.i GROUP BY 1, 2""")
def calc_previous_value(t):
    df = _out(_months(t), "n")
    return W.previous_value(df, ["p"], ["month"], lambda row, before: 0.5 * row["n"] + 0.5 * before, 0.0, "level").select("p", "month", F.round("level", 6).alias("level"))


@query("""SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS total FROM events""")
def calc_running_events(t):
    """Over rows, not marks: a user may hold any share of them."""
    df = running_total(t("events").select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], F.col("value"), "total")
    return df.select("user_id", "event_id", F.round("total", 4).alias("total"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def order_top(t):
    return R.top(t("orders").select("o_orderkey", "o_totalprice"), R.by([("o_totalprice", True), ("o_orderkey", False)]), 20)


@query("""SELECT n_name, CAST(row_number() OVER (ORDER BY balance DESC, n_name) AS BIGINT) AS place FROM (SELECT n_name, round(sum(c_acctbal), 2) AS balance FROM customer
JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)""")
def order_by_measure(t):
    from ..operators.columns import add_index

    df = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return add_index(df, "place", [F.desc("balance"), F.asc("n_name")]).select("n_name", "place")


@query("""SELECT r_name, CAST(row_number() OVER (ORDER BY CASE r_name WHEN 'EUROPE' THEN 1 WHEN 'ASIA' THEN 2 ELSE 3 END, r_name) AS BIGINT) AS place FROM region""")
def order_manual(t):
    from ..operators.columns import add_index

    return add_index(t("region"), "place", [R.manual_order(F.col("r_name"), ["EUROPE", "ASIA"]), F.col("r_name")]).select("r_name", "place")


@query("SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_name) AS i FROM nation) WHERE i > 5")
def order_skip(t):
    return R.skip(t("nation"), [F.col("n_name")], 5).select("n_nationkey")


@query("SELECT n_nationkey FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) AS i FROM nation) WHERE i > 5")
def order_drop_last(t):
    return R.drop_last(t("nation"), [F.col("n_name")], 5).select("n_nationkey")


@query()
def order_sample(t):
    return R.sample(t("orders"), 0.1, "o_orderkey").select("o_orderkey")


@query("""SELECT c_name AS name, CAST(c_nationkey AS DOUBLE) AS nation, c_mktsegment AS segment, 1 AS source FROM customer
UNION ALL SELECT s_name, s_nationkey + 0.5, NULL, 2 FROM supplier""")
def set_union(t):
    a = t("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select("s_name", (F.col("s_nationkey") + F.lit(0.5).cast("double")).alias("s_nation"))
    return R.union([a, b], [{}, {"s_name": "name", "s_nation": "nation"}], "source")


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders")
def set_distinct(t):
    return R.distinct(t("orders").select("o_orderpriority", "o_orderstatus"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS i FROM orders) WHERE i = 1")
def set_distinct_subset(t):
    return R.distinct(t("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").select("o_custkey"))


@query("SELECT nullif(c_nationkey, 1) AS k FROM customer INTERSECT SELECT CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey END FROM supplier")
def set_intersect_whole(t):
    k = F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey"))
    return t("customer").select(F.nullif("c_nationkey", F.lit(1)).alias("k")).intersect(t("supplier").select(k.alias("k")))


@query("SELECT nullif(c_nationkey, 1) AS k FROM customer EXCEPT SELECT CASE WHEN s_nationkey % 3 <> 0 THEN s_nationkey END FROM supplier")
def set_except_whole(t):
    k = F.when(F.col("s_nationkey") % 3 != 0, F.col("s_nationkey"))
    return t("customer").select(F.nullif("c_nationkey", F.lit(1)).alias("k")).subtract(t("supplier").select(k.alias("k")))


@query("""SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure, unnest([l_quantity, l_discount, nullif(l_tax, 0)]) AS amount
FROM lineitem""")
def reshape_unpivot(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return R.unpivot(df, ["l_quantity", "l_discount", "l_tax"], "measure", "amount")


@query("""SELECT * FROM (SELECT l_orderkey, l_linenumber, unnest(['l_discount', 'l_tax']) AS measure, unnest([l_discount, nullif(l_tax, 0)]) AS amount FROM lineitem) WHERE amount IS NOT NULL""")
def reshape_unpivot_others(t):
    df = t("lineitem").select("l_orderkey", "l_linenumber", "l_discount", F.nullif("l_tax", F.lit(0.0)).alias("l_tax"))
    return R.unpivot_others(df, ["l_orderkey", "l_linenumber"], "measure", "amount", drop_nulls=True)


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linenumber = 1), 2) AS "1", round(sum(l_quantity) FILTER (l_linenumber = 2), 2) AS "2" FROM lineitem GROUP BY 1""")
def reshape_pivot(t):
    return R.pivot(t("lineitem"), ["l_returnflag"], "l_linenumber", [1, 2], F.round(F.sum("l_quantity"), 2))
