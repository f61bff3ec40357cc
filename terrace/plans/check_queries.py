"""Queries of relationship and quality checks, forecasts, and the scalar and script functions beyond the common ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import scripts
from ..operators import aggregates as A
from ..operators import analytics as N
from ..operators import joins as J
from ..operators import model as M
from ..operators import quality as Q
from ..shared import new_folder
from ..streaming import capture, incremental
from .catalogue import query


@query("""SELECT 'orders' AS child, 'o_custkey' AS child_column, 'customer' AS parent, 'c_custkey' AS parent_column, avg(CASE WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN 1.0 ELSE 0.0 END) AS share FROM orders
UNION ALL SELECT 'customer', 'c_nationkey', 'nation', 'n_nationkey', avg(CASE WHEN c_nationkey IN (SELECT n_nationkey FROM nation) THEN 1.0 ELSE 0.0 END) FROM customer
UNION ALL SELECT 'nation', 'n_regionkey', 'region', 'r_regionkey', avg(CASE WHEN n_regionkey IN (SELECT r_regionkey FROM region) THEN 1.0 ELSE 0.0 END) FROM nation""")
def join_inferred(t):
    return J.inferred({n: t(n) for n in ("orders", "customer", "nation", "region")}).drop("score")


@query("""SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def join_aligned_types(t):
    df = t("orders").select(F.col("o_custkey").cast("string").alias("k"))
    return J.aligned_join(df, t("customer"), [("k", "c_custkey")]).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT 'o_custkey' AS column_name, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_distinct, count(DISTINCT o_custkey) / count(*) AS ratio FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), count(DISTINCT o_orderstatus) / count(*) FROM orders""")
def quality_cardinality(t):
    return Q.cardinality(t("orders"), ["o_custkey", "o_orderstatus"])


@query("""SELECT 'o_custkey' AS column_name, e AS expected, a AS actual, abs(e - a) <= greatest(2.0, 0.02 * e) AS ok FROM (SELECT count(DISTINCT o_custkey) AS e,
count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS a FROM orders) UNION ALL SELECT 'o_orderpriority', e, a, abs(e - a) <= greatest(2.0, 0.02 * e)
FROM (SELECT count(DISTINCT o_orderpriority) AS e, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) AS a FROM orders)""")
def quality_distinct_counts(t):
    return Q.counts_agree(t("orders"), t("orders").where("o_orderstatus = 'F'"), ["o_custkey", "o_orderpriority"])


@query("""SELECT 'added' AS kind, 'area' AS column_name UNION ALL SELECT 'removed', 'n_name' UNION ALL SELECT 'retyped', 'n_regionkey'""")
def quality_schema_drift(t):
    new = t("nation").select(F.col("n_regionkey").cast("string").alias("n_regionkey"), "n_nationkey", F.lit(1.5).alias("area"))
    return Q.drift_table(t("nation").select("n_nationkey", "n_name", "n_regionkey"), new)


@query("""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY mon) AS i FROM (SELECT o_orderpriority AS p, date_trunc('quarter', o_orderdate) AS mon, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1, 2)),
h AS (SELECT p, i, v AS lv, 0.0::DOUBLE AS trend FROM m WHERE i = 1
UNION ALL SELECT m.p, m.i, 0.5 * m.v + 0.5 * (h.lv + h.trend), 0.3 * (0.5 * m.v + 0.5 * (h.lv + h.trend) - h.lv) + 0.7 * h.trend FROM h JOIN m ON m.p = h.p AND m.i = h.i + 1)
SELECT p, CAST(k AS INT) AS step, round(lv + k * trend, 6) AS forecast FROM h JOIN (SELECT p, max(i) AS i FROM m GROUP BY 1) USING (p, i), range(1, 4) r(k)""")
def analytics_forecast(t):
    quarters = t("orders").groupBy(F.col("o_orderpriority").alias("p"), F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).alias("mon")).agg(F.count("*").alias("v"))
    return N.forecast(quarters, ["p"], "mon", "v", 3).withColumn("forecast", F.round("forecast", 6))


@query("""SELECT o_orderkey, make_timestamp(CAST(year(d) AS BIGINT), CAST(month(d) AS BIGINT), 1, 13, 5, 30.0) AS at, '13:05:' || CASE WHEN o_orderkey % 60 < 10 THEN '0' ELSE '' END || CAST(o_orderkey % 60 AS VARCHAR) AS clock,
upper(o_orderpriority) AS up, CAST(length(o_orderstatus) AS INT) AS len FROM (SELECT *, o_orderdate AS d FROM orders)""")
def scalar_make_and_raw(t):
    d, n = F.col("o_orderdate"), F.lit
    at = S.make_datetime(F.year(d), F.month(d), n(1), n(13), n(5), n(30))
    clock = S.make_time(n(13), n(5), F.col("o_orderkey") % 60)
    return t("orders").select("o_orderkey", at.cast("timestamp_ntz").alias("at"), clock.alias("clock"), S.raw_sql("UPPER", F.col("o_orderpriority")).alias("up"), S.raw_sql("length", F.col("o_orderstatus")).alias("len"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: lower(x)), '/') AS words, CAST(len(list_filter(string_split(p_type, ' '), lambda x: contains(x, 'E'))) AS INT) AS with_e FROM part""")
def scalar_arrays(t):
    words = F.split("p_type", " ")
    return t("part").select("p_partkey", F.array_join(F.transform(words, F.lower), "/").alias("words"), F.size(F.filter(words, lambda x: x.contains("E"))).alias("with_e"))


@query("SELECT o_orderkey, o_orderkey * 900719925474 // 1000 AS quotient, o_orderkey * 900719925474 AS whole FROM orders")
def scalar_exact_quotient(t):
    """Whole numbers beyond the exact range of doubles."""
    big = F.col("o_orderkey") * F.lit(900719925474)
    return t("orders").select("o_orderkey", S.div(big, 1000).alias("quotient"), S.to_int(big.cast("string")).alias("whole"))


@query("SELECT o_custkey, round(exp(avg(ln(o_totalprice))), 2) AS geometric_mean FROM orders GROUP BY 1")
def script_aggregate(t):
    import numpy as np

    mean = scripts.script_aggregate("SCRIPT_REAL", lambda v: float(np.exp(np.log(v).mean())), F.col("o_totalprice"))
    return t("orders").groupBy("o_custkey").agg(mean.alias("geometric_mean")).withColumn("geometric_mean", F.round("geometric_mean", 2))


@query("SELECT o_orderstatus, 1 AS present, true AS near FROM orders GROUP BY 1")
def agg_approximate_distinct(t):
    """Whether a sketch of the distinct keys comes within a tenth of their number."""
    exact, sketch = F.count_distinct("o_orderkey"), F.approx_count_distinct("o_orderkey", 0.02)
    return t("orders").groupBy("o_orderstatus").agg(A.present().alias("present"), (F.abs(exact - sketch) <= 0.1 * exact).alias("near"))


@query("SELECT DISTINCT c_mktsegment AS value FROM customer")
def model_database_parameter(t):
    return M.domain(t("customer"), "c_mktsegment")


@query("SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def model_user_attribute(t):
    nations = t("nation").where(F.col("n_regionkey").cast("string") == M.user_attribute({"region": "1"}, "region"))
    return t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1""")
def stream_latest_rows(t):
    """Streamed file by file into a table that keeps each user's last row."""
    spark, folder, at = t.spark, new_folder(t.spark, "events"), new_folder(t.spark, "stream")
    columns = ["user_id", "ts", "event_id", "event_type"]
    df = t("events").select(*columns, F.lit("update").alias("_change"), F.unix_micros(F.col("ts").cast("timestamp")).alias("_version"))
    df.repartition(3).write.parquet(folder)
    kept = capture.KeptTable(spark, new_folder(t.spark, "latest"), df.select(*columns).schema, ["user_id"], buckets=4)
    capture.keep_up(incremental.watch(spark, folder, df.schema, files_each=1), kept, at).awaitTermination()
    return kept.read().select("user_id", "event_id", "event_type")
