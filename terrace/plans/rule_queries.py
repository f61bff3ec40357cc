"""Queries of view filters, measures of measures, parameters on data, models on rows and deeper comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import scripts
from ..operators import aggregates as A
from ..operators import analytics as N
from ..operators import filters as P
from ..operators import joins as J
from ..operators import model as M
from ..operators import quality as Q
from ..sources import readers
from .catalogue import query


@query("""SELECT o_orderkey, p FROM (SELECT *, nullif(o_orderpriority, '5-LOW') AS p FROM orders) WHERE (coalesce(p IN ('1-URGENT', '2-HIGH'), false) OR p IS NULL OR o_totalprice BETWEEN 1000 AND 50000)
AND NOT coalesce(o_orderstatus IN ('P'), false)""")
def filter_group(t):
    df = t("orders").withColumn("p", F.nullif("o_orderpriority", F.lit("5-LOW")))
    wanted = ("union", ("members", "p", ["1-URGENT", "2-HIGH", None]), ("range", "o_totalprice", 1000, 50000))
    spec = ("except", ("intersect", ("all",), wanted), ("members", "o_orderstatus", ["P"]))
    return df.where(P.group_filter(spec)).select("o_orderkey", "p")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, CAST(NULL AS INT) AS nation FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, s_nationkey FROM supplier")
def join_blend_unlinked(t):
    a = t("customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t("supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("int").alias("nation"))
    return J.blend(a, b, [], {})


@query("""SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price, round(sum(l_extendedprice) / sum(l_quantity) / count(*) * 100, 6) AS index,
round(sum(l_extendedprice) / sum(l_quantity) / count(*) * 100 - sum(l_quantity) / count(*), 6) AS gap FROM lineitem GROUP BY 1""")
def agg_measure_of_measures(t):
    base = {"n": F.count("*"), "q": F.sum("l_quantity"), "revenue": F.sum("l_extendedprice")}
    derived = {"gap": (["index", "q", "n"], F.col("index") - F.col("q") / F.col("n")), "index": (["price", "n"], F.col("price") / F.col("n") * 100), "price": (["revenue", "q"], A.ratio(F.col("revenue"), F.col("q")))}
    df = A.with_measures(t("lineitem"), ["l_returnflag"], base, derived)
    return df.select("l_returnflag", "n", "q", *[F.round(c, 6).alias(c) for c in ("price", "index", "gap")])


@query("""SELECT o_orderkey, o_orderdate + to_microseconds(129600000000 * (o_orderkey % 3)) AS later, round(date_diff('second', o_orderdate, TIMESTAMP '1999-01-01 06:00:00') / 86400, 6) AS days FROM orders""")
def scalar_date_plus(t):
    """A time and a number of days with a fraction; the difference of two times in days."""
    at, fixed = F.col("o_orderdate"), F.lit("1999-01-01 06:00:00").cast("timestamp_ntz")
    return t("orders").select("o_orderkey", S.date_plus(at, F.col("o_orderkey") % 3 * 1.5).alias("later"), F.round(S.days_between(fixed, at), 6).alias("days"))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice) * 1.25, 2) AS raised FROM orders WHERE o_totalprice >= 150000 AND o_orderpriority = '2-HIGH' GROUP BY 1")
def model_scalar_parameter(t):
    least, rate = M.parameter(150000, "double", low=0, high=1_000_000), M.parameter("1.25", "double", allowed=["1.0", "1.25"])
    priority = M.parameter("2-HIGH", "string", allowed=["1-URGENT", "2-HIGH"])
    df = t("orders").where((F.col("o_totalprice") >= least) & (F.col("o_orderpriority") == priority))
    return df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice") * F.max(rate), 2).alias("raised"))


@query("SELECT CAST(v AS BIGINT) AS discount, l_returnflag, round(sum(l_extendedprice) * (100 - v) / 100, 2) AS revenue FROM lineitem, (SELECT unnest(range(0, 51, 10)) AS v) GROUP BY 1, 2, v")
def model_range_applied(t):
    """What revenue would be at each value of a range parameter: the rows are summed first, and meet the parameter's few values after."""
    sums = t("lineitem").groupBy("l_returnflag").agg(F.sum("l_extendedprice").alias("s"))
    df = J.cross(sums, M.range_table(t.spark, 0, 50, 10))
    return df.select(F.col("value").alias("discount"), "l_returnflag", F.round(F.col("s") * (100 - F.col("value")) / 100, 2).alias("revenue"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS status, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def model_list_applied(t):
    chosen = M.list_table(t.spark, [("F", "finished"), ("O", "open")])
    return t("orders").join(chosen, F.col("o_orderstatus") == F.col("value")).groupBy(F.col("alias").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' END AS side, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def source_inline_joined(t):
    """A literal table beside stored ones."""
    sides = readers.inline(t.spark, [("ASIA", "east"), ("EUROPE", "west"), ("NOWHERE", None)], "name string, side string")
    places = J.related(J.related(t("nation"), t("region"), [("n_regionkey", "r_regionkey")], ["r_name"]), sides, [("r_name", "name")], ["side"])
    df = J.join(t("customer"), places.select("n_nationkey", "side"), [("c_nationkey", "n_nationkey")])
    return df.groupBy("side").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("""WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, round(a * q + b, 4) AS expected, l_extendedprice > a * q + b AS above FROM (SELECT *, nullif(l_quantity, 7) AS q FROM lineitem), m""")
def script_predicted(t):
    """A line fitted by Spark, scored as a model in Python, two columns at once."""
    line = N.trend(t("lineitem"), "l_quantity", "l_extendedprice").first()
    slope, intercept = line["slope"], line["intercept"]

    def model(rows: pd.DataFrame) -> pd.DataFrame:
        expected = slope * rows["q"] + intercept
        return pd.DataFrame({"expected": expected, "above": rows["l_extendedprice"] > expected})

    df = t("lineitem").withColumn("q", F.nullif("l_quantity", F.lit(7.0)))
    df = scripts.predicted(df, model, ["q", "l_extendedprice"], "expected double, above boolean")
    return df.select("l_orderkey", "l_linenumber", F.round("expected", 4).alias("expected"), "above")


@query("""SELECT o_custkey, 'held' AS column_name, 'differs' AS kind FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 50 = 0) > 0 AND o_custkey % 9 <> 4
UNION ALL SELECT DISTINCT o_custkey, CAST(NULL AS VARCHAR), 'missing' FROM orders WHERE o_custkey % 9 = 4""")
def quality_deep_compare(t):
    """Each customer's orders as lists of structs; every fiftieth order costs a little more, the other prices differ by less than the tolerance."""

    def held(df):
        orders = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice", F.create_map(F.lit("status"), "o_orderstatus").cast("map<string,string>")["status"].alias("status"))))
        return df.groupBy("o_custkey").agg(orders.alias("held"))

    price = F.col("o_totalprice") * F.when(F.col("o_orderkey") % 50 == 0, 1.01).otherwise(1 + 1e-9)
    return Q.compare_deep(held(t("orders")), held(t("orders").withColumn("o_totalprice", price).where("o_custkey % 9 <> 4")), ["o_custkey"], 1e-6)


@query("""SELECT o_orderpriority, count(*) AS expected, count(*) FILTER (o_orderkey % 40 <> 1 AND o_orderpriority <> '5-LOW') AS actual, count(*) - count(*) FILTER (o_orderkey % 40 <> 1 AND o_orderpriority <> '5-LOW') <= 0.026 * count(*) AS ok FROM orders GROUP BY 1""")
def quality_row_counts(t):
    return Q.row_counts(t("orders"), t("orders").where("o_orderkey % 40 <> 1 AND o_orderpriority <> '5-LOW'"), ["o_orderpriority"], 0.026)


@query("""SELECT 'c_name' AS removed, 'full_name' AS added, round(count(DISTINCT c_name) FILTER (c_custkey % 3 <> 0) / count(DISTINCT c_name), 9) AS likeness FROM customer
UNION ALL SELECT 'c_nationkey', 'country', round(count(DISTINCT c_nationkey) FILTER (c_custkey % 3 <> 0) / count(DISTINCT c_nationkey), 9) FROM customer""")
def quality_renamed_columns(t):
    """Columns that changed their names are known by their values, though a third of the rows is gone."""
    new = t("customer").where("c_custkey % 3 <> 0").withColumnsRenamed({"c_name": "full_name", "c_nationkey": "country"}).withColumn("note", F.lit("x"))
    return Q.renamed_by_values(t("customer"), new).withColumn("likeness", F.round("likeness", 9))


@query("SELECT count(*) AS n_rows, true AS same_rows, true AS other_rows FROM lineitem")
def quality_fingerprint(t):
    """The rows in another order and with columns in another order are the same; one that is changed in a cell is not."""
    df = t("lineitem")
    again = df.orderBy(F.desc("l_extendedprice")).select(*reversed(df.columns))
    least = df.agg(F.min("l_orderkey")).first()[0]
    other = df.withColumn("l_tax", F.when(F.col("l_orderkey") == least, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    a, b, c = (Q.fingerprint(x).toDF(f"n{i}", f"f{i}") for i, x in enumerate((df, again, other)))
    return a.join(b).join(c).select(F.col("n0").alias("n_rows"), (F.col("f0") == F.col("f1")).alias("same_rows"), (F.col("f0") != F.col("f2")).alias("other_rows"))
