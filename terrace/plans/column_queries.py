"""Queries of the column, filter and cleaning operators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import cleaning as K
from ..operators import columns as C
from ..operators import filters as X
from ..operators.aggregates import fixed
from .catalogue import query


@query("SELECT c_custkey AS id, c_name AS customer_name, c_mktsegment, c_name AS name_copy FROM customer")
def steps_rename_remove_duplicate(t):
    df = C.rename(t("customer"), {"c_custkey": "id", "c_name": "customer_name"})
    return C.remove(C.duplicate(df, "customer_name", "name_copy"), ["c_nationkey", "c_acctbal"])


@query("SELECT s_name, s_suppkey FROM supplier")
def steps_keep_columns(t):
    return C.keep(t("supplier"), ["s_name", "s_suppkey"])


@query("SELECT n_name, n_nationkey, n_regionkey FROM nation")
def steps_reorder(t):
    return C.reorder(t("nation"), ["n_name"])


@query("SELECT c_custkey, TRY_CAST(substr(c_name, 10) AS BIGINT) AS c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey FROM customer")
def steps_change_type(t):
    df = t("customer").select("c_custkey", F.substring("c_name", 10, 99).alias("c_name"), "c_nationkey")
    return C.change_type(df, {"c_name": "integer", "c_nationkey": "real"})


@query("""SELECT p_partkey, nullif(split_part(p_type, ' ', 1), '') AS "p_type.1", nullif(split_part(p_type, ' ', 2), '') AS "p_type.2",
nullif(split_part(p_type, ' ', 9), '') AS "p_type.3" FROM part""")
def steps_split_by_delimiter(t):
    df = C.split_by_delimiter(t("part").select("p_partkey", "p_type"), "p_type", " ", 9)
    return df.select("p_partkey", "`p_type.1`", "`p_type.2`", F.col("`p_type.9`").alias("p_type.3"))


@query("SELECT p_partkey, substr(p_brand, 1, 5) AS \"p_brand.1\", substr(p_brand, 6) AS \"p_brand.2\" FROM part")
def steps_split_by_position(t):
    return C.split_by_position(t("part").select("p_partkey", "p_brand"), "p_brand", [0, 5])


@query("SELECT p_partkey, concat_ws(' / ', p_brand, p_type) AS label FROM part")
def steps_merge(t):
    return C.merge(t("part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"], "label", " / ")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size,
CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders""")
def steps_conditional_column(t):
    price = F.col("o_totalprice")
    df = C.add(t("orders"), "size", C.conditional([(price > 200000, "large"), (price > 50000, "middle")], "small"))
    return C.add(df, "whole", price, "integer").select("o_orderkey", "size", "whole")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) * 10 - 5 AS BIGINT) AS idx FROM orders")
def steps_index(t):
    return C.add_index(t("orders").select("o_orderkey", "o_orderdate"), "idx", ["o_orderdate", "o_orderkey"], 5, 10).select("o_orderkey", "idx")


@query("""SELECT 'r_name' AS "column", max(CASE WHEN r_regionkey = 0 THEN r_name END) AS "0", max(CASE WHEN r_regionkey = 1 THEN r_name END) AS "1",
max(CASE WHEN r_regionkey = 2 THEN r_name END) AS "2" FROM region""")
def steps_transpose(t):
    df = t("region").withColumn("r_regionkey", F.col("r_regionkey").cast("string"))
    return C.transpose(df, "r_regionkey", ["0", "1", "2"])


@query("SELECT 'r_regionkey' AS Column1, 'r_name' AS Column2 UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def steps_demote_headers(t):
    return C.demote_headers(t("region"))


@query("""SELECT o_orderkey, o_custkey, round(share, 6) AS share FROM (SELECT o.*, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey) AS share FROM orders o WHERE o_orderstatus = 'F'
AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY round(sum(o_totalprice), 2) DESC, 1 LIMIT 10)) WHERE o_orderpriority = '1-URGENT'""")
def filter_context(t):
    """The ten largest customers and each one's whole among finished orders; their urgent orders' shares of it."""
    top = lambda df: X.top_by(df, "o_custkey", F.round(F.sum("o_totalprice"), 2), 10)
    whole = lambda df: fixed(df, ["o_custkey"], F.sum("o_totalprice"), "whole")
    df = X.in_order(t("orders"), [F.col("o_orderstatus") == "F"], [top, whole], [F.col("o_orderpriority") == "1-URGENT"])
    return df.select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") / F.col("whole"), 6).alias("share"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def steps_promote_headers(t):
    df = C.demote_headers(t("region")).withColumn("_o", F.when(F.col("Column1") == "r_regionkey", 0).otherwise(1))
    return C.promote_headers(df, ["_o", "Column1"]).select("r_regionkey", "r_name")


@query("SELECT 'r_regionkey' AS r_regionkey, 'r_name' AS r_name UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name FROM region")
def steps_promote_repeated_headers(t):
    """Only the first of two rows of names goes."""
    df = C.demote_headers(t("region"), "at")
    twice = df.union(df.where("at = 0").withColumn("at", F.lit(2)))
    return C.promote_headers(twice, ["at", "Column1"]).select("r_regionkey", "r_name")


@query("SELECT n_nationkey, r.r_name AS region_name FROM nation JOIN region r ON n_regionkey = r_regionkey")
def steps_expand_joined(t):
    side = t("region").select("r_regionkey", F.struct("r_name").alias("region"))
    df = t("nation").join(side, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "region")
    return C.expand_struct(df, "region", ["r_name"]).withColumnRenamed("r_name", "region_name")


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY 1")
def filter_keep_values(t):
    return t("customer").where(X.keep_values(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"])).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n FROM (SELECT nullif(c_mktsegment, 'BUILDING') AS s FROM customer) WHERE s IS NULL OR s NOT IN ('MACHINERY')""")
def filter_exclude_values(t):
    s = F.nullif("c_mktsegment", F.lit("BUILDING"))
    return t("customer").where(X.exclude_values(s, ["MACHINERY"])).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 45 WHERE l_returnflag IS NULL OR l_returnflag <> 'R'")
def filter_value_keeps_null(t):
    df = t("orders").join(t("lineitem").where("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return df.where(X.exclude_values(F.col("l_returnflag"), ["R"])).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def filter_range(t):
    return t("orders").where(X.between(F.col("o_totalprice"), 100000.0, 150000.0)).select("o_orderkey", "o_totalprice")


@query("SELECT count(*) AS n FROM lineitem WHERE nullif(l_quantity, 7) IS NULL OR NOT (l_quantity >= 5 AND l_quantity < 40)")
def filter_range_exclusion(t):
    return t("lineitem").where(X.outside(F.nullif("l_quantity", F.lit(7.0)), 5.0, 40.0, include_high=False)).agg(F.count("*").alias("n"))


@query("SELECT count(*) FILTER (nullif(l_linestatus, 'O') IS NULL) AS nulls, count(nullif(l_linestatus, 'O')) AS others FROM lineitem")
def filter_nulls(t):
    status = F.nullif("l_linestatus", F.lit("O"))
    a = t("lineitem").where(X.nulls(status, True)).agg(F.count("*").alias("nulls"))
    return a.crossJoin(t("lineitem").where(X.nulls(status, False)).agg(F.count("*").alias("others")))


@query("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%STEEL%' AND p_type NOT LIKE 'S%' OR p_brand LIKE 'Brand#_1'")
def filter_matches(t):
    kind = F.col("p_type")
    df = t("part").where((X.matches(kind, "STEEL") & ~X.matches(kind, "S", "starts")) | X.matches(F.col("p_brand"), "Brand#?1", "wildcard"))
    return df.select("p_partkey", "p_type")


@query("SELECT count(*) AS n FROM orders WHERE NOT coalesce(CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice > 100000 END, false)")
def filter_expression_remove(t):
    condition = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") > 100000)
    return t("orders").where(X.remove_if(condition)).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= date_trunc('month', TIMESTAMP '1997-05-17') - INTERVAL 2 MONTH
AND o_orderdate < date_trunc('month', TIMESTAMP '1997-05-17') + INTERVAL 1 MONTH""")
def filter_relative_date(t):
    anchor = F.lit(dt.datetime(1997, 5, 17))
    return t("orders").where(X.relative_date(F.col("o_orderdate").cast("timestamp"), anchor, "month", "last", 3)).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE quarter(o_orderdate) IN (1, 4) AND month(o_orderdate) <> 2")
def filter_date_part(t):
    return t("orders").where(F.quarter("o_orderdate").isin(1, 4) & ~F.month("o_orderdate").isin(2)).agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS n FROM orders WHERE NOT (o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-03-01'
OR o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-02-01')""")
def filter_date_intervals(t):
    spans = [(dt.date(1996, 1, 1), dt.date(1996, 3, 1)), (dt.date(1997, 1, 1), dt.date(1997, 2, 1))]
    return t("orders").where(X.in_intervals(F.col("o_orderdate").cast("timestamp"), spans, invert=True)).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1
ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey LIMIT 5)""")
def filter_top_customers(t):
    return X.top_by(t("orders"), "o_custkey", F.round(F.sum("o_totalprice"), 2), 5).select("o_orderkey", "o_custkey")


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1 HAVING round(sum(c_acctbal), 2) > 20000")
def filter_measure(t):
    return t("customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("balance")).where("balance > 20000")


@query("SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def filter_incremental_range(t):
    from ..streaming.incremental import between

    return between(t("orders"), "o_orderdate", dt.datetime(1996, 1, 1), dt.datetime(1997, 1, 1)).agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE TRY_CAST(split_part(p_brand, '#', 2) AS BIGINT) IS NOT NULL")
def filter_castable(t):
    return t("part").where(X.castable(F.split_part("p_brand", F.lit("#"), F.lit(2)), "bigint")).select("p_partkey")


@query("SELECT count(*) AS n FROM nation")
def filter_blank_rows(t):
    blank = t("nation").select(*[F.lit(None).cast(kind).alias(c) for c, kind in t("nation").dtypes])
    return X.not_blank(t("nation").union(blank)).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey, replace(p_type, 'STEEL', 'IRON') AS text_replaced, CASE WHEN p_size = 1 THEN 100 ELSE p_size END AS value_replaced,
coalesce(nullif(p_brand, 'Brand#11'), 'none') AS null_replaced, coalesce(TRY_CAST(p_name AS BIGINT), -1) AS error_replaced FROM part""")
def clean_replace(t):
    return t("part").select(
        "p_partkey",
        K.replace_text(F.col("p_type"), "STEEL", "IRON").alias("text_replaced"),
        K.replace_value(F.col("p_size"), 1, 100).alias("value_replaced"),
        K.replace_nulls(F.nullif("p_brand", F.lit("Brand#11")), "none").alias("null_replaced"),
        K.replace_errors(F.col("p_name"), "bigint", -1).cast("bigint").alias("error_replaced"),
    )


@query("""SELECT c_custkey, regexp_replace('  ' || c_name || ' ', '^\\s+|\\s+$', '', 'g') AS trimmed, upper(c_name) AS up, lower(c_name) AS low,
upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS title FROM customer""")
def clean_case_and_trim(t):
    c = F.col("c_name")
    return t("customer").select("c_custkey", K.trim_spaces(F.concat(F.lit("  "), c, F.lit(" "))).alias("trimmed"), F.upper(c).alias("up"), F.lower(c).alias("low"), K.proper(F.col("c_mktsegment")).alias("title"))


@query("""SELECT c_custkey, regexp_replace(c_name, '\\p{L}', '', 'g') AS no_letters, regexp_replace(c_name, '\\p{N}', '', 'g') AS no_numbers,
regexp_replace(c_name, '\\p{P}', '', 'g') AS no_marks, regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g') AS alnum FROM customer""")
def clean_character_classes(t):
    c = F.col("c_name")
    return t("customer").select("c_custkey", K.remove_letters(c).alias("no_letters"), K.remove_numbers(c).alias("no_numbers"), K.remove_punctuation(c).alias("no_marks"), K.alphanumeric(c).alias("alnum"))


@query("""SELECT c_custkey, split_part(c_name, '#', 1) AS head, split_part(c_name, '#', 2) AS tail, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded,
regexp_extract(c_name, 'C(.*?)#', 1) AS inside FROM customer""")
def clean_extract_and_pad(t):
    c = F.col("c_name")
    return t("customer").select("c_custkey", K.before(c, "#").alias("head"), K.after(c, "#").alias("tail"), K.pad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"), K.within(c, "C", "#").alias("inside"))


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS down,
first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up FROM e""")
def clean_fill(t):
    v = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").withColumn("v", v).select("event_id", K.fill_down(F.col("v"), w).alias("down"), K.fill_up(F.col("v"), w).alias("up"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status,
CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'top' ELSE o_orderpriority END AS priority FROM orders""")
def clean_remap(t):
    return t("orders").select(
        "o_orderkey",
        K.remap(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"),
        K.replace_chain(F.col("o_orderpriority"), [("1-URGENT", "2-HIGH"), ("2-HIGH", "top")]).alias("priority"),
    )


@query("""SELECT p_partkey, regexp_matches(p_type, 'STEEL|TIN') AS hit, nullif(regexp_extract(p_brand, '#([0-9])', 1), '') AS digit,
regexp_replace(p_type, '[AEIOU]', '_', 'g') AS masked FROM part""")
def clean_regex(t):
    from ..functions import scalar as S

    return t("part").select("p_partkey", S.regexp_match(F.col("p_type"), "STEEL|TIN").alias("hit"), S.regexp_extract(F.col("p_brand"), "#([0-9])").alias("digit"), S.regexp_replace(F.col("p_type"), "[AEIOU]", "_").alias("masked"))


@query("SELECT n_nationkey, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def clean_parse_json(t):
    text = F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("region")).alias("at")))
    df = t("nation").select("n_nationkey", text.alias("j"))
    return df.select("n_nationkey", K.json_record(F.col("j"), "name string")["name"].alias("name"), K.json_field(F.col("j"), "$.at.region").alias("region"))
