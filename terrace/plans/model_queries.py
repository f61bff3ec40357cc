"""Queries of scalar functions, the model, analytics, quality checks, sources, flows, scripts and streams."""

from __future__ import annotations

import datetime as dt
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions import scripts
from ..operators import analytics as N
from ..operators import cleaning as K
from ..operators import model as M
from ..operators import quality as Q
from ..operators.joins import join
from ..shared import materialised, new_folder
from ..sources import readers, writers
from ..streaming import incremental
from .catalogue import query
from .flow import Flow


@query("""SELECT o_orderkey, CASE WHEN s IS NULL THEN 'unknown' WHEN s = 'F' THEN 'yes' ELSE 'no' END AS iif, CASE s WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS c, s IS NULL AS isn,
coalesce(s, '-') AS ifn, nullif(o_orderpriority, '5-LOW') AS nul, coalesce(CASE WHEN s = 'O' THEN o_totalprice END, 0) AS zn, TRY_CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) IS NOT NULL AS isnum,
CASE WHEN s IS NULL THEN NULL ELSE least(length(s), 5) END AS lo, CASE WHEN s IS NULL THEN NULL ELSE greatest(length(s), 5) END AS hi FROM (SELECT *, nullif(o_orderstatus, 'P') AS s FROM orders)""")
def scalar_logic(t):
    s, n = F.col("s"), F.length("s").cast("bigint")
    return t("orders").withColumn("s", F.nullif("o_orderstatus", F.lit("P"))).select(
        "o_orderkey", S.iif(s == "F", "yes", "no", "unknown").alias("iif"), S.case(s, [("F", 1), ("O", 2)], 0).alias("c"), S.isnull(s).alias("isn"), S.ifnull(s, "-").alias("ifn"),
        S.nullif(F.col("o_orderpriority"), "5-LOW").alias("nul"), S.zn(F.when(s == "O", F.col("o_totalprice"))).alias("zn"), S.isnumber(F.substring("o_orderpriority", 1, 1)).alias("isnum"),
        S.least_of(n, F.lit(5).cast("bigint")).alias("lo"), S.greatest_of(n, F.lit(5).cast("bigint")).alias("hi"),
    )


@query("""SELECT p_partkey, CAST(length(p_type) AS INT) AS len, left(p_type, 3) AS l, right(p_type, 3) AS r, substr(p_type, 3, 4) AS m, contains(p_type, 'TIN') AS has, starts_with(p_type, 'S') AS st,
ends_with(p_type, 'L') AS en, CAST(instr(p_type, 'E') AS INT) AS f, split_part(p_type, ' ', 2) AS tok, split_part(p_type, ' ', -1) AS tail, reverse(p_brand) AS rev, repeat('ab', 3) AS rep, p_brand || '-' || p_type AS cat,
CAST(p_size AS VARCHAR) AS str, ascii(p_type) AS code FROM part""")
def scalar_text(t):
    p, b = F.col("p_type"), F.col("p_brand")
    return t("part").select(
        "p_partkey", S.length(p).alias("len"), S.left(p, 3).alias("l"), S.right(p, 3).alias("r"), S.mid(p, 3, 4).alias("m"), S.contains(p, "TIN").alias("has"), S.starts_with(p, "S").alias("st"),
        S.ends_with(p, "L").alias("en"), S.find(p, "E").alias("f"), S.split(p, " ", 2).alias("tok"), S.split(p, " ", -1).alias("tail"), F.reverse(b).alias("rev"), F.repeat(F.lit("ab"), F.lit(3)).alias("rep"),
        F.concat(b, F.lit("-"), p).alias("cat"), S.text(F.col("p_size")).alias("str"), F.ascii(p).alias("code"),
    )


@query("""SELECT p_partkey, CAST(CASE WHEN len(string_split(p_type, 'E')) > 2 THEN length(array_to_string(string_split(p_type, 'E')[1:2], 'E')) + 1 ELSE 0 END AS INT) AS second_e,
nullif(regexp_extract(p_brand, 'Brand#([0-9])([0-9])', 2), '') AS digit FROM part""")
def scalar_find_nth(t):
    return t("part").select("p_partkey", S.find_nth(F.col("p_type"), "E", 2).alias("second_e"), S.regexp_extract(F.col("p_brand"), "Brand#([0-9])([0-9])", 2).alias("digit"))


@query("""SELECT s_suppkey, abs(s_acctbal) AS a, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(s_acctbal, 1) AS r, CAST(trunc(s_acctbal) AS BIGINT) AS i,
round(CASE WHEN s_acctbal >= 0 THEN sqrt(s_acctbal) END, 6) AS sq, round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END, 6) AS ln, round(CASE WHEN s_acctbal > 0 THEN log10(s_acctbal) END, 6) AS lg,
round(pow(s_nationkey, 2), 4) AS pw, CAST(sign(s_acctbal) AS DOUBLE) AS sg, s_suppkey % nullif(s_nationkey, 0) AS md, s_acctbal / nullif(CAST(s_nationkey AS DOUBLE), 0) AS dv,
CAST(trunc(s_suppkey / nullif(s_nationkey, 0)) AS BIGINT) AS iq FROM supplier""")
def scalar_numbers(t):
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    return t("supplier").select(
        "s_suppkey", F.abs(b).alias("a"), F.ceil(b).alias("c"), F.floor(b).alias("f"), F.round(b, 1).alias("r"), S.to_int(b).alias("i"), F.round(S.sqrt(b), 6).alias("sq"), F.round(S.ln(b), 6).alias("ln"),
        F.round(S.log(b), 6).alias("lg"), F.round(S.power(n, 2), 4).alias("pw"), F.signum(b).alias("sg"), S.modulo(F.col("s_suppkey"), n).alias("md"), S.divide(b, n).alias("dv"), S.div(F.col("s_suppkey"), n).alias("iq"),
    )


@query("""SELECT s_suppkey, round(sin(x), 9) AS si, round(cos(x), 9) AS co, round(tan(x), 9) AS ta, round(asin(y), 9) AS asi, round(acos(y), 9) AS aco, round(atan(x), 9) AS ata, round(atan2(x, 2), 9) AS at2,
round(degrees(x), 6) AS de, round(radians(x), 9) AS ra, round(1 / nullif(tan(x), 0), 6) AS ct, round(exp(y), 9) AS ex, round(12742 * asin(sqrt(pow(sin(radians(y * 10) / 2), 2))), 3) AS km
FROM (SELECT s_suppkey, 0.1 + s_nationkey / 10.0 AS x, CASE WHEN s_nationkey < 10 THEN s_nationkey / 10.0 END AS y FROM supplier)""")
def scalar_trigonometry(t):
    x, z = F.col("x"), F.lit(0.0)
    df = t("supplier").select("s_suppkey", (F.lit(0.1) + F.col("s_nationkey") / 10.0).alias("x"), (F.col("s_nationkey") / 10.0).alias("y0"))
    y = F.when(F.col("y0") < 1, F.col("y0"))
    return df.select(
        "s_suppkey", F.round(F.sin(x), 9).alias("si"), F.round(F.cos(x), 9).alias("co"), F.round(F.tan(x), 9).alias("ta"), F.round(S.asin(y), 9).alias("asi"), F.round(S.acos(y), 9).alias("aco"),
        F.round(F.atan(x), 9).alias("ata"), F.round(F.atan2(x, F.lit(2.0)), 9).alias("at2"), F.round(F.degrees(x), 6).alias("de"), F.round(F.radians(x), 9).alias("ra"), F.round(S.cot(x), 6).alias("ct"),
        F.round(F.exp(y), 9).alias("ex"), F.round(S.distance(z, z, y * 10, z), 3).alias("km"),
    )


@query("""SELECT o_orderkey, CAST(year(d) AS INT) AS y, CAST(quarter(d) AS INT) AS q, CAST(month(d) AS INT) AS m, CAST(day(d) AS INT) AS dy, CAST(dayofyear(d) AS INT) AS doy, CAST(dayofweek(d) + 1 AS INT) AS wd,
CAST(weekofyear(d) AS INT) AS wk, CAST(isodow(d) AS INT) AS iwd, CAST(isoyear(d) AS INT) AS iy, monthname(d) AS mn, dayname(d) AS dn, CAST(date_trunc('quarter', d) AS DATE) AS tq, CAST(date_trunc('week', d) AS DATE) AS tw
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)""")
def scalar_date_parts(t):
    d = F.col("d")
    part = lambda p: S.date_part(p, d).cast("int")
    return t("orders").withColumn("d", F.col("o_orderdate").cast("timestamp")).select(
        "o_orderkey", part("year").alias("y"), part("quarter").alias("q"), part("month").alias("m"), part("day").alias("dy"), part("dayofyear").alias("doy"), part("weekday").alias("wd"), part("week").alias("wk"),
        part("iso-weekday").alias("iwd"), part("iso-year").alias("iy"), S.date_name("month", d).alias("mn"), S.date_name("weekday", d).alias("dn"), S.date_trunc("quarter", d).cast("date").alias("tq"),
        S.date_trunc("week", d).cast("date").alias("tw"),
    )


@query("""SELECT o_orderkey, CAST(datediff('day', d, a) AS BIGINT) AS dd, CAST(datediff('day', date_trunc('week', d), date_trunc('week', a)) // 7 AS BIGINT) AS dw, CAST(datediff('month', d, a) AS BIGINT) AS dm, CAST(datediff('quarter', d, a) AS BIGINT) AS dq, CAST(datediff('year', d, a) AS BIGINT) AS dy,
CAST(datediff('hour', d, a) AS BIGINT) AS dh, CAST(d + INTERVAL 1 MONTH AS DATE) AS am, CAST(d - INTERVAL 2 WEEK AS DATE) AS aw, CAST(d + INTERVAL 1 YEAR AS DATE) AS ay, make_date(CAST(year(d) AS INT), CAST(month(d) AS INT), 1) AS md,
TRY_CAST(strftime(d, '%Y-%m') || '-31' AS DATE) AS last_or_null FROM (SELECT o_orderkey, o_orderdate AS d, TIMESTAMP '1998-12-31 12:00:00' AS a FROM orders)""")
def scalar_date_arithmetic(t):
    d, a = F.col("d"), F.lit(dt.datetime(1998, 12, 31, 12))
    diff = lambda p: S.date_diff(p, d, a).cast("bigint")
    return t("orders").withColumn("d", F.col("o_orderdate").cast("timestamp")).select(
        "o_orderkey", diff("day").alias("dd"), diff("week").alias("dw"), diff("month").alias("dm"), diff("quarter").alias("dq"), diff("year").alias("dy"), diff("hour").alias("dh"),
        S.date_add("month", 1, d).cast("date").alias("am"), S.date_add("week", -2, d).cast("date").alias("aw"), S.date_add("year", 1, d).cast("date").alias("ay"),
        S.make_date(F.year(d), F.month(d), F.lit(1)).alias("md"), S.make_date(F.year(d), F.month(d), F.lit(31)).alias("last_or_null"),
    )


@query("""SELECT o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS parsed, TRY_CAST(o_orderpriority AS DATE) IS NOT NULL AS isdate FROM orders""")
def scalar_date_parse(t):
    text = F.date_format("o_orderdate", "dd.MM.yyyy")
    return t("orders").select("o_orderkey", S.date_parse("dd.MM.yyyy", text).cast("timestamp_ntz").alias("parsed"), S.isdate(F.col("o_orderpriority")).alias("isdate"))


@query("""SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS in_set, CASE WHEN c_nationkey IN (0, 1, 2) THEN 'first' WHEN c_nationkey IN (3, 4) THEN 'second' ELSE 'Other' END AS grp,
floor(c_acctbal / 1000) * 1000 AS bin, concat_ws(' | ', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS both FROM customer""")
def model_set_group_bin(t):
    return t("customer").select(
        "c_custkey", M.in_set(F.col("c_mktsegment"), ["BUILDING", "MACHINERY"]).alias("in_set"), M.grouped(F.col("c_nationkey"), {"first": [0, 1, 2], "second": [3, 4]}).alias("grp"),
        M.bins(F.col("c_acctbal"), 1000.0).alias("bin"), M.combined([F.col("c_mktsegment"), F.col("c_nationkey")]).alias("both"),
    )


@query("""SELECT c_custkey, coalesce(r_name, 'none') AS area FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 3)
ON c_nationkey = n_nationkey""")
def model_group_by_table(t):
    table = t("nation").join(t("region").where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("value"), F.col("r_name").alias("label"))
    return M.grouped_by_table(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey", table, "none", "area").select("c_custkey", "area")


@query("SELECT CAST(i AS BIGINT) AS value FROM range(10, 51, 5) r(i)")
def model_range_parameter(t):
    return M.range_table(t.spark, 10, 50, 5)


@query("SELECT 'F' AS value, 'finished' AS alias UNION ALL SELECT 'O', 'open'")
def model_list_parameter(t):
    return M.list_table(t.spark, [("F", "finished"), ("O", "open")])


@query("SELECT o_orderstatus AS dimension, round(avg(o_totalprice), 4) AS measure FROM orders GROUP BY 1")
def model_switches(t):
    measure = M.switch("average", {"total": F.round(F.sum("o_totalprice"), 2), "average": F.round(F.avg("o_totalprice"), 4)})
    dimension = M.switch("status", {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})
    return t("orders").groupBy(dimension.alias("dimension")).agg(measure.alias("measure"))


@query("""SELECT d AS date, CAST(date_trunc('month', d) AS DATE) AS month_start, CAST(year(d) AS INT) AS year, 'Q' || quarter(d) AS quarter, CAST(month(d) AS INT) AS month, monthname(d) AS month_name, CAST(day(d) AS INT) AS day,
CAST(isodow(d) AS INT) AS day_of_week, dayname(d) AS day_name FROM (SELECT CAST(unnest(generate_series((SELECT make_date(CAST(least(min(year(o_orderdate)), 2020) AS INT), 1, 1) FROM orders),
(SELECT make_date(CAST(greatest(max(year(o_orderdate)), 2021) AS INT), 12, 31) FROM orders), INTERVAL 1 DAY)) AS DATE) AS d)""")
def model_calendar(t):
    return M.calendar(t("orders"), "o_orderdate", 2020, 2021)


_MONTHLY = "WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mon, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) "


@query(_MONTHLY + """SELECT a.mon, a.v, round(sum(a.v) OVER (PARTITION BY year(a.mon) ORDER BY a.mon), 2) AS ytd, b.v AS py, round((a.v - b.v) / nullif(b.v, 0), 8) AS yoy
FROM m a LEFT JOIN m b ON b.mon = a.mon - INTERVAL 1 YEAR""")
def model_time_intelligence(t):
    m = t("orders").groupBy(F.trunc("o_orderdate", "month").alias("mon")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    df = M.prior_year(m, "mon", "v", "py")
    return df.select("mon", "v", F.round(M.year_to_date(F.col("v"), "mon"), 2).alias("ytd"), "py", F.round(M.growth(F.col("v"), F.col("py")), 8).alias("yoy"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def model_row_security(t):
    return M.secured(t("customer"), "c_mktsegment", "ann", {"ann": ["BUILDING", "AUTOMOBILE"], "bob": []}).select("c_custkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) OR s_acctbal > 9000")
def model_row_security_roles(t):
    grants = t("nation").select(F.concat(F.lit("u"), F.col("n_regionkey")).alias("user"), F.col("n_nationkey").alias("value"))
    a = M.secured_by_table(t("supplier"), "s_nationkey", "u2", grants).select("s_suppkey")
    roles = M.any_role([(F.col("s_acctbal") > 9000) & M.is_member("rich", ["rich"]), F.col("s_acctbal").isNull()])
    return a.union(t("supplier").where(roles).select("s_suppkey")).distinct()


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def analytics_trend(t):
    df = N.trend(t("lineitem"), "l_quantity", "l_extendedprice", "linear", ["l_returnflag"])
    return df.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("""SELECT round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept FROM lineitem""")
def analytics_trend_power(t):
    return N.trend(t("lineitem"), "l_quantity", "l_extendedprice", "power").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@query("""SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high,
round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1""")
def analytics_reference_lines(t):
    df = N.reference_lines(t("orders"), "o_totalprice", ["o_orderstatus"])
    return df.withColumns({c: F.round(c, 4) for c in ("mean", "median", "p25", "p75")})


@query("""SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(avg(o_totalprice) - 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS low,
round(avg(o_totalprice) + 1.96 * stddev_samp(o_totalprice) / sqrt(count(*)), 4) AS high FROM orders GROUP BY 1""")
def analytics_confidence(t):
    return N.confidence(t("orders"), "o_totalprice", 1.96, ["o_orderstatus"]).withColumns({c: F.round(c, 4) for c in ("mean", "low", "high")})


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1 HAVING round(sum(c_acctbal), 2) >= 25000")
def analytics_alerts(t):
    return N.alerts(t("customer"), ["c_nationkey"], F.round(F.sum("c_acctbal"), 2), ">=", 25000.0)


@query()
def analytics_clusters(t):
    return N.clusters(t("supplier"), ["s_acctbal", "s_nationkey"], 3).select("s_suppkey", "cluster")


@query("""WITH s AS (SELECT count(*)::DOUBLE AS a, sum(q) AS b, sum(q * q) AS c, sum(q * q * q) AS d, sum(q * q * q * q) AS e, sum(p) AS x, sum(q * p) AS y, sum(q * q * p) AS z
FROM (SELECT CAST(l_quantity AS DOUBLE) AS q, CAST(l_extendedprice AS DOUBLE) AS p FROM lineitem)), m AS (SELECT *, a * (c * e - d * d) - b * (b * e - c * d) + c * (b * d - c * c) AS w FROM s)
SELECT 0 AS power, round((x * (c * e - d * d) - b * (y * e - d * z) + c * (y * d - c * z)) / w, 3) AS coefficient FROM m
UNION ALL SELECT 1, round((a * (y * e - d * z) - x * (b * e - c * d) + c * (b * z - y * c)) / w, 3) FROM m
UNION ALL SELECT 2, round((a * (c * z - y * d) - b * (b * z - y * c) + x * (b * d - c * c)) / w, 3) FROM m""")
def analytics_trend_polynomial(t):
    c = N.polynomial_trend(t("lineitem"), "l_quantity", "l_extendedprice", 2)
    return t.spark.createDataFrame([(i, round(v, 3) + 0.0) for i, v in enumerate(c)], "power int, coefficient double")


@query("""SELECT c_nationkey, e AS expected, a AS actual, a IS NOT NULL AND abs(e - a) <= 0.01 * abs(e) AS ok FROM (SELECT c_nationkey, round(sum(c_acctbal), 2) AS e FROM customer GROUP BY 1)
LEFT JOIN (SELECT c_nationkey, round(sum(c_acctbal) * (1 + c_nationkey / 1000.0), 2) AS a FROM customer WHERE c_nationkey <> 7 GROUP BY 1) USING (c_nationkey)""")
def quality_compare(t):
    total = F.sum("c_acctbal")
    e = t("customer").groupBy("c_nationkey").agg(F.round(total, 2).alias("v"))
    a = t("customer").where("c_nationkey != 7").groupBy("c_nationkey").agg(F.round(total * (1 + F.col("c_nationkey") / 1000.0), 2).alias("v"))
    return Q.compare(e, a, ["c_nationkey"], "v")


@query("""SELECT 'o_orderstatus' AS column_name, count(*) AS n_rows, count(*) - count(o_orderstatus) AS n_nulls, count(DISTINCT o_orderstatus) AS n_distinct, min(o_orderstatus) AS least, max(o_orderstatus) AS greatest FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders""")
def quality_profile(t):
    return Q.profile(t("orders"), ["o_orderstatus", "o_custkey"])


@query("SELECT avg(CASE WHEN nullif(o_orderstatus, 'F') IS NULL THEN 1.0 ELSE 0.0 END) AS share FROM orders")
def quality_null_ratio(t):
    return t("orders").agg(Q.null_ratio(F.nullif("o_orderstatus", F.lit("F"))).alias("share"))


@query("SELECT 'c_mktsegment' AS column_name, 0.0::DOUBLE AS as_bigint, 0.0::DOUBLE AS as_double, 0.0::DOUBLE AS as_date UNION ALL SELECT 'k', 1.0, 1.0, avg(CASE WHEN c_custkey BETWEEN 1000 AND 9999 THEN 1.0 ELSE 0.0 END) FROM customer")
def quality_coercions(t):
    return Q.coercions(t("customer").select("c_mktsegment", F.col("c_custkey").cast("string").alias("k")), ["c_mktsegment", "k"])


@query("SELECT r_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 0 GROUP BY 1")
def flow_prepared(t):
    flow = Flow({"customer": t("customer"), "nation": t("nation"), "region": t("region")})
    flow.step("positive", lambda c: c.where("c_acctbal > 0"), "customer")
    flow.step("places", lambda n, r: join(n, r, [("n_regionkey", "r_regionkey")]), "nation", "region")
    flow.step("placed", lambda c, p: join(c, p, [("c_nationkey", "n_nationkey")]), "positive", "places")
    flow.step("totals", lambda p: p.groupBy("r_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance")), "placed")
    return flow.results(["totals"])["totals"]


@query("SELECT o_orderkey, round(o_totalprice * 1.1 + o_custkey, 4) AS scored FROM orders")
def script_scored(t):
    out = scripts.script("SCRIPT_REAL", lambda price, key: price * 1.1 + key, F.col("o_totalprice"), F.col("o_custkey"))
    return t("orders").select("o_orderkey", F.round(out, 4).alias("scored"))


@query("SELECT r_regionkey, upper(r_name) || '!' AS shout FROM region")
def script_table(t):
    return scripts.script_table(t("region"), lambda f: f.assign(shout=f["r_name"].str.upper() + "!")[["r_regionkey", "shout"]], "r_regionkey int, shout string")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1")
def source_custom_sql(t):
    sql = "SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE l_quantity > :least GROUP BY l_returnflag"
    return readers.custom_sql(t.spark, sql, {"least": 30.0}, lineitem=t("lineitem"))


@query("""WITH h AS (SELECT o_orderkey, o_totalprice / 1000.0 AS x, o_custkey / 7.0 AS y FROM orders), c AS (SELECT *, sqrt(3.0) * round(x / sqrt(3.0)) AS ax, 3.0 * round(y / 3.0) AS ay,
sqrt(3.0) * (floor(x / sqrt(3.0)) + 0.5) AS bx, 3.0 * (floor(y / 3.0) + 0.5) AS by_ FROM h), d AS (SELECT *, (x - ax) * (x - ax) + (y - ay) * (y - ay) <= (x - bx) * (x - bx) + (y - by_) * (y - by_) AS near FROM c)
SELECT o_orderkey, round(CASE WHEN near THEN ax ELSE bx END, 6) AS hx, round(CASE WHEN near THEN ay ELSE by_ END, 6) AS hy FROM d""")
def scalar_hexbin(t):
    x, y = S.hexbin(F.col("o_totalprice") / 1000.0, F.col("o_custkey") / 7.0)
    return t("orders").select("o_orderkey", F.round(x, 6).alias("hx"), F.round(y, 6).alias("hy"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey AS region FROM nation")
def clean_parse_xml(t):
    """Fields of a text column of XML records."""
    record = F.concat(F.lit("<row><name>"), F.col("n_name"), F.lit("</name><region>"), F.col("n_regionkey"), F.lit("</region></row>"))
    df = t("nation").select("n_nationkey", K.xml_record(record, "name string, region int").alias("x"))
    return df.select("n_nationkey", "x.name", "x.region")


@query("SELECT 1 AS id, 'a' AS name UNION ALL SELECT 2, NULL")
def source_inline(t):
    return readers.inline(t.spark, [(1, "a"), (2, None)], "id int, name string")


def _folder(t) -> str:
    return new_folder(t.spark, "query")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sink_csv_and_source_csv(t):
    path = _folder(t)
    writers.write_file(t("nation"), path, "csv", sep=";")
    return readers.csv(t.spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey = 3")
def sink_partitions(t):
    path = _folder(t)
    df = t("supplier").select("s_suppkey", "s_name", "s_nationkey")
    writers.write_file(df, path, partition_by=["s_nationkey"])
    writers.replace_partitions(df.where("s_nationkey < 5"), path, ["s_nationkey"])
    return t.spark.read.parquet(path).where("s_nationkey = 3").select("s_suppkey", "s_name", "s_nationkey")


@query("SELECT n_name AS name, n_nationkey AS key FROM nation")
def sink_json_and_source_json(t):
    path = _folder(t)
    writers.write_file(t("nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key")), path, "json")
    return readers.json(t.spark, path, "name string, key int", multiline=False)


@query("SELECT r_regionkey, r_name FROM region")
def sink_xml_and_source_xml(t):
    path = _folder(t)
    t("region").write.format("xml").option("rowTag", "region").save(path)
    return readers.xml(t.spark, path, "region", "r_regionkey int, r_name string")


def _streamed(t, df, aggregate):
    """What a stream of df's rows, file by file, comes to: a table that each micro-batch replaces with the whole result."""
    folder, result = _folder(t), _folder(t)
    df.repartition(4).write.parquet(folder)
    out = aggregate(incremental.watch(t.spark, folder, df.schema, files_each=2))
    replace = lambda batch, _: batch.write.mode("overwrite").parquet(result)
    out.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", _folder(t)).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(out.schema).parquet(result)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windowed(t):
    measures = {"n": F.count("*"), "total": F.round(F.sum("value"), 2)}
    found = _streamed(t, t("events").withColumn("ts", F.col("ts").cast("timestamp")), lambda stream: incremental.windowed(stream, "ts", "1 hour", ["event_type"], measures))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT user_id, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1")
def stream_table_twin(t):
    """The same aggregate as of a table, of a stream."""
    return _streamed(t, t("events"), lambda stream: stream.groupBy("user_id").agg(F.max("ts").alias("ts"), F.count("*").alias("n")))


@query("SELECT n_name, n_nationkey FROM nation")
def source_geojson(t):
    """Features written as text, one collection for each region, and read again."""
    path = _folder(t)
    place = F.struct(F.lit("Point").alias("type"), F.array(F.lit(1.5), F.col("n_regionkey").cast("double")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("n_name", "n_nationkey").alias("properties"), place.alias("geometry"))
    collections = t("nation").groupBy("n_regionkey").agg(F.collect_list(feature).alias("features"))
    collections.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features"))).write.text(path)
    df = readers.geojson(t.spark, path, multiline=False)
    return df.where(F.get_json_object("geometry", "$.type") == "Point").select("n_name", F.col("n_nationkey").cast("int").alias("n_nationkey"))


@query("SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, CAST(NULL AS VARCHAR) AS p_error FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def source_guarded(t):
    p = F.when(F.col("o_orderstatus") != "F", F.substring("o_orderpriority", 1, 1)).otherwise(F.col("o_orderpriority"))
    return readers.guarded(t("orders").select("o_orderkey", p.alias("p")), "p", "int")


@query("SELECT n_regionkey, count(*) AS n, true AS named FROM nation GROUP BY 1")
def source_wildcard_union(t):
    """A file for each region, read as one table that names the files."""
    path = _folder(t)
    writers.write_file(t("nation").withColumn("folder", F.col("n_regionkey")), path, "csv", partition_by=["folder"])
    df = readers.wildcard_union(t.spark, f"{path}/folder=*/*.csv", schema="n_nationkey int, n_name string, n_regionkey int")
    named = F.col("source_file").contains(F.concat(F.lit("folder="), F.col("n_regionkey")))
    return df.groupBy("n_regionkey").agg(F.count("*").alias("n"), F.bool_and(named).alias("named"))


@query("SELECT s_suppkey, s_name FROM supplier")
def source_staged(t):
    """A folder of staged tables: each is found by its name."""
    path = _folder(t)
    writers.write_file(t("supplier"), f"{path}/supplier.parquet")
    writers.write_file(t("region"), f"{path}/region")
    found = readers.staged(t.spark, path)
    if sorted(found) != ["region", "supplier"]:
        raise ValueError(f"staged tables {sorted(found)}")
    return found["supplier"].select("s_suppkey", "s_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_buffered(t):
    """The joined side is made once, in the shared folder."""
    return join(t("nation"), materialised(t("region")), [("n_regionkey", "r_regionkey")]).select("n_name", "r_name")


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total_o_totalprice FROM orders GROUP BY 1")
def sink_summary(t):
    best = writers.best_dimension(t("orders"), ["o_orderstatus"])
    return writers.summary(t("orders"), best, ["o_totalprice"]).withColumn("total_o_totalprice", F.round("total_o_totalprice", 2))


@query("SELECT p_partkey, p_retailprice * 2 AS twice, p_retailprice * 2 + p_size AS more FROM part")
def sink_calculated_columns(t):
    df = writers.with_calculations(t("part"), {"twice": F.col("p_retailprice") * 2, "more": F.col("twice") + F.col("p_size")})
    return df.select("p_partkey", "twice", "more")
