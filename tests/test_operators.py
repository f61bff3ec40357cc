"""Edge cases of the operators: nulls, ties, empty tables, names."""

import datetime as dt
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.functions import scalar as S
from terrace.operators import aggregates as A
from terrace.operators import analytics as N
from terrace.operators import cleaning as K
from terrace.operators import columns as C
from terrace.operators import filters as X
from terrace.operators import joins as J
from terrace.operators import model as M
from terrace.operators import quality as Q
from terrace.operators import reshape as R
from terrace.operators import spread
from terrace.operators import tablecalc as W
from terrace.plans.flow import Flow
from terrace.sources import readers, writers
from terrace.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names_with_dots_and_case(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c"])
    assert C.keep(df, ["a.b"]).columns == ["a.b"]
    with pytest.raises(ValueError):
        C.rename(df, {"c": "A.B"})


def test_index_of_an_empty_and_a_large_table(spark):
    empty = spark.range(0)
    assert C.add_index(empty, "i", ["id"]).count() == 0
    df = C.add_index(spark.range(10_000).withColumn("k", F.hash("id")), "i", ["k", "id"])
    expected = [i + 1 for i in range(10_000)]
    assert [r["i"] for r in df.orderBy("k", "id").collect()] == expected


def test_filters_and_null(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    x = F.col("x")
    assert rows(df.where(X.exclude_values(x, [1])), "x") == [(2,), (None,)]
    assert rows(df.where(X.outside(x, 1, 1)), "x") == [(2,), (None,)]
    assert rows(df.where(X.outside(x)), "x") == [(1,), (2,)]
    assert rows(df.where(X.remove_if(x == 1)), "x") == [(2,), (None,)]


@pytest.mark.parametrize(
    ("period", "which", "count", "inside", "before", "after"),
    [
        ("month", "last", 2, "2024-02-01", "2024-01-31", "2024-04-01"),
        ("year", "this", 1, "2024-01-01", "2023-12-31", "2025-01-01"),
        ("week", "next", 1, "2024-03-18", "2024-03-17", "2024-03-25"),
        ("day", "last", 1, "2024-03-15", "2024-03-14", "2024-03-16"),
    ],
)
def test_relative_dates(spark, period, which, count, inside, before, after):
    anchor = F.lit(dt.datetime(2024, 3, 15, 7))
    got = [one(spark, X.relative_date(F.lit(d).cast("timestamp"), anchor, period, which, count)) for d in (inside, before, after)]
    assert got == [True, False, False]


def test_joins_and_null_keys(spark):
    a = spark.createDataFrame([(1,), (None,)], "x int")
    b = spark.createDataFrame([(1,), (None,)], "y int")
    assert J.join(a, b, [("x", "y")]).count() == 1
    assert J.join(a, b, [("x", "y")], nulls_match=True).count() == 2
    assert rows(J.join(a, b, [("x", "y")], "notInner"), "x", "y") == [(None, None), (None, None)]


def test_range_join_counts_each_pair_once(spark):
    points = spark.createDataFrame([(float(i),) for i in range(-5, 30)], "p double")
    spans = spark.createDataFrame([(0, 0.0, 12.0), (1, -3.0, 4.5), (2, 7.0, 7.0)], "s int, low double, high double")
    got = rows(J.range_join(points, spans, "p", "low", "high", 5.0), "p", "s")
    expected = sorted(((float(i), s) for i in range(-5, 30) for s, low, high in [(0, 0, 12), (1, -3, 4.5), (2, 7, 7)] if low <= i < high), key=str)
    assert got == expected


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 6, 60)], "k string, u int, v int")
    assert rows(J.as_of(left, right, "k", "t", "u", ["v"]), "k", "t", "v") == [("a", 1, None), ("a", 5, 50), ("b", 9, None)]


def test_as_of_by_bucket_is_the_same(spark):
    left = spark.createDataFrame([("a", i) for i in range(0, 60, 3)] + [("b", 7), (None, 8), ("c", None)], "k string, t int")
    right = spark.createDataFrame([("a", i, i * 10) for i in (5, 5, 17, 31, 40)] + [("a", 5, 7), ("b", 9, 1), (None, 1, 2), ("c", None, 3)], "k string, u int, v int")
    plain = rows(J.as_of(left, right, "k", "t", "u", ["v"]), "k", "t", "v")
    assert plain == rows(J.as_of(left, right, "k", "t", "u", ["v"], lambda t: F.floor(t / 10)), "k", "t", "v")
    assert {("a", 3, None), ("a", 6, 50), ("a", 30, 170), ("a", 57, 400), ("b", 7, None), (None, 8, None), ("c", None, None)} <= set(plain)
    assert J.as_of(left.limit(0), right, "k", "t", "u", ["v"], lambda t: F.floor(t / 10)).count() == 0


def test_blend_does_not_multiply(spark):
    a = spark.createDataFrame([(1, 10), (1, 20)], "k int, x int")
    b = spark.createDataFrame([(1, 1), (1, 2)], "k int, y int")
    assert rows(J.blend(a, b, [("k", "k")], {"s": F.sum("y")}), "x", "s") == [(10, 3), (20, 3)]


def test_fixed_over_null_keys_and_distinct_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 4)], "k string, v int")
    assert rows(A.fixed(df, ["k"], F.sum("v"), "s"), "v", "s") == [(1, 3), (2, 3), (4, 4)]
    df = spark.createDataFrame([("v", "a", 1), ("v", "a", 1), ("v", "b", 8)], "view string, k string, x int")
    assert rows(A.fixed_then(df, ["view"], ["k"], F.sum("x"), F.avg, "m"), "m") == [(5.0,)]


def test_window_percentile_and_rank_modified(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 20.0), (4, 40.0)], "i int, v double")
    w = Window.orderBy("i")
    got = df.select("i", W.window_median(F.col("v"), w, -1, 0).alias("m"), W.rank_modified(Window.orderBy("v")).alias("r")).orderBy("i").collect()
    assert [(r["m"], r["r"]) for r in got] == [(10.0, 1), (15.0, 3), (20.0, 3), (30.0, 4)]


def test_union_widens_and_refuses(spark):
    a, b = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(1.5, "y")], "x double, z string")
    assert rows(R.union([a, b]), "x", "z") == [(1.0, None), (1.5, "y")]
    with pytest.raises(TypeError):
        R.union([a, spark.createDataFrame([("s",)], "x string")])


def test_drop_last_and_skip(spark):
    assert rows(R.drop_last(spark.range(5), [F.col("id")], 2), "id") == [(0,), (1,), (2,)]
    assert rows(R.skip(spark.range(5), [F.col("id")], 3), "id") == [(3,), (4,)]


@pytest.mark.parametrize(
    ("make", "value"),
    [
        (lambda: S.divide(F.lit(1), 0), None), (lambda: S.modulo(F.lit(-7), 3), -1), (lambda: S.sqrt(F.lit(-1.0)), None), (lambda: S.ln(F.lit(0.0)), None), (lambda: S.to_int(F.lit("3.9")), 3), (lambda: S.to_int(F.lit("x")), None),
        (lambda: S.to_int(F.lit(-3.9)), -3), (lambda: S.find_nth(F.lit("a.b.c"), ".", 2), 4), (lambda: S.find_nth(F.lit("a.b"), ".", 2), 0), (lambda: S.split(F.lit("a-b"), "-", 5), ""), (lambda: S.starts_with(F.lit("  ab"), "a"), True),
        (lambda: S.regexp_extract(F.lit("ab"), "(x)"), None), (lambda: S.make_date(F.lit(2023), F.lit(2), F.lit(30)), None), (lambda: S.date_add("month", 1, F.lit(dt.date(2024, 1, 31))), dt.date(2024, 2, 29)),
        (lambda: S.date_diff("week", F.lit(dt.date(2024, 3, 17)), F.lit(dt.date(2024, 3, 18))), 1), (lambda: S.least_of(F.lit(1), F.lit(None).cast("int")), None), (lambda: S.isdate(F.lit("2024-02-30")), False),
        (lambda: S.iif(F.lit(None).cast("boolean"), 1, 2, 3), 3), (lambda: K.after(F.lit("a#b#c"), "#"), "b#c"), (lambda: K.replace_value(F.lit(None).cast("string"), None, "n"), "n"), (lambda: M.in_set(F.lit(None).cast("string"), ["a", None]), True),
        (lambda: M.bins(F.lit(-3), 5), -5), (lambda: S.date_trunc("week", F.lit(dt.datetime(2024, 3, 17, 9)), 7), dt.datetime(2024, 3, 17)), (lambda: S.date_part("iso-year", F.lit(dt.date(2024, 12, 31))), 2025),
    ],
)
def test_scalars(spark, make, value):
    assert one(spark, make()) == value


def test_row_security_without_a_grant(spark):
    df = spark.createDataFrame([("a",), (None,)], "v string")
    assert M.secured(df, "v", "nobody", {"ann": ["a"]}).count() == 0


def test_compare_misses(spark):
    e = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, v double")
    a = spark.createDataFrame([("a", 1.005), ("b", None), ("d", 4.0)], "k string, v double")
    assert rows(Q.compare(e, a, ["k"], "v"), "k", "ok") == [("a", True), ("b", True), ("c", False), ("d", False)]


def test_drift_and_names(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(1.0, "x")], "a double, c string")
    assert Q.schema_drift(a, b) == {"added": [], "removed": [], "renamed": [("b", "c")], "retyped": [("a", "int", "double")]}
    assert Q.settings_drift({"h": 1}, {"h": 2, "p": 3}) == {"added": ["p"], "removed": [], "changed": ["h"]}
    assert Q.name_similarity("orders", "Orders") == 1.0
    assert J.active_edges([("a", "b"), ("b", "c"), ("a", "c")]) == [True, True, False]


def test_flow_errors_and_lineage(spark):
    flow = Flow({"a": spark.range(3)}).step("b", lambda a: a.where("id > 0"), "a").step("c", lambda a, b: a.join(b, "id"), "a", "b")
    assert flow.results(["c"])["c"].count() == 2
    assert flow.lineage() == {"b": {"a"}, "c": {"a"}}
    assert flow.profile() == {"inputs": 1, "steps": 2, "outputs": 1, "depth": 2}
    with pytest.raises(KeyError):
        Flow({}).step("b", lambda a: a, "gone").results(["b"])
    from graphlib import CycleError

    with pytest.raises(CycleError):
        Flow({}).step("b", lambda a: a, "c").step("c", lambda a: a, "b").results(["b"])


def test_sources(spark, tmp_path):
    with pytest.raises(readers.UnknownSource):
        readers.read(spark, "nothing")
    assert readers.jdbc_options("postgresql", "h", "d", "t", split=("id", 0, 9, 3))["url"] == "jdbc:postgresql://h:5432/d"
    assert readers.templated({"url": "x/${DB}"}, {"DB": "y"}) == {"url": "x/y"}
    with pytest.raises(KeyError):
        readers.templated({"url": "${NO}"}, {})
    (tmp_path / "a.csv").write_text("k;v\n1;x\n2;y\n")
    (tmp_path / "b.csv").write_text("k;v\n3;z\n")
    assert rows(readers.wildcard_union(spark, f"{tmp_path}/*.csv", ";"), "k", "v") == [(1, "x"), (2, "y"), (3, "z")]
    assert readers.delimiter(spark, f"{tmp_path}/a.csv") == ";"
    geo = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"n":1},"geometry":{"type":"Point","coordinates":[1,2]}}]}'
    (tmp_path / "g.json").write_text(geo)
    assert readers.geojson(spark, f"{tmp_path}/g.json").first()["n"] == 1


def test_replace_partitions_keeps_the_others(spark, tmp_path):
    path = f"{tmp_path}/p"
    writers.write_file(spark.createDataFrame([(1, "a"), (2, "b")], "v int, k string"), path, partition_by=["k"])
    writers.replace_partitions(spark.createDataFrame([(9, "b")], "v int, k string"), path, ["k"])
    assert rows(spark.read.parquet(path), "v", "k") == [(1, "a"), (9, "b")]


def test_upsert_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string").write.parquet(src)
    got = []
    stream = incremental.watch(spark, src, spark.read.parquet(src).schema)
    incremental.upsert(stream, ["k"], lambda batch, n: got.extend(batch.collect()), f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["k"] for r in got) == [1, 2]
    assert incremental.date_column(["id", "created_at", "updated_at"]) == "updated_at"


def test_web_service_pages_and_links(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2])
            rows = [{"id": 10 * page + i, "name": None if i else f"p{page}", "ok": i == 0, "tags": [i]} for i in range(2)]
            answer = {"value": rows} | ({"@odata.nextLink": f"/rows?page={page + 1}"} if page < 3 else {})
            body = json.dumps(answer).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url, schema = f"http://127.0.0.1:{server.server_port}/rows?page=", "id bigint, name string, ok boolean, tags string, missing double"
    expected = [(10 * p + i, None if i else f"p{p}", i == 0, f"[{i}]", None) for p in (1, 2, 3) for i in range(2)]
    try:
        linked = readers.read(spark, "odata", url=url + "1", schema=schema)
        paged = readers.read(spark, "odata", url=url + "{page}", schema=schema, pages=3)
        assert rows(linked, "*") == rows(paged, "*") == sorted(expected, key=str)
        assert paged.rdd.getNumPartitions() == 3
    finally:
        server.shutdown()


def test_forecast_of_short_and_null_series(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, None), ("b", 3, 3.0), ("c", 1, None)], "k string, i int, v double")
    got = rows(N.forecast(df, ["k"], "i", "v", 2), "k", "step", "forecast")
    assert got == [("a", 1, 2.0), ("a", 2, 2.0), ("b", 1, 2.3), ("b", 2, 2.6)]
    assert N.forecast(df.limit(0), ["k"], "i", "v", 2).count() == 0


def test_types_widen(spark):
    assert [Q.widened(*p) for p in (("int", "bigint"), ("double", "int"), ("date", "timestamp"), ("boolean", "int"), ("string", "int"), ("date", "date"))] == ["bigint", "double", "timestamp", "string", "string", "date"]
    a, b = spark.createDataFrame([("1",), (None,)], "x string"), spark.createDataFrame([(1,), (2,)], "y int")
    assert rows(J.aligned_join(a, b, [("x", "y")]), "x", "y") == [("1", "1")]
    with pytest.raises(ValueError):
        J.inferred({"a": a, "b": b})


def test_latest_row_of_a_batch(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 7, "new"), (2, 1, None)], "k int, at int, v string")
    assert rows(incremental.latest(df, ["k"], ["at"]), "k", "v") == [(1, "new"), (2, None)]
    assert incremental.latest(df, ["k"], ["at"]).columns == df.columns
    assert incremental.latest(df.select("k"), ["k"], []).count() == 2


def test_whole_numbers_stay_exact(spark):
    big = 9_007_199_254_740_993
    assert one(spark, S.div(F.lit(big), 1)) == big and one(spark, S.to_int(F.lit(str(big)))) == big
    assert one(spark, S.div(F.lit(-7), 2)) == -3 and one(spark, S.div(F.lit(7), 0)) is None
    assert one(spark, S.to_int(F.lit("3.7"))) == 3 and one(spark, S.to_int(F.lit("x"))) is None
    assert one(spark, S.make_time(F.lit(24), F.lit(0), F.lit(0))) is None and one(spark, S.make_datetime(*[F.lit(x) for x in (2023, 2, 30, 0, 0, 0)])) is None


def test_promote_headers_keeps_rows_that_equal_the_names(spark):
    df = spark.createDataFrame([(1, "id", "name"), (2, "jd", "b"), (3, "id", "name"), (4, "kc", "d")], "at int, a string, b string")
    got = C.promote_headers(df, ["at"])
    assert got.columns == ["1", "id", "name"] and rows(got, "id", "name") == [("id", "name"), ("jd", "b"), ("kc", "d")]
    with pytest.raises(ValueError):
        C.promote_headers(df.limit(0), ["at"])
    demoted = C.demote_headers(df, "position")
    assert demoted.orderBy("position").first()[0] == "at" and demoted.where("position = 1").count() == 4


def test_percentiles_of_hot_and_null_groups(spark):
    data = [("a", float(i % 50)) for i in range(1000)] + [("b", 1.0), ("b", 4.0), ("b", None), (None, 7.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = rows(spread.percentiles(df, ["k"], "v", {"lo": 0.1, "mid": 0.5, "top": 1.0}), "k", "lo", "mid", "top")
    plain = df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in (("lo", 0.1), ("mid", 0.5), ("top", 1.0))])
    assert [tuple(x) for x in got] == [tuple(x) for x in rows(plain, "k", "lo", "mid", "top")] and len(got) == 3
    assert rows(spread.percentiles(df, [], "v", {"mid": 0.5}), "mid") == [(24.0,)]
    assert spread.percentiles(df.limit(0), ["k"], "v", {"mid": 0.5}).count() == 0
    med = rows(A.group(df, ["k"], [("v", "MEDIAN", "m"), ("v", "COUNT", "n")]), "k", "m", "n")
    assert ("c", None, 0) in med and ("b", 2.5, 2) in med


def test_running_totals_by_ranges(spark):
    df = spark.createDataFrame([("a", i, None if i % 7 == 0 else float(i)) for i in range(300)] + [("b", 1, 2.0), (None, 1, 3.0), ("c", 1, None)], "k string, i int, v double")
    w = Window.partitionBy("k").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    plain = df.withColumn("t", F.sum("v").over(w))
    assert rows(spread.running_total(df, ["k"], ["i"], F.col("v"), "t"), "k", "i", "t") == rows(plain, "k", "i", "t")


def test_inferred_by_names_and_values(spark):
    sales = spark.createDataFrame([(1, 10, "x"), (2, 10, "y"), (3, 11, None), (4, None, "x")], "sale_id int, customer_id int, code string")
    customer = spark.createDataFrame([(10, "n"), (11, "m"), (12, "k")], "id bigint, label string")
    got = J.inferred({"sales": sales, "customer": customer})
    assert rows(got, "child", "child_column", "parent", "parent_column", "share") == [("sales", "customer_id", "customer", "id", 1.0)]


def test_cross_of_two_large_tables_is_an_error(spark):
    a, b = spark.range(5).toDF("a"), spark.range(30).toDF("b")
    assert J.cross(a, b, 5).columns == ["a", "b"] == J.cross(b, a, 5).select("a", "b").columns and J.cross(a, b, 5).count() == 150
    with pytest.raises(ValueError):
        J.cross(a, b, 4)


def test_regex_and_nth_of_odd_texts(spark):
    df = spark.createDataFrame([("a.b\\Ec\\Ed",), ("",), (None,)], "s string")
    got = df.select(S.find_nth(F.col("s"), "\\E", 2).alias("n"), S.regexp_extract(F.col("s"), "(z*)", 1).alias("e"), S.regexp_extract(F.col("s"), "(q)", 1).alias("q")).collect()
    assert [tuple(r) for r in got] == [(7, "", None), (0, "", None), (None, None, None)]


def workbook(path, shared, sheets):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{x}</t></si>" for x in shared) + "</sst>")
        for i, sheet in enumerate(sheets, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")


def test_excel_sheets_are_read(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="inlineStr"><is><t>when</t></is></c></row>'
    body = '<row r="2"><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>2024-02-03</t></is></c></row><row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1.5</v></c></row>'
    for name in "ab":
        workbook(tmp_path / f"{name}.xlsx", ["id", "price", "no number"], ["", head + body])
    got = readers.read(spark, "excel", path=f"{tmp_path}/*.xlsx", schema="id int, price double, `at day` date", sheet=2)
    assert [tuple(r) for r in got.orderBy(F.desc_nulls_last("id")).collect()] == [(7, None, dt.date(2024, 2, 3))] * 2 + [(None, 1.5, None)] * 2


def test_bridged_kinds_name_their_driver(spark):
    assert not set(readers.BRIDGED) & set(readers.JDBC)
    with pytest.raises(Exception, match="NoSuch|ClassNotFound|not.found|driver"):
        readers.read(spark, "essbase", url="jdbc:nowhere:x", driver="no.such.Driver", dbtable="t")


def test_buckets_of_a_written_table_spare_the_shuffle(spark):
    names = [f"bucketed_{uuid.uuid4().hex}" for _ in range(2)]
    for n in names:
        writers.write_table(spark.range(100).select("id", (F.col("id") % 3).alias("v")), n, bucket_by=["id"], buckets=4)
    joined = spark.table(names[0]).hint("merge").join(spark.table(names[1]), "id")
    assert joined.count() == 100 and "Exchange hashpartitioning(id" not in joined._jdf.queryExecution().executedPlan().toString()
    for n in names:
        spark.sql(f"DROP TABLE {n}")


def test_user_domain(spark):
    assert one(spark, M.user_domain("corp\\ann")) == "corp" and one(spark, M.user_domain("ann")) == ""


def test_relationships_are_resolved_and_diagnosed(spark):
    assert J.resolve(["Order ID", "order_date"], "[Orders].[order_id]") == "Order ID"
    assert J.resolve(["a b", "a_b"], "AB") is None and J.resolve(["a b", "a_b"], "a_b") == "a_b" and J.resolve([], "x") is None
    edges = [("sales", "customer"), ("customer", "city"), ("sales", "city")]
    assert J.join_path(edges[:2], "city", "sales") == ["city", "customer", "sales"] and J.join_path(edges, "city", "sales") == ["city", "sales"]
    assert J.join_path(edges, "city", "other") is None
    empty = lambda ddl: spark.createDataFrame([], ddl)
    tables = {"sales": empty("id int, customer_id int, city string"), "customer": empty("id bigint, city string"), "city": empty("name string, code int"), "log": empty("at date")}
    found = J.diagnose(tables, [("sales", "Customer ID", "customer", "id"), ("customer", "city", "city", "name"), ("sales", "city", "city", "code"), ("sales", "x", "shop", "id")])
    assert found == [("types do not compare", "sales.city -> city.code"), ("no such column", "sales.x"), ("no such table", "shop"), ("second path", "sales.city -> city.code"), ("joined by nothing", "log")]


def test_measures_are_checked_across_models():
    models = {"a": {"total": "SUM(x)", "mean": "AVG(x)"}, "b": {"total": "sum( x )", "mean": "SUM(x) / COUNT(x)"}, "c": {}}
    assert Q.definition_conflicts(models) == [("mean", ["a", "b"])]
    assert Q.unmet({"share": ["total", "whole"], "total": ["x"]}, ["x"]) == [("share", "whole")]
    with pytest.raises(Exception, match="cycle"):
        Q.unmet({"a": ["b"], "b": ["a"]}, [])
