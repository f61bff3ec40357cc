"""View filters, measures of measures, parameters and comparisons on odd rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from terrace.functions import scalar as S
from terrace.functions import scripts
from terrace.operators import aggregates as A
from terrace.operators import filters, joins, quality
from terrace.operators import model as M
from terrace.sources import readers


def kept(df, spec):
    return sorted(r["i"] for r in df.where(filters.group_filter(spec)).collect())


def test_parts_of_a_view_filter(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0), (2, None, 3.0), (3, "c", None), (4, None, None)], "i int, s string, x double")
    some = ("members", "s", ["a", None])
    assert kept(df, ("all",)) == [0, 1, 2, 3, 4] and kept(df, some) == [0, 2, 4] and kept(df, ("not", some)) == [1, 3]
    assert kept(df, ("members", "s", [])) == [] and kept(df, ("not", ("range", "x", 2, None))) == [0, 3, 4]
    assert kept(df, ("except", ("union", some, ("range", "x", None, 2)), ("members", "s", ["b"]))) == [0, 2, 4]
    assert kept(df, ("intersect", some, ("range", "x", None, None))) == [0, 2]
    for bad in (("except", some), ("union",), ("every", some)):
        with pytest.raises(ValueError, match="filter"):
            filters.group_filter(bad)


def test_measures_in_any_order(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, None)], "k string, v double")
    base, derived = {"s": F.sum("v"), "n": F.count("v")}, {"twice": (["mean"], F.col("mean") * 2), "mean": (["s", "n"], A.ratio(F.col("s"), F.col("n")))}
    assert sorted(map(tuple, A.with_measures(df, ["k"], base, derived).collect()), key=str) == [("a", 4.0, 2, 4.0, 2.0), (None, None, 0, None, None)]
    with pytest.raises(KeyError, match="no measure"):
        A.with_measures(df, ["k"], base, {"x": (["y"], F.lit(1))})
    with pytest.raises(Exception, match="cycle"):
        A.with_measures(df, ["k"], base, {"x": (["y"], F.lit(1)), "y": (["x"], F.lit(1))})


def test_parameters_are_checked(spark):
    assert spark.range(1).select(M.parameter("7", "int").alias("a"), M.parameter(None, "date", allowed=[None]).alias("b")).first() == (7, None)
    for how in ({"allowed": [1, 2]}, {"low": 4}, {"high": 2}):
        with pytest.raises(ValueError, match="3"):
            M.parameter(3, "int", **how)


def test_days_with_fractions(spark):
    at = dt.datetime(2024, 2, 28, 12)
    got = spark.range(1).select(*[S.date_plus(F.lit(at), n).alias(f"c{i}") for i, n in enumerate((1.5, -0.25, 366, None, 1e12))], S.days_between(F.lit(at), F.lit(dt.date(2024, 2, 27))).alias("d")).first()
    assert tuple(got) == (dt.datetime(2024, 3, 1), dt.datetime(2024, 2, 28, 6), dt.datetime(2025, 2, 28, 12), None, None, 1.5)


def test_predictions_of_rows_without_inputs(spark):
    df = spark.createDataFrame([(1, 2.0, "a"), (2, None, "b"), (3, 4.0, None)], "i int, x double, s string")
    got = scripts.predicted(df, lambda rows: rows.assign(y=rows["x"] * 2, z=rows["s"].str.upper())[["y", "z"]], ["x", "s"], "y double, z string")
    assert got.columns == ["i", "x", "s", "y", "z"] and sorted(tuple(r)[3:] for r in got.collect() if r["y"] is not None) == [(4.0, "A")]
    assert got.where("y is null and z is null").count() == 2


NESTED = "k int, a array<struct<x:double,t:string>>, m map<string,double>, s struct<u:int,v:array<int>>, d double, t string"


def differences(spark, one, two, tolerance=0.0):
    a, b = (spark.createDataFrame(r, NESTED) for r in (one, two))
    return sorted((tuple(r) for r in quality.compare_deep(a, b, ["k"], tolerance).collect()), key=str)


def test_nested_values_are_compared_to_the_leaf(spark):
    base = (1, [(1.0, "q"), (2.0, None)], {"a": 1.0, "b": 2.0}, (1, [1, 2]), math.nan, "x")
    assert differences(spark, [base, (None, None, None, None, None, None)], [base, (None, None, None, None, None, None)]) == []
    changed = [
        (1, [(1.0, "q"), (2.0, "w")], {"b": 2.0, "a": 1.0}, (1, [1, 2]), math.nan, "x"), (1, [(1.0, "q")], {"a": 1.0, "c": 2.0}, (1, [2, 1]), 1.0, None), (1, [(1.0 + 1e-9, "q"), (2.0, None)], {"a": 1.0, "b": 2.0 + 1e-9}, (1, None), math.nan, "X"),
    ]
    assert [c for _, c, _ in differences(spark, [base], [changed[0]])] == ["a"]
    assert [c for _, c, _ in differences(spark, [base], [changed[1]])] == ["a", "d", "m", "s", "t"]
    assert [c for _, c, _ in differences(spark, [base], [changed[2]])] == ["a", "m", "s", "t"] and [c for _, c, _ in differences(spark, [base], [changed[2]], 1e-6)] == ["s", "t"]
    assert differences(spark, [base], [(2, *base[1:])]) == [(1, None, "missing"), (2, None, "extra")]
    with pytest.raises(TypeError, match="types differ"):
        quality.compare_deep(spark.createDataFrame([base], NESTED), spark.createDataFrame([base], NESTED).withColumn("t", F.lit(1)), ["k"])


def test_counts_and_fingerprints(spark):
    a, b = spark.createDataFrame([("x",), ("x",), (None,)], "k string"), spark.createDataFrame([("x",), ("y",)], "k string")
    assert sorted(map(tuple, quality.row_counts(a, b, ["k"], 0.5).collect()), key=str) == [("x", 2, 1, True), ("y", 0, 1, False), (None, 1, 0, False)]
    assert tuple(quality.row_counts(a, b, []).first()) == (3, 2, False)
    prints = [quality.fingerprint(df).first()["fingerprint"] for df in (a, a.orderBy("k"), a.distinct(), b, a.limit(0))]
    assert prints[0] == prints[1] and len(set(prints)) == 4
    assert quality.renamed_by_values(a, a.withColumnRenamed("k", "j")).collect()[0] == ("k", "j", 1.0) and quality.renamed_by_values(a, a).count() == 0
    assert joins.blend(a, b.withColumn("n", F.lit(1)), [], {}).count() == 5


def test_texts_read_as_dates_have_a_year_of_sql(spark):
    dates = ["1000", "9999", "2024-02-29", "2024-2", "0001-01-01", "2024-05-06 07:08"]
    others = ["10000", "123456", "9999999", "10000-01-01", "-2024", "-2024-01-01", "0000", "0000-05-01", "999", "2023-02-29", "", "x"]
    for texts, expected in ((dates, 1.0), (others, 0.0), ([None, None], 0.0), (["1234", "12345", None, "99999"], 0.25)):
        df = spark.createDataFrame([(t,) for t in texts], "s string")
        found = quality.coercions(df, ["s"]).first()
        assert (found["column_name"], found["as_date"]) == ("s", expected)


def test_rows_that_meet_a_list_are_not_dealt_by_its_values(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(1000).select(F.when(F.col("id") % 4 < 3, F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("id") % 4 + 1).cast("int"))).alias("s"))
        for chosen in (M.list_table(spark, [("F", "finished"), ("O", "open"), ("O", "not done")]), readers.inline(spark, [("F", "finished"), ("O", "open"), ("O", "not done")], "value string, alias string")):
            met = rows.join(chosen, F.col("s") == F.col("value"))
            assert sorted(map(tuple, met.groupBy("alias").count().collect())) == [("finished", 250), ("not done", 250), ("open", 250)]
            assert "Exchange hashpartitioning" not in met._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
