"""Alternatives, overlaps, likeness and sketches against plain Python on odd rows."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import aggregates, joins, similar, sketches, spread


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


A = [(1, 5, "x"), (2, None, "y"), (3, 7, None), (3, 7, None), (4, None, None)]
B = [(5, "x", "p"), (5, "z", "q"), (None, "y", "r"), (7, None, "s"), (None, None, "t")]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_alternatives_make_each_pair_once(spark, how):
    a, b = spark.createDataFrame(A, "id int, u int, v string"), spark.createDataFrame(B, "bu int, bv string, name string")
    got = similar.join_any(a, b, [[("u", "bu")], [("v", "bv")], [("u", "bu"), ("v", "bv")]], how)
    pairs = [(*x, *y) for x in A for y in B if (x[1] is not None and x[1] == y[0]) or (x[2] is not None and x[2] == y[1])]
    alone = [(*x, None, None, None) for x in A if not any(p[:3] == x for p in pairs)]
    assert rows(got) == sorted(pairs + alone * (how == "left"), key=str)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    with pytest.raises(ValueError, match="join"):
        similar.join_any(a, b, [], "full")


@pytest.mark.parametrize("by", [["v"], ["v", "name"], ["bu"], []])
def test_alternatives_counted_as_their_pairs(spark, by):
    a, b = spark.createDataFrame(A * 2, "id int, u int, v string"), spark.createDataFrame(B * 3, "bu int, bv string, name string")
    ways = [[("u", "bu")], [("v", "bv")], [("u", "bu"), ("v", "bv")]]
    pairs = similar.join_any(a, b, ways)
    truth = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("bv").alias("texts"), F.count_distinct("id").alias("ids"))
    got = similar.counted_any(a, b, ways, by, "n", {"names": "name", "texts": "bv", "ids": "id"})
    assert got.dtypes == truth.dtypes and rows(got) == rows(truth)
    none = similar.counted_any(a, b.where("false"), ways, by, "n", {"names": "name"})
    assert rows(none) == ([] if by else [(0, 0)])


def test_pairs_of_a_frequent_key_are_counted_and_not_made(spark):
    """Of 20,000 rows with one key on either side, 400 million pairs."""
    a = spark.range(20_000).select(F.col("id").alias("i"), F.lit(1).alias("k"), (F.col("id") % 2).alias("g"))
    b = spark.range(20_000).select(F.col("id").alias("j"), F.when(F.col("id") >= 5, 1).alias("l"))
    got = similar.counted_any(a, b, [[("k", "l")], [("i", "j")]], ["g"], "n", {"others": "j"})
    assert rows(got) == [(0, 10_000 * 19_995 + 3, 19_998), (1, 10_000 * 19_995 + 2, 19_997)]


@pytest.mark.parametrize("width", [1.0, 3.5, 1000.0])
def test_overlaps_against_all_pairs(spark, width):
    rng = np.random.default_rng(1)
    mine = [(i, float(s), None if i % 13 == 0 else float(s + rng.integers(-1, 9)), int(i % 3)) for i, s in enumerate(rng.integers(-20, 40, 60))]
    other = [(i, float(s), float(s + rng.integers(0, 30)), int(i % 3)) for i, s in enumerate(rng.integers(-20, 40, 30))]
    a, b = spark.createDataFrame(mine, "i int, s double, e double, k int"), spark.createDataFrame(other, "j int, s2 double, e2 double, k2 int")
    whole = [(x[0], y[0]) for x, y in itertools.product(mine, other) if x[2] is not None and x[1] < x[2] and y[1] < y[2] and x[1] < y[2] and y[1] < x[2]]
    got = similar.join_overlap(a, b, ("s", "e"), ("s2", "e2"), width)
    assert rows(got.select("i", "j")) == sorted(whole, key=str) and len(whole) > 100 and "NestedLoop" not in plan(got)
    keyed = similar.join_overlap(a, b, ("s", "e"), ("s2", "e2"), width, [("k", "k2")])
    assert rows(keyed.select("i", "j")) == sorted(((i, j) for i, j in whole if i % 3 == j % 3), key=str)


def test_overlaps_of_days(spark):
    day = dt.date(2024, 1, 1)
    a = spark.createDataFrame([(1, day, day + dt.timedelta(days=40)), (2, None, day)], "i int, s date, e date")
    b = a.toDF("j", "s2", "e2")
    assert rows(similar.join_overlap(a, b, ("s", "e"), ("s2", "e2"), 7 * 86400).select("i", "j")) == [(1, 1)]


def grams(s, n):
    s = s.lower()
    return {s[i : i + n] for i in range(max(1, len(s) - n + 1))}


@pytest.mark.parametrize(("least", "n"), [(0.4, 2), (0.7, 2), (1.0, 2), (0.5, 3), (0.01, 1)])
def test_similar_values_against_all_pairs(spark, least, n):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdé "), rng.integers(0, 12))) for _ in range(70)] + ["", "A", "a", "ABAB", "abab", "same", "same"]
    one, two = texts[:50] + texts[-7:], texts[30:]
    got = similar.similar_values(spark.createDataFrame([(x,) for x in [*one, None]], "a string"), spark.createDataFrame([(x,) for x in [*two, None]], "b string"), "a", "b", least, n)
    found = {(r["a"], r["b"]): r["similarity"] for r in got.collect()}
    assert len(found) == got.count()
    truth = {(x, y): len(grams(x, n) & grams(y, n)) / len(grams(x, n) | grams(y, n)) for x in set(one) for y in set(two)}
    assert found == pytest.approx({p: s for p, s in truth.items() if s >= least - 1e-9})


def test_sketches_of_parts_are_the_sketch_of_the_whole(spark):
    df = spark.range(20_000).select((F.col("id") % 7).cast("int").alias("k"), (F.col("id") % 5000).alias("who"), F.when(F.col("id") % 10 != 0, F.col("id") * 1.0).alias("x"))
    wanted = {"who": ("distinct", "who"), "x": ("quantiles", "x"), "n": ("count", "x"), "low": ("min", "x"), "high": ("max", "x"), "total": ("sum", "x")}
    fine = sketches.pre_aggregated(df, ["k"], wanted)
    whole = sketches.rolled_up(fine, [], wanted).select(sketches.distinct_estimate("who").alias("who"), sketches.quantile_estimate("x", 0.25).alias("q"), "n", "low", "high", "total").first()
    at_once = sketches.pre_aggregated(df, [], wanted).select(sketches.distinct_estimate("who").alias("who")).first()
    assert whole["who"] == at_once["who"] and abs(whole["who"] - 5000) < 250 and abs(whole["q"] - 5000) < 700
    assert (whole["n"], whole["low"], whole["high"], whole["total"]) == (18_000, 1.0, 19_999.0, sum(i for i in range(20_000) if i % 10))


def test_order_statistics_of_many_columns_in_one_pass(spark):
    data = [(k, float(i % 17) if i % 5 else None, float(i * i % 31), None) for i in range(100) for k in (None, "a")] + [("b", None, None, None)]
    df = spark.createDataFrame(data, "k string, x double, y double, z double")
    wanted = {"x50": ("x", 0.5), "y10": ("y", 0.1), "y90": ("y", 0.9), "z50": ("z", 0.5)}
    got = {r["k"]: r for r in spread.order_statistics(df, ["k"], wanted).collect()}
    assert set(got) == {None, "a"}
    for r in got.values():
        xs, ys = [v[1] for v in data if v[0] == "a" and v[1] is not None], [v[2] for v in data if v[0] == "a"]
        assert (r["x50"], r["y10"], r["y90"], r["z50"]) == pytest.approx((np.percentile(xs, 50), np.percentile(ys, 10), np.percentile(ys, 90), None))
    assert spread.order_statistics(df, [], wanted).count() == 1 and spread.order_statistics(df.limit(0), [], wanted).count() == 0
    grouped = aggregates.group(df, ["k"], [("x", "MEDIAN", "mx"), ("y", "MEDIAN", "my"), ("*", "COUNT", "n")])
    assert {r["k"]: r["n"] for r in grouped.collect()} == {None: 100, "a": 100, "b": 1}


def test_sketches_leave_all_relationships(spark, sf_dir, monkeypatch):
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    pairs = joins._alike(tables, 0.3)
    left = joins.likely(tables, pairs)
    found = rows(joins.inferred(tables, alike=0.3))
    with monkeypatch.context() as m:
        m.setattr(joins, "likely", lambda tables, pairs: pairs)
        whole = rows(joins.inferred(tables, alike=0.3))
    assert found == whole and len(found) >= 4 and {r[:4] for r in found} <= {p[:4] for p in left} and len(left) < 0.7 * len(pairs)


def test_sketches_of_odd_columns(spark):
    a = spark.createDataFrame([("", 1), ("x", 2), (None, None)], "code string, other int")
    b = spark.createDataFrame([("", 5), ("x", 5), ("x", 5), ("q", 5)], "a_code string, n int")
    got = joins.column_sketches({"a": a, "b": b}, {("a", "code"), ("a", "other"), ("b", "a_code")})
    assert rows(got.select("table", "column", "rows", F.theta_sketch_estimate("sketch"))) == [("a", "code", 2, 2), ("a", "other", 2, 2), ("b", "a_code", 4, 3)]
    assert [p[:4] for p in joins.likely({"a": a, "b": b}, [("b", "a_code", "a", "code", 1.0), ("a", "code", "b", "a_code", 1.0), ("a", "other", "a", "code", 1.0)])] == [("b", "a_code", "a", "code")]
    assert joins.inferred({"a": a, "b": b}, least=0.9).count() == 0 and rows(joins.inferred({"a": a, "b": b}, least=0.7).select("share")) == [(0.75,)]
