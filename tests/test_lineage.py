"""Column lineage: what it says is what changes when a source's column is changed."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.plans.flow import Flow
from terrace.plans.lineage import closure, column_lineage, marked

A = [(i, i % 3, f"t{i % 4}", i * 1.5) for i in range(12)]
B = [(i, f"n{i}", i * 10) for i in range(3)]


def sources(spark, a=None, b=None):
    return {"a": a or spark.createDataFrame(A, "id int, k int, s string, v double"), "b": b or spark.createDataFrame(B, "kb int, name string, w int")}


def by_order(df):
    return df.withColumn("r", F.row_number().over(Window.partitionBy("s").orderBy("v")))


STEPS = {
    "joined": (lambda a, b: a.join(b, F.col("k") == F.col("kb")).where("w < 15").select("id", F.upper("name").alias("n"), (F.col("v") + F.col("w")).alias("x")), "a", "b"),
    "grouped": (lambda a: a.groupBy("k").agg(F.sum("v").alias("total"), F.count("*").alias("n")), "a"),
    "both": (lambda a, b: a.select("id", F.col("s").alias("t")).union(b.select("kb", "name")), "a", "b"),
    "ranked": (by_order, "a"),
    "top": (lambda a: a.orderBy("v").limit(4).select("id"), "a"),
    "kept": (lambda a, b: a.join(b.where("w > 0"), F.col("k") == F.col("kb"), "left_semi").select("id", "s"), "a", "b"),
    "twice": (lambda a: a.alias("p").join(a.alias("q"), F.col("p.id") == F.col("q.k")).select(F.col("p.s").alias("s"), F.col("q.v").alias("v")), "a"),
    "parts": (lambda a: a.select("id", F.explode(F.split("s", "")).alias("letter")), "a"),
    "script": (lambda a: a.select("id", "v").mapInPandas(lambda frames: (f.assign(y=f["v"] * 2)[["y"]] for f in frames), "y double"), "a"),
    "unique": (lambda a: a.select("k", "s").distinct(), "a"),
    "rolled": (lambda a: a.rollup("k", "s").agg(F.max("v").alias("m")), "a"),
}
SAID = {
    "joined": ({"id": {"a::id"}, "n": {"b::name"}, "x": {"a::v", "b::w"}}, {"a::k", "b::kb", "b::w"}),
    "grouped": ({"k": {"a::k"}, "total": {"a::v"}, "n": set()}, {"a::k"}),
    "both": ({"id": {"a::id", "b::kb"}, "t": {"a::s", "b::name"}}, set()),
    "ranked": ({"id": {"a::id"}, "k": {"a::k"}, "s": {"a::s"}, "v": {"a::v"}, "r": {"a::s", "a::v"}}, set()),
    "top": ({"id": {"a::id"}}, {"a::v"}),
    "kept": ({"id": {"a::id"}, "s": {"a::s"}}, {"a::k", "b::kb", "b::w"}),
    "twice": ({"s": {"a::s"}, "v": {"a::v"}}, {"a::id", "a::k"}),
    "parts": ({"id": {"a::id"}, "letter": {"a::s"}}, {"a::s"}),
    "script": ({"y": {"a::id", "a::v"}}, {"a::id", "a::v"}),
    "unique": ({"k": {"a::k"}, "s": {"a::s"}}, {"a::k", "a::s"}),
    "rolled": ({"k": {"a::k"}, "s": {"a::s"}, "m": {"a::v"}}, {"a::k", "a::s"}),
}


def flow(given):
    out = Flow(given)
    for name, (fn, *inputs) in STEPS.items():
        out.step(name, fn, *inputs)
    return out


@pytest.mark.parametrize("step", STEPS)
def test_lineage_of_a_step(spark, step):
    assert flow(sources(spark)).column_lineage(step) == SAID[step]


def changed(df, c):
    kind = dict(df.dtypes)[c]
    return df.withColumn(c, F.concat(F.col(c), F.lit("zz")) if kind == "string" else (F.col(c) * -3 + 1).cast(kind))


def column(df, c):
    return sorted((r[c] for r in df.select(c).collect()), key=str)


@pytest.mark.parametrize("step", STEPS)
def test_no_other_column_changes_a_result(spark, step):
    given = sources(spark)
    values, rows = flow(given).column_lineage(step)
    before = flow(given).results([step])[step].cache()
    for name, df in given.items():
        for c in df.columns:
            after = flow(given | {name: changed(df, c)}).results([step])[step].cache()
            for out, made in values.items():
                if f"{name}::{c}" not in made | rows:
                    assert column(after, out) == column(before, out), (name, c, out)


def test_lineage_over_several_flows(spark):
    first = Flow(sources(spark)).step("mid", STEPS["joined"][0], "a", "b")
    second = Flow({"mid": first.results(["mid"])["mid"]}).step("end", lambda m: m.groupBy("n").agg(F.sum("x").alias("total")), "mid")
    edges = {f"mid::{c}": made for c, made in first.column_lineage("mid")[0].items()} | {f"end::{c}": made for c, made in second.column_lineage("end")[0].items()}
    assert closure(edges)["end::total"] == {"mid::x", "a::v", "b::w"} and closure(edges)["end::n"] == {"mid::n", "b::name"}


def test_lineage_of_sql_and_odd_names(spark):
    df = marked("odd", spark.createDataFrame([(1, 2)], "`a b` int, `c.d` int"))
    got = spark.sql("SELECT `a b` + 1 AS x, CASE WHEN `c.d` > 0 THEN 1 END AS y FROM {t} WHERE `a b` > 0", t=df)
    assert column_lineage(got) == ({"x": {"odd::a b"}, "y": {"odd::c.d"}}, {"odd::a b"})
