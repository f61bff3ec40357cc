"""Ranks, frames and recursions by ranges against plain Python, with a key that holds most rows and runs that pass over ranges."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.operators import places, spread

SCHEMA = "k string, v int, u int, x double"


@pytest.fixture
def many_ranges(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {c: spark.conf.get(c) for c in settings}
    for c, v in settings.items():
        spark.conf.set(c, v)
    yield
    for c, v in before.items():
        spark.conf.set(c, v)


def sample(seed, n, values):
    rng = np.random.default_rng(seed)
    keys = [str(k) if k else None for k in rng.choice(4, n, p=[0.1, 0.1, 0.1, 0.7])]
    return [(k, None if rng.random() < 0.05 else int(rng.choice(values)), i, None if rng.random() < 0.1 else float(rng.integers(0, 50))) for i, k in enumerate(keys)]


def by(row, descending):
    v = row[1]
    return (v is None, -v if v is not None else 0) if descending else (v is not None, v or 0)


def groups(rows, descending):
    found = {}
    for r in rows:
        found.setdefault(r[0], []).append(r)
    return {k: sorted(some, key=lambda r: (by(r, descending), r[2])) for k, some in found.items()}


def brute_positions(rows, descending, offset):
    out = []
    for some in groups(rows, descending).values():
        values = [r[1] for r in some]
        for i, r in enumerate(some):
            first = values.index(r[1])
            last = len(values) - 1 - values[::-1].index(r[1])
            dense = len({v for v in values[: i + 1]})
            there = some[i + offset][2] if 0 <= i + offset < len(some) else None
            out.append((*r, i + 1, -i, len(some) - 1 - i, len(some), first + 1, dense, last + 1, first / (len(some) - 1) if len(some) > 1 else 0.0, there))
    return sorted(out, key=lambda r: r[2])


@pytest.mark.parametrize(("seed", "values", "descending", "offset"), [(1, range(200), False, -1), (2, [1, 2, 3], True, 4), (3, [7], False, -9), (4, [1] * 30 + [2, 3], True, 300), (5, range(9), False, 0)])
def test_positions_over_ranges(spark, many_ranges, seed, values, descending, offset):
    rows = sample(seed, 400, list(values))
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = {"i": "index", "f": "first", "l": "last", "s": "size", "r": "rank", "d": "dense", "m": "modified", "p": "percent"}
    got = places.positions(df, ["k"], [("v", descending)], wanted, ["u"], [("there", "u", offset)])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == brute_positions(rows, descending, offset)
    assert spread.ranged(df, ["k", "v", "u"]).select("__part").distinct().count() > 4


def test_positions_of_a_whole_table_and_of_none(spark, many_ranges):
    rows = [(None, *r[1:]) for r in sample(6, 300, [1, 2])]
    got = places.positions(spark.createDataFrame(rows, SCHEMA), [], [("v", False)], {"r": "rank", "i": "index"}, ["u"])
    assert sorted((r["u"], r["r"], r["i"]) for r in got.collect()) == sorted((r[2], r[8], r[4]) for r in brute_positions(rows, False, 0))
    assert places.positions(spark.createDataFrame([], SCHEMA), ["k"], [("v", False)], {"r": "rank"}, ["u"], [("b", "x", -1)]).count() == 0
    with pytest.raises(ValueError, match="position"):
        places.positions(got, [], [("v", False)], {"r": "place"})


def test_no_window_holds_a_whole_table(spark, many_ranges):
    got = places.positions(spark.createDataFrame(sample(7, 300, [1, 2]), SCHEMA), [], [("v", False)], {"r": "rank"}, ["u"])
    lines = got._jdf.queryExecution().executedPlan().toString().split("\n")
    below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange SinglePartition" in line]
    assert below and all("Aggregate(key=[__part#" in x for x in below)  # a row for each range
    assert got.count() == 300


@pytest.mark.parametrize("values", [range(200), [1] * 30 + [2, 3], [7]])
def test_ranges_grow_in_number_and_not_in_size(spark, monkeypatch, values):
    """Without settings: 4,000 rows at 100 a range, though they would fit one, and the same places as in ranges of any size."""
    monkeypatch.setattr(spread, "ROWS", 100)
    rows = sample(9, 4000, list(values))
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = [r["count"] for r in spread.ranged(df, ["k", "v", "u"]).groupBy("__part").count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 400
    kept = spread.ranged(df, ["k", "v", "u"], lambda cut: cut.withColumn("task", F.spark_partition_id()))
    assert kept.groupBy("task").agg(F.count_distinct("__part").alias("n")).where("n > 1").count() == 0  # no task meets two ranges
    got = places.positions(df, ["k"], [("v", True)], {"i": "index", "r": "rank", "d": "dense", "m": "modified"}, ["u"], [("there", "u", -3)])
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == [(*r[:5], *r[8:11], r[12]) for r in brute_positions(rows, True, -3)]
    half = spread.percentiles(df, ["k"], "x", {"half": 0.5})
    truth = {k: statistics.median(r[3] for r in some if r[3] is not None) for k, some in groups(rows, False).items()}
    assert {r["k"]: r["half"] for r in half.collect()} == truth


def brute_framed(rows, first, last):
    out = []
    for some in groups(rows, False).values():
        for i, r in enumerate(some):
            frame = some[max(0, i + first) : max(0, i + last + 1)]
            v = sorted(x[3] for x in frame if x[3] is not None)
            at = (len(v) - 1) * 0.8
            p = v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at)) if v else None
            out.append((r[2], statistics.median(v) if v else None, p, len({x[1] for x in frame if x[1] is not None})))
    return sorted(out)


@pytest.mark.parametrize(("first", "last", "block"), [(-5, 2, 16), (-3, 3, 1000), (4, 9, 10), (-30, -7, 8), (0, 0, 5), (-100, 100, 7)])
def test_sliding_frames(spark, first, last, block):
    rows = sample(8, 200, range(6))
    wanted = {"med": ("percentile", "x", 0.5), "p": ("percentile", "x", 0.8), "n": ("countd", "v")}
    got = places.framed(spark.createDataFrame(rows, SCHEMA), ["k"], [("v", False), ("u", False)], first, last, wanted, block)
    assert got.columns == ["k", "v", "u", "x", "med", "p", "n"]
    found = sorted((r["u"], r["med"], r["p"], r["n"]) for r in got.collect())
    for a, b in zip(found, brute_framed(rows, first, last), strict=True):
        assert a[0] == b[0] and a[3] == b[3] and all((x is None) == (y is None) and (x is None or math.isclose(x, y)) for x, y in zip(a[1:3], b[1:3], strict=True))
    assert sorted(map(tuple, got.select("k", "v", "u", "x").collect()), key=lambda r: r[2]) == sorted(rows, key=lambda r: r[2])


@pytest.mark.parametrize(("a", "seed"), [(0.5, 0.0), (1.0, 3.0), (-1.5, 1.0), (40.0, 0.0)])
def test_recursions_are_folded_by_ranges(spark, many_ranges, a, seed):
    rows = sample(9, 500, range(100))
    got = places.previous_affine(spark.createDataFrame(rows, SCHEMA), ["k"], [("v", False), ("u", False)], F.lit(a), F.col("x"), seed, "y")
    found = {r["u"]: r["y"] for r in got.collect()}
    for some in groups(rows, False).values():
        y = seed
        for r in some:
            if r[3] is None:
                assert found[r[2]] is None
                continue
            y = a * y + r[3]
            assert found[r[2]] == y or math.isclose(found[r[2]], y, rel_tol=1e-9, abs_tol=1e-9)
    assert places.previous_affine(spark.createDataFrame([], SCHEMA), ["k"], [("u", False)], F.lit(1.0), F.lit(1.0), 0.0, "y").count() == 0
