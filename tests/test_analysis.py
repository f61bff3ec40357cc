"""Forecasts, reference lines and geometry on odd rows."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import geometry as G
from terrace.functions import scalar as S
from terrace.operators import analytics as N


def plain_errors(values, m, a, b, c):
    level, slope = np.mean(values[:m]), (np.mean(values[m : 2 * m]) - np.mean(values[:m])) / m
    season, total = [v - level for v in values[:m]], 0.0
    for i in range(m, len(values)):
        s, v = season[i % m], values[i]
        total += (v - level - slope - s) ** 2
        before, level = level, a * (v - s) + (1 - a) * (level + slope)
        slope = b * (level - before) + (1 - b) * slope
        season[i % m] = c * (v - level) + (1 - c) * s
    return total


def test_fit_takes_the_least_errors_of_the_grid():
    rng = np.random.default_rng(1)
    for m in (2, 4):
        values = [10 + 0.5 * i + 4 * math.sin(2 * math.pi * i / m + 1) + rng.normal() for i in range(9 * m)]
        grid = [(a, b, c) for a in N.GRID[0] for b in N.GRID[1] for c in N.GRID[2]]
        assert N.fitted_parameters(values, m) == min(grid, key=lambda p: plain_errors(values, m, *p))


def test_forecast_of_a_pure_season_is_exact(spark):
    rows = [("a", i, 2.0 * i + (5, -1, 0)[i % 3]) for i in range(15)] + [("short", i, 3.0 * i) for i in range(4)] + [("one", 1, 7.0), ("a", 99, None), (None, 1, 1.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    got = {(r["k"], r["step"]): r for r in N.seasonal_forecast(df, ["k"], "i", "v", 4, 3, (0.5, 0.1, 0.1)).collect()}
    assert len(got) == 16
    assert [got["short", h]["forecast"] for h in range(1, 5)] == [12, 15, 18, 21] and got["one", 4]["forecast"] == 7 and got[None, 2]["high"] == 1
    for h in range(1, 5):
        assert abs(got["a", h]["forecast"] - (2.0 * (14 + h) + (5, -1, 0)[(14 + h) % 3])) < 4
        assert got["a", h]["low"] <= got["a", h]["forecast"] <= got["a", h]["high"]
    widths = [got["a", h]["high"] - got["a", h]["low"] for h in range(1, 5)]
    assert widths == sorted(widths)


def test_reference_lines_of_panes_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), (None, 2.0), (None, 4.0), ("b", None)], "k string, v double")
    wanted = {"mode": "mode", "target": ("constant", 9), "mid": "median", "n": "count", "hi": ("deviations", 2)}
    got = {r["k"]: tuple(r)[1:4] for r in N.reference_set(df, "v", wanted, ["k"]).collect()}
    assert got == {"a": (1.0, 9, 1.0), None: (2.0, 9, 3.0), "b": (None, 9, None)}
    assert tuple(N.reference_set(df, "v", {"mode": "mode", "mid": "median"}).first()) == (1.0, 2.0)
    assert N.reference_set(df.limit(0), "v", {"mode": "mode", "mid": "median", "top": "max"}).collect()[0]["top"] is None
    with pytest.raises(ValueError, match="line"):
        N.reference_set(df, "v", {"x": "average"})
    bands = N.banded(df, "v", ["min", ("constant", 2.0), "max"]).collect()
    assert sorted(str((r["v"], r["band"])) for r in bands) == sorted(str(x) for x in [(1.0, 1), (1.0, 1), (3.0, 2), (None, None), (2.0, 2), (4.0, 3), (None, None)])


def test_clock_is_one_for_all_rows(spark):
    got = spark.range(3).select(S.now().alias("n"), S.today().alias("d"), S.today(dt.datetime(2020, 2, 29, 23, 59)).alias("x")).distinct().collect()
    assert len(got) == 1 and got[0]["n"].date() == got[0]["d"] and got[0]["x"] == dt.date(2020, 2, 29)


def ring(*points):
    return G.make_line(*[G.make_point(F.lit(x), F.lit(y)) for x, y in points])


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_areas_lengths_and_rings(spark):
    square, notch = ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))
    assert one(spark, G.area(square), G.area(notch), G.area(ring((1, 1))), G.line_length(square), G.line_length(ring((1, 1)))) == (16.0, 10.0, 0.0, 12.0, 0.0)
    at = lambda x, y: G.make_point(F.lit(x), F.lit(y))
    assert one(spark, *[G.contains(notch, at(*p)) for p in ((1, 1), (2, 3), (2, 0.5), (5, 1), (0, 0), (4, 2))]) == (True, False, True, False, True, False)
    assert one(spark, G.rings_meet(square, ring((2, 2), (6, 2), (6, 6))), G.rings_meet(square, ring((1, 1), (2, 1), (2, 2))), G.rings_meet(square, ring((5, 5), (6, 5), (6, 6)))) == (True, True, False)
    circle = G.buffer(at(1, 2), F.lit(2.0), 64)
    found = one(spark, G.area(circle), G.contains(circle, at(1, 3.9)), G.contains(circle, at(1, 4.1)), G.make_point(F.lit(None), F.lit(1)))
    assert abs(found[0] - 4 * math.pi) < 0.05 and found[1:] == (True, False, None)


@pytest.mark.parametrize("cell", [0.7, 3.0, 100.0])
def test_points_in_rings_against_all_pairs(spark, cell):
    rng = np.random.default_rng(4)
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-10, 10, (120, 2)))] + [(999, None, 1.0)]
    rings = []
    for j in range(12):
        turn, size, centre = np.sort(rng.uniform(0, 2 * math.pi, 6)), rng.uniform(0.5, 6), rng.uniform(-8, 8, 2)
        rings.append((j, [(float(centre[0] + size * math.cos(a)), float(centre[1] + size * math.sin(a))) for a in turn]))
    rings += [(50, []), (51, None), (52, [(0.0, 0.0), (1.0, 1.0)])]

    def inside(p, r):
        hit = False
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
            if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    a = spark.createDataFrame(points, "i int, px double, py double").withColumn("at", G.make_point(F.col("px"), F.col("py")))
    b = spark.createDataFrame(rings, "j int, ring array<struct<x:double,y:double>>")
    got = G.join_inside(a, b, "at", "ring", cell)
    truth = sorted((i, j) for i, x, y in points if x is not None for j, r in rings if r and len(r) > 2 and inside((x, y), r))
    assert sorted((r["i"], r["j"]) for r in got.select("i", "j").collect()) == truth and len(truth) > 30
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_points_on_a_ring_are_left_out_without_edges(spark):
    """A diamond about (79.25, 70.25) with a half diagonal of 10, and a square: points on all sides and corners, and beside them."""
    diamond = [(69.25, 70.25), (79.25, 80.25), (89.25, 70.25), (79.25, 60.25)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    on = [(76.5, 63.0), (76.5, 77.5), (82.0, 63.0), (82.0, 77.5), *diamond, (2.0, 0.0), (4.0, 1.5), (1.0, 4.0), (0.0, 3.0), *square]
    inside = [(76.5, 63.0001), (76.5001, 63.0), (82.0, 77.4999), (79.25, 70.25), (69.2501, 70.25), (88.0, 70.25), (2.0, 0.0001), (3.9999, 3.9999)]
    beyond = [(76.4999, 63.0), (69.0, 70.25), (90.0, 70.25), (89.25, 80.25), (2.0, -0.0001), (5.0, 4.0), (5.0, 0.0), (-1.0, 4.0)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(on + inside + beyond)] + [(99, None, 0.0)], "i int, px double, py double").withColumn("at", G.make_point(F.col("px"), F.col("py")))
    rings = spark.createDataFrame([(0, diamond), (1, square), (2, []), (3, None)], "j int, ring array<struct<x:double,y:double>>")
    for cell in (1.0, 10.0):
        got = G.join_inside(points, rings, "at", "ring", cell, edges=False).select("i", "j").collect()
        assert sorted(r["i"] for r in got) == [len(on) + k for k in range(len(inside))]
        some = {r["i"] for r in G.join_inside(points, rings, "at", "ring", cell).select("i").collect()}
        assert {r["i"] for r in got} < some and 0 in some  # lower and left sides belong to the ring


def test_quoted_texts_of_definitions_count():
    from terrace.operators.quality import definition_conflicts

    models = {"a": {"x": "SUM( v )", "y": "IF(s = 'A b', 1)", "z": '"q q"', "w": "'it''s' || b"}, "b": {"x": "sum(v)", "y": "if(s='a B',1)", "z": '"qq"', "w": "'it''s'||B"}}
    assert definition_conflicts(models) == [("y", ["a", "b"]), ("z", ["a", "b"])]
