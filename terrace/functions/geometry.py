"""Plane geometry: points are structs of x and y, lines and rings arrays of points. Columns in, Columns out."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def make_point(x: Column, y: Column) -> Column:
    """NULL if a coordinate is."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))


def make_line(*points: Column) -> Column:
    return F.array(*points)


def collect(point: Column, order: Column) -> Column:
    """The points of a group as one line, in order: an aggregate. NULL points are left out."""
    return F.transform(F.array_sort(F.collect_list(F.when(point.isNotNull(), F.struct(order.alias("o"), point.alias("p"))))), lambda e: e["p"])


def _sides(ring: Column) -> Column:
    """(a, b) of each side, the last one back to the start."""
    after = F.concat(F.slice(ring, 2, F.greatest(F.lit(1), F.size(ring))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v)


def point_distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def line_length(line: Column) -> Column:
    """Of an open line; 0 for fewer than two points."""
    steps = F.zip_with(F.slice(line, 1, F.greatest(F.lit(0), F.size(line) - 1)), F.slice(line, 2, F.greatest(F.lit(0), F.size(line) - 1)), lambda a, b: point_distance(a, b))
    return _sum(steps)


def area(ring: Column) -> Column:
    """By cross products of the sides; 0 for fewer than three points."""
    return F.abs(_sum(F.transform(_sides(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))) / 2


def contains(ring: Column, point: Column) -> Column:
    """Whether a point lies in a ring, by the sides that a ray to its right crosses. Lower and left sides belong to the ring, the others do not."""
    x, y = point["x"], point["y"]

    def crossed(s: Column) -> Column:
        a, b = s["a"], s["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        return F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(spans, b["y"] - a["y"]) + a["x"]), F.lit(1)).otherwise(F.lit(0))

    return F.aggregate(F.transform(_sides(ring), crossed), F.lit(0), lambda acc, v: acc + v) % 2 == 1


def on_edge(ring: Column, point: Column) -> Column:
    """Whether a point lies on a side or corner of a ring, as doubles have it: exact where the products of coordinates are."""
    within = lambda v, a, b: (v >= F.least(a, b)) & (v <= F.greatest(a, b))

    def on(s: Column) -> Column:
        a, b = s["a"], s["b"]
        along = (b["x"] - a["x"]) * (point["y"] - a["y"]) == (b["y"] - a["y"]) * (point["x"] - a["x"])
        return F.coalesce(along & within(point["x"], a["x"], b["x"]) & within(point["y"], a["y"], b["y"]), F.lit(False))

    return F.exists(_sides(ring), on)


def buffer(point: Column, radius: Column, corners: int = 32) -> Column:
    """The ring of a circle about a point, as a polygon."""
    turn = [2 * math.pi * i / corners for i in range(corners)]
    return F.array(*[F.struct((point["x"] + radius * math.cos(t)).alias("x"), (point["y"] + radius * math.sin(t)).alias("y")) for t in turn])


def _turn(a: Column, b: Column, c: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"]))


def rings_meet(a: Column, b: Column) -> Column:
    """Whether two rings have a point in common: sides that cross, or one ring inside the other. Sides that only touch or run
    along each other do not count."""
    crossing = F.exists(_sides(a), lambda s: F.exists(_sides(b), lambda t: (_turn(s["a"], s["b"], t["a"]) * _turn(s["a"], s["b"], t["b"]) < 0) & (_turn(t["a"], t["b"], s["a"]) * _turn(t["a"], t["b"], s["b"]) < 0)))
    return crossing | contains(a, F.get(b, F.lit(0))) | contains(b, F.get(a, F.lit(0)))


def join_inside(points: DataFrame, rings: DataFrame, point: str, ring: str, cell: float, edges: bool = True) -> DataFrame:
    """Pairs of a point and a ring that contains it; without edges those on none of its sides. Rings are dealt into the cells of a grid that their bounds touch, points into
    their own, so that the join has an equality to shuffle on; NULLs are in nothing."""
    p = points.where(F.col(point).isNotNull()).withColumns({"__cx": F.floor(F.col(point)["x"] / cell), "__cy": F.floor(F.col(point)["y"] / cell)})
    bound = lambda f, axis: F.floor(f(F.transform(ring, lambda q: q[axis])) / cell)
    r = rings.where(F.size(ring) >= 3)
    for axis in "xy":
        r = r.withColumn(f"__r{axis}", F.explode(F.sequence(bound(F.array_min, axis), bound(F.array_max, axis))))
    met = p.join(r, (F.col("__cx") == F.col("__rx")) & (F.col("__cy") == F.col("__ry")))
    inside = contains(F.col(ring), F.col(point))
    if not edges:
        inside = inside & ~on_edge(F.col(ring), F.col(point))
    return met.where(inside).drop("__cx", "__cy", "__rx", "__ry")
