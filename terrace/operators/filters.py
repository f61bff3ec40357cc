"""Filters. Each returns a predicate Column for df.where(), so that Catalyst can push it into the scan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_values(c: Column, values: Sequence) -> Column:
    return c.isin(list(values))


def exclude_values(c: Column, values: Sequence) -> Column:
    """NULL is no value of the list, and stays."""
    return c.isNull() | ~c.isin(list(values))


def keep_if(condition: Column) -> Column:
    return condition


def remove_if(condition: Column) -> Column:
    """A row whose condition is NULL stays."""
    return ~F.coalesce(condition, F.lit(False))


def between(c: Column, low=None, high=None) -> Column:
    """Inclusive; either end may be open. Without ends all rows with a value stay."""
    out = c.isNotNull()
    if low is not None:
        out = out & (c >= F.lit(low))
    if high is not None:
        out = out & (c <= F.lit(high))
    return out


def outside(c: Column, low=None, high=None, include_low: bool = True, include_high: bool = True) -> Column:
    """Removes a range; its ends go with it if included. NULL stays, unless neither end is given: then NULL goes."""
    if low is None and high is None:
        return c.isNotNull()
    inside = F.lit(True)
    if low is not None:
        inside = inside & (c >= F.lit(low) if include_low else c > F.lit(low))
    if high is not None:
        inside = inside & (c <= F.lit(high) if include_high else c < F.lit(high))
    return c.isNull() | ~inside


def nulls(c: Column, keep: bool) -> Column:
    return c.isNull() if keep else c.isNotNull()


def matches(c: Column, text: str, how: str = "contains") -> Column:
    """how: contains, starts, ends, exact, or wildcard with * and ?."""
    if how == "wildcard":
        return c.like(text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%").replace("?", "_"))
    return {"contains": c.contains, "starts": c.startswith, "ends": c.endswith, "exact": c.__eq__}[how](text)


_SPAN = {"day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}


def relative_date(c: Column, anchor: Column, period: str, which: str = "last", count: int = 1) -> Column:
    """Whole periods before, around or after the anchor: `last` n end with the anchor's own period, `next` n begin after it."""
    unit = _SPAN[period]
    start = F.date_trunc(unit, anchor)
    months = {"month": 1, "quarter": 3, "year": 12}

    def shifted(n: int) -> Column:
        if unit in months:
            return F.add_months(start.cast("date"), n * months[unit]).cast("timestamp")
        return F.date_add(start.cast("date"), n * (7 if unit == "week" else 1)).cast("timestamp")

    low, high = {"last": (1 - count, 1), "this": (0, 1), "next": (1, 1 + count)}[which]
    return (c >= shifted(low)) & (c < shifted(high))


def in_intervals(c: Column, intervals: Sequence[tuple], invert: bool = False) -> Column:
    """In any of the half-open [start, end)."""
    out = F.lit(False)
    for a, b in intervals:
        out = out | ((c >= F.lit(a)) & (c < F.lit(b)))
    return ~out if invert else out


def top_by(df: DataFrame, dimension: str, measure: Column, n: int, bottom: bool = False) -> DataFrame:
    """Rows of the n members with the largest (or smallest) measure; equal ones by member. n members are chosen in a top-k."""
    order = F.asc("_m") if bottom else F.desc("_m")
    chosen = df.groupBy(dimension).agg(measure.alias("_m")).orderBy(order, dimension).limit(n).select(dimension)
    return df.join(chosen, dimension, "left_semi")


def in_order(
    df: DataFrame, context: Sequence[Column] = (), sets: Sequence[Callable[[DataFrame], DataFrame]] = (), dimensions: Sequence[Column] = (), measures: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Filters in their order of operations: context filters, then what is computed from what these leave (top-N members, sets,
    FIXED columns), then dimension filters, which do not change what was computed, then the view and its measure filter."""
    for c in context:
        df = df.where(c)
    for make in sets:
        df = make(df)
    for c in dimensions:
        df = df.where(c)
    return measures(df) if measures else df


def castable(c: Column, kind: str) -> Column:
    """Rows whose value is NULL or can be read as that type."""
    return c.isNull() | c.try_cast(kind).isNotNull()


def not_blank(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def group_filter(spec: tuple) -> Column:
    """A view's filter, made of parts: ("members", column, values), ("all",), ("range", column, low, high), ("union", part, ...),
    ("intersect", part, ...), ("except", part, part) and ("not", part). Never NULL: a NULL is a member only if it is named, and what
    a part leaves out, NULLs too, is what its "not" keeps."""
    kind, *rest = spec
    if kind == "all":
        return F.lit(True)
    if kind == "members":
        column, values = rest
        known = [v for v in values if v is not None]
        out = F.coalesce(F.col(column).isin(known), F.lit(False))
        return out | F.col(column).isNull() if len(known) < len(values) else out
    if kind == "range":
        column, low, high = rest
        return F.coalesce(between(F.col(column), low, high), F.lit(False))
    parts = [group_filter(p) for p in rest]
    if kind == "not" and len(parts) == 1:
        return ~parts[0]
    if kind == "except" and len(parts) == 2:
        return parts[0] & ~parts[1]
    if kind in ("union", "intersect") and parts:
        out = parts[0]
        for p in parts[1:]:
            out = out | p if kind == "union" else out & p
        return out
    raise ValueError(f"no such filter: {kind} of {len(parts)} parts")
