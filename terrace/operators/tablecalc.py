"""Table calculations over the marks of a view: Column builders on a window that is partitioned and totally ordered."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def running(aggregate, c: Column, w: WindowSpec) -> Column:
    return aggregate(c).over(w.rowsBetween(Window.unboundedPreceding, 0))


def windowed(aggregate, c: Column, w: WindowSpec, first: int = ALL[0], last: int = ALL[1]) -> Column:
    """Of the rows from first to last, relative to this one; by default of the whole partition."""
    return aggregate(c).over(w.rowsBetween(first, last))


def window_percentile(c: Column, p: float, w: WindowSpec, first: int = ALL[0], last: int = ALL[1]) -> Column:
    """Interpolated percentile of a frame. Of the whole partition it is computed once; of a bounded frame from its sorted values
    (a framed percentile is no window function in Spark)."""
    if (first, last) == ALL:
        return F.percentile(c, F.lit(p)).over(w.rowsBetween(*ALL))
    v = F.array_sort(F.collect_list(c).over(w.rowsBetween(first, last)))
    at = (F.size(v) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a, b = F.get(v, low), F.get(v, F.ceil(at).cast("int"))
    return F.when(F.size(v) > 0, a + (b - a) * (at - low))


def window_median(c: Column, w: WindowSpec, first: int = ALL[0], last: int = ALL[1]) -> Column:
    return window_percentile(c, 0.5, w, first, last)


def window_countd(c: Column, w: WindowSpec, first: int = ALL[0], last: int = ALL[1]) -> Column:
    return F.size(F.collect_set(c).over(w.rowsBetween(first, last)))


def rank_modified(w: WindowSpec) -> Column:
    """1, 3, 3, 4: equal values share the last rank."""
    return F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, 0))


def index(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def first(w: WindowSpec) -> Column:
    """Offset to the partition's first row: 0 or less."""
    return F.lit(1) - F.row_number().over(w)


def size(w: WindowSpec) -> Column:
    return F.count(F.lit(1)).over(w.rowsBetween(*ALL))


def last(w: WindowSpec) -> Column:
    """Offset to the partition's last row: 0 or more."""
    return size(w) - F.row_number().over(w)


def lookup(c: Column, offset: int, w: WindowSpec) -> Column:
    return F.lag(c, -offset).over(w) if offset < 0 else F.lead(c, offset).over(w)


def difference(c: Column, w: WindowSpec) -> Column:
    return c - F.lag(c).over(w)


def percent_difference(c: Column, w: WindowSpec) -> Column:
    before = F.lag(c).over(w)
    return F.try_divide(c - before, F.abs(before))


def percent_of_total(c: Column, w: WindowSpec) -> Column:
    return F.try_divide(c, F.sum(c).over(w.rowsBetween(*ALL)))


def previous_value(df: DataFrame, partition: list[str], order: list[str], step, seed: float, new: str) -> DataFrame:
    """new = step(row, new of the row before, or seed at first), row by row along each partition.

    For recursions that no running aggregate expresses. A partition is one group in a task, as its definition needs.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + f", `{new}` double"

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        out, value = [], seed
        for row in rows.to_dict("records"):
            value = step(row, value)
            out.append(value)
        return rows.assign(**{new: pd.Series(out, index=rows.index, dtype="float64")})

    return df.groupBy(*partition).applyInPandas(along, schema)
