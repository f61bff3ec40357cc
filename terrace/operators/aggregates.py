"""Aggregates, totals and level-of-detail expressions.

Undefined ratios are NULL; COUNTD ignores NULL everywhere; STDEVP and VARP are of the population.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality import order_of, unmet
from .spread import beside, order_statistics

AGGREGATES = {
    "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max, "COUNT": F.count, "COUNTD": F.count_distinct, "MEDIAN": F.median,
    "STDEV": F.stddev_samp, "STDEVP": F.stddev_pop, "VAR": F.var_samp, "VARP": F.var_pop,
}


def group(df: DataFrame, keys: Sequence[str], measures: Sequence[tuple[str, str, str]]) -> DataFrame:
    """measures: (column, aggregate, new name). A NULL key is a group; COUNT of "*" counts rows. Medians are made apart, all in one
    pass by ranges of the values (a job runs), so that a group's values need not fit a task."""
    out = [(F.count(F.lit(1)) if c == "*" else AGGREGATES[a](F.col(c))).alias(n) for c, a, n in measures if a != "MEDIAN"]
    found = df.groupBy(*keys).agg(*out) if out else df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    if medians := {n: (c, 0.5) for c, a, n in measures if a == "MEDIAN"}:
        found = beside(found, order_statistics(df, keys, medians), keys)
    return found.select(*keys, *[n for _, _, n in measures])


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def percentile(c: Column, p: float) -> Column:
    """Interpolated between the two nearest values. A task holds a group's distinct values; spread.percentiles() does without."""
    return F.percentile(c, F.lit(p))


def attr(c: Column) -> Column:
    """The one value of the group, or NULL if there are several or some are NULL."""
    return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def sum_if(condition: Column, c: Column) -> Column:
    return F.sum(F.when(condition, c))


def countd_if(condition: Column, c: Column) -> Column:
    return F.count_distinct(F.when(condition, c))


def present() -> Column:
    """1 if the group has a row."""
    return F.when(F.count(F.lit(1)) > 0, F.lit(1))


def totals(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column], grand_only: bool = False) -> DataFrame:
    """Groups, subtotals along the keys and the grand total, all computed from rows; `level` counts the keys rolled up."""
    names = [*keys]
    if grand_only:
        sets = df.groupingSets([[F.col(k) for k in names], []], *[F.col(k) for k in names])
    else:
        sets = df.rollup(*names)
    level = sum((F.grouping(k).cast("int") for k in names), F.lit(0))
    return sets.agg(level.alias("level"), *[m.alias(n) for n, m in measures.items()])


def fixed(df: DataFrame, keys: Sequence[str], value: Column, new: str) -> DataFrame:
    """{FIXED keys: value} on every row. The aggregate is made once for each key and joined back, so that partial sums do the
    work of a large key; NULL keys match."""
    if not keys:
        return df.crossJoin(F.broadcast(df.agg(value.alias(new))))  # one row
    side = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(value.alias(new))
    on = None
    for i, k in enumerate(keys):
        hit = df[k].eqNullSafe(side[f"_k{i}"])
        on = hit if on is None else on & hit
    return df.join(side, on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def fixed_then(df: DataFrame, view: Sequence[str], keys: Sequence[str], value: Column, outer, new: str) -> DataFrame:
    """outer({FIXED keys: value}) by the view: over distinct keys, never once for each row."""
    inner = df.groupBy(*keys).agg(value.alias("_v"))
    grain = df.select(*dict.fromkeys([*view, *keys])).distinct()
    on = None
    for k in keys:
        hit = grain[k].eqNullSafe(inner[k])
        on = hit if on is None else on & hit
    return grain.join(inner, on).groupBy(*[grain[v] for v in view]).agg(outer(F.col("_v")).alias(new))


def include(df: DataFrame, view: Sequence[str], more: Sequence[str], value: Column, outer, new: str) -> DataFrame:
    """outer({INCLUDE more: value}) by the view."""
    return df.groupBy(*dict.fromkeys([*view, *more])).agg(value.alias("_v")).groupBy(*view).agg(outer(F.col("_v")).alias(new))


def exclude(df: DataFrame, view: Sequence[str], less: Sequence[str], value: Column, marks: Mapping[str, Column], new: str) -> DataFrame:
    """The view with its marks, and {EXCLUDE less: value} repeated on each mark."""
    rest = [v for v in view if v not in less]
    base = df.groupBy(*view).agg(*[m.alias(n) for n, m in marks.items()])
    if not rest:
        return base.crossJoin(F.broadcast(df.agg(value.alias(new))))  # one row
    side = df.groupBy(*rest).agg(value.alias(new))
    on = None
    for r in rest:
        hit = base[r].eqNullSafe(side[r])
        on = hit if on is None else on & hit
    return base.join(side, on).drop(*[side[r] for r in rest])


def with_measures(df: DataFrame, keys: Sequence[str], base: Mapping[str, Column], derived: Mapping[str, tuple[Sequence[str], Column]]) -> DataFrame:
    """keys and measures: base ones are aggregates, made in one pass; a derived one names the measures it needs and is a Column over
    them, whatever order they are given in. A name that nothing defines, or a cycle, is an error."""
    needs = {name: list(of) for name, (of, _) in derived.items()}
    if missing := unmet(needs, list(base)):
        raise KeyError(f"no measure {sorted({n for _, n in missing})}")
    out = df.groupBy(*keys).agg(*[c.alias(n) for n, c in base.items()])
    for name in order_of([(n, m) for m, of in needs.items() for n in of] + [("", m) for m in needs]):
        if name in derived:
            out = out.withColumn(name, derived[name][1])
    return out.select(*keys, *base, *derived)
