"""Prefix sums and order statistics by ranges of the rows, so that no task meets a whole group."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import checkpoint_dir

_BEFORE = (Window.unboundedPreceding, -1)
#: Rows of a range, about: a task sorts one range, so its memory does not grow with the table.
ROWS = 1 << 19


def ranged(df: DataFrame, by: Sequence[Column | str], then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """df in ranges of `by`, with __at (its place) and __part (its range). Jobs run: rows are counted for the number of ranges, which
    grows with them, and the ranges, and what `then` makes of them, are a checkpoint, as their ends depend on a sample and must
    not be drawn twice. df is read more than once, so what is dear to make is best made before."""
    checkpoint_dir(df.sparkSession)
    parts = -(-df.count() // ROWS)
    cut = df.repartitionByRange(parts, *by) if parts > 1 else df.repartitionByRange(*by)
    out = cut.sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33).cast("int")
    if then is None:
        return out.checkpoint().withColumn("__part", part)
    out = out.withColumn("__part", part)
    if parts > 1:
        out = out.repartitionById(parts, F.col("__part"))  # for a window by range a task to each; by hash one would meet several
    return then(out).checkpoint()


def beside(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """left with the other columns of right, which has one row at most for each of the keys; NULL keys match."""
    side, on = right, F.lit(True)
    for i, k in enumerate(keys):
        side = side.withColumnRenamed(k, f"__k{i}")
        on = on & left[k].eqNullSafe(F.col(f"__k{i}"))
    return left.join(side, on, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, new: str, total: str | None = None) -> DataFrame:
    """new: the sum of value over the rows of the same keys up to this one, in an order that is to be total; and `total` over all
    of them, if named. Ranges are summed each on their own, and what stands before each is added."""
    inside = Window.partitionBy("__part", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    cut = ranged(df.withColumn("__v", value), [*keys, *order], lambda c: c.withColumn("__run", F.sum("__v").over(inside)))
    sums = cut.groupBy(*keys, "__part").agg(F.sum("__v").alias("__sum"))  # a row for each range that a key touches
    before = F.sum("__sum").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(*_BEFORE))
    more = [F.sum("__sum").over(Window.partitionBy(*keys)).alias(total)] if total else []
    sums = sums.select(*keys, "__part", before.alias("__before"), *more)
    run = beside(cut, sums, [*keys, "__part"])
    whole = F.coalesce(F.col("__before") + F.col("__run"), F.col("__before"), F.col("__run"))
    return run.withColumn(new, whole).drop("__v", "__at", "__part", "__run", "__before")


def percentiles(df: DataFrame, keys: Sequence[str], column: str, shares: Mapping[str, float]) -> DataFrame:
    """order_statistics() of one column."""
    return order_statistics(df, keys, {n: (column, p) for n, p in shares.items()})


def order_statistics(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """keys and a percentile (column, share) for each new name, interpolated between the two nearest values; groups of NULLs only are
    left out.

    Rows are counted by key, column and value first, all columns in one pass; of the prefix sums of these counts only the values
    at the wanted places are kept.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    by = [*keys, "__column"]
    if len(columns) == 1:
        held = df.select(*keys, F.lit(0).alias("__column"), F.col(columns[0]).cast("double").alias("__value"))
    else:
        cells = [F.struct(F.lit(i).alias("__column"), F.col(c).cast("double").alias("__value")) for i, c in enumerate(columns)]
        held = df.select(*keys, F.inline(F.array(*cells)))
    checkpoint_dir(df.sparkSession)
    counts = held.where("__value is not null").groupBy(*by, "__value").agg(F.count("*").alias("__n")).checkpoint()
    run = running_total(counts, by, ["__value"], F.col("__n"), "__to", "__count")
    places = {name: (columns.index(c), F.lit(p) * (F.col("__count") - 1)) for name, (c, p) in wanted.items()}
    value_at = lambda i, place: F.min(F.when((F.col("__column") == i) & (place >= F.col("__to") - F.col("__n")) & (place < F.col("__to")), F.col("__value")))
    each = []
    for name, (i, at) in places.items():
        each += [F.max(F.when(F.col("__column") == i, at - F.floor(at))).alias(f"__at_{name}"), value_at(i, F.floor(at)).alias(f"__low_{name}"), value_at(i, F.ceil(at)).alias(f"__high_{name}")]
    found = run.groupBy(*keys).agg(*each) if keys else run.agg(*each).where(F.coalesce(*[F.col(f"__low_{n}") for n in wanted]).isNotNull())
    between = lambda n: F.col(f"__low_{n}") + (F.col(f"__high_{n}") - F.col(f"__low_{n}")) * F.col(f"__at_{n}")
    return found.select(*keys, *[between(n).alias(n) for n in wanted])
