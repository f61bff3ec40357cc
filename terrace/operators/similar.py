"""Joins beyond one equality: alternatives, overlapping intervals, likeness of texts. All of them shuffle on equalities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import beside

Keys = Sequence[tuple[str, str]]


def _all_equal(keys: Keys) -> Column:
    out = F.lit(True)
    for a, b in keys:
        out = out & (F.col(a) == F.col(b))
    return out


def join_any(left: DataFrame, right: DataFrame, alternatives: Sequence[Keys], how: str = "inner") -> DataFrame:
    """Pairs of rows that agree on all keys of one of the alternatives at least, each pair once; left keeps rows without any. Column
    names of the sides differ.

    A disjunction is a union of equal joins, each without the pairs of those before it. A NULL key agrees with nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"no such join: {how}")
    out, rest = None, left
    for i, keys in enumerate(alternatives):
        pairs = left.join(right, _all_equal(keys))
        for earlier in alternatives[:i]:
            pairs = pairs.where(~F.coalesce(_all_equal(earlier), F.lit(False)))
        out = pairs if out is None else out.unionByName(pairs)
        rest = rest.join(right, _all_equal(keys), "left_anti")
    return out if how == "inner" else out.unionByName(rest, allowMissingColumns=True)


def counted_any(left: DataFrame, right: DataFrame, alternatives: Sequence[Keys], by: Sequence[str], new: str, distinct: Mapping[str, str] | None = None) -> DataFrame:
    """by, with `new`, the number of join_any()'s inner pairs, and the number of the distinct values that each column has in them (distinct:
    {new name: column}); `by` and these columns are of either side.

    No pair is made. For the number, both sides are counted by keys and `by` before they meet, and pairs that several alternatives
    make are taken off again by inclusion and exclusion; the joins double with each alternative. For distinct values, the
    alternatives' values are put together, a row for each value of `by` and key they meet in at most.
    """

    def met(keys: Keys, wanted: Sequence[str]) -> DataFrame:
        sides = []
        for i, df in enumerate((left, right)):
            held = dict.fromkeys([*[k[i] for k in keys], *[c for c in wanted if c in df.columns]])
            sides.append(df.groupBy(*held).agg(F.count(F.lit(1)).alias(f"__n{i}")))
        return sides[0].join(sides[1], _all_equal(keys)).select(*wanted, (F.col("__n0") * F.col("__n1")).alias("__pairs"))

    counts = []
    for size in range(1, len(alternatives) + 1):
        for some in combinations(alternatives, size):
            pairs = met([k for keys in some for k in keys], by)
            counts.append(pairs.select(*by, (F.col("__pairs") * (1 if size % 2 else -1)).alias("__pairs")))
    out = reduce(DataFrame.unionByName, counts).groupBy(*by).agg(F.coalesce(F.sum("__pairs"), F.lit(0).cast("bigint")).alias(new))
    for name, c in (distinct or {}).items():
        values = reduce(DataFrame.unionByName, [met(keys, [*by, c]).select(*by, F.col(c).alias("__value")).distinct() for keys in alternatives])
        out = beside(out, values.distinct().groupBy(*by).agg(F.count("__value").alias(name)), by)
    return out


def join_overlap(left: DataFrame, right: DataFrame, mine: tuple[str, str], other: tuple[str, str], width: float, keys: Keys = ()) -> DataFrame:
    """Pairs of rows whose intervals [start, end) overlap, and whose keys agree. Starts and ends are numbers, dates or times, the
    latter in seconds for `width`; empty intervals and those without a start or an end overlap nothing.

    Intervals are dealt into the buckets of `width` that they touch; a pair is made in the bucket where the later of the two
    begins, and in no other.
    """
    number = lambda df, c: F.col(c).cast("double") if dict(df.dtypes)[c] not in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("timestamp").cast("double")

    def dealt(df: DataFrame, ends: tuple[str, str], mark: str) -> DataFrame:
        start, end = (F.floor(number(df, c) / width) for c in ends)
        some = df.where(F.col(ends[0]) < F.col(ends[1])).withColumn(f"__first{mark}", start)
        return some.withColumn(f"__slot{mark}", F.explode(F.sequence(f"__first{mark}", end)))

    a, b = dealt(left, mine, "0"), dealt(right, other, "1")
    met = a.join(b, (F.col("__slot0") == F.col("__slot1")) & _all_equal(keys))
    met = met.where((F.col("__slot0") == F.greatest("__first0", "__first1")) & (F.col(mine[0]) < F.col(other[1])) & (F.col(other[0]) < F.col(mine[1])))
    return met.drop("__slot0", "__slot1", "__first0", "__first1")


def letter_grams(c: Column, n: int = 2) -> Column:
    """The distinct runs of n letters of a text in lower case; the text itself if it is shorter."""
    text = F.lower(c)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(runs)


def similar_values(left: DataFrame, right: DataFrame, mine: str, other: str, least: float, n: int = 2) -> DataFrame:
    """(left value, right value, similarity): pairs of distinct values whose sets of letter runs have a Jaccard similarity of `least`
    or more. NULLs are like nothing; empty texts are like each other.

    Of the runs of a value, the rarest first, only so many are joined on that two values with a prefix apart cannot reach
    `least`; lengths too unlike are left out, and what is left is verified. A pair is made at the first run that the two
    prefixes share, so it is made once.
    """
    if not 0 < least <= 1:
        raise ValueError("a similarity lies in (0, 1]")
    values = [df.select(F.col(c).cast("string").alias("value")).where("value is not null").distinct().withColumn("grams", letter_grams(F.col("value"), n)) for df, c in ((left, mine), (right, other))]
    each = [v.select("value", F.explode("grams").alias("gram")) for v in values]
    counts = each[0].select("gram").unionByName(each[1].select("gram")).groupBy("gram").agg(F.count("*").alias("count"))

    def prefixed(rows: DataFrame, mark: str) -> DataFrame:
        laid = rows.join(counts, "gram").groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "gram"))), lambda x: x["gram"]).alias("grams"))
        size = F.size("grams")
        prefix = F.slice("grams", F.lit(1), size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1)
        laid = laid.select(F.col("value").alias(f"value{mark}"), F.col("grams").alias(f"grams{mark}"), size.alias(f"size{mark}"), prefix.alias(f"prefix{mark}"))
        return laid.withColumn(f"gram{mark}", F.explode(f"prefix{mark}"))

    a, b = prefixed(each[0], "0"), prefixed(each[1], "1")
    near = (F.col("size0") >= F.col("size1") * (least - 1e-9)) & (F.col("size1") >= F.col("size0") * (least - 1e-9))
    first = F.get(F.array_intersect("prefix0", "prefix1"), F.lit(0))
    met = a.join(b, (F.col("gram0") == F.col("gram1")) & near).where(first == F.col("gram0"))
    shared = F.size(F.array_intersect("grams0", "grams1"))
    met = met.withColumn("similarity", shared / (F.col("size0") + F.col("size1") - shared))
    return met.where(F.col("similarity") >= least - 1e-9).select(F.col("value0").alias(mine), F.col("value1").alias(other if other != mine else f"{other}_2"), "similarity")
