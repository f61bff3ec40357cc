"""Order, set and reshape operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import add_index


def by(columns: Sequence[tuple[str, bool]]) -> list[Column]:
    """(column, descending) pairs as sort keys, NULL last either way."""
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_last() for c, desc in columns]


def manual_order(c: Column, values: Sequence) -> Column:
    """Sort key by place in the list; what is not in it comes last."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), c)
    return F.when(at > 0, at).otherwise(len(values) + 1)


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def skip(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return add_index(df, "_nth", order).where(F.col("_nth") > n).drop("_nth")


def drop_last(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    numbered = add_index(df, "_nth", order)
    rows = df.agg(F.count("*").alias("_rows"))
    return numbered.crossJoin(F.broadcast(rows)).where(F.col("_nth") <= F.col("_rows") - n).drop("_nth", "_rows")  # one row


def sample(df: DataFrame, share: float, key: str) -> DataFrame:
    """A share of the rows, the same ones each time: by a hash of their key."""
    return df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))


_WIDER = {("bigint", "double"): "double", ("int", "double"): "double", ("int", "bigint"): "bigint", ("float", "double"): "double"}


def union(frames: Sequence[DataFrame], names: Sequence[Mapping[str, str]] | None = None, source: str | None = None) -> DataFrame:
    """By name. Missing columns are NULL; integer and real become real; other types that differ are an error. names: a
    renaming for each input; source: a column that numbers the inputs from 1."""
    frames = [f.withColumnsRenamed(dict(n)) for f, n in zip(frames, names, strict=True)] if names else list(frames)
    kinds: dict[str, str] = {}
    for f in frames:
        for c, t in f.dtypes:
            have = kinds.setdefault(c, t)
            if have != t:
                wide = _WIDER.get((have, t)) or _WIDER.get((t, have))
                if not wide:
                    raise TypeError(f"{c} is {have} and {t}")
                kinds[c] = wide
    if source:
        frames = [f.withColumn(source, F.lit(i + 1)) for i, f in enumerate(frames)]
    out = None
    for f in frames:
        f = f.withColumns({c: F.col(f"`{c}`").cast(kinds[c]) for c, t in f.dtypes if c in kinds and t != kinds[c]})
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def distinct(df: DataFrame, subset: Sequence[str] | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """With a subset, the first row of each of its values in that order."""
    if subset is None:
        return df.distinct()
    w = Window.partitionBy(*subset).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def unpivot(df: DataFrame, columns: Sequence[str], names: str, values: str, drop_nulls: bool = False) -> DataFrame:
    long = df.unpivot([c for c in df.columns if c not in columns], list(columns), names, values)
    return long.where(F.col(values).isNotNull()) if drop_nulls else long


def unpivot_others(df: DataFrame, keep: Sequence[str], names: str, values: str, drop_nulls: bool = False) -> DataFrame:
    return unpivot(df, [c for c in df.columns if c not in keep], names, values, drop_nulls)


def pivot(df: DataFrame, keys: Sequence[str], names: str, members: Sequence, value: Column) -> DataFrame:
    """A column for each member named; naming them spares a job and fixes the schema."""
    return df.groupBy(*keys).pivot(names, list(members)).agg(value)
