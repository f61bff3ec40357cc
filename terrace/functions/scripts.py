"""External scripts: Python functions on whole Arrow batches or groups, registered by the caller."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = {"SCRIPT_BOOL": "boolean", "SCRIPT_INT": "bigint", "SCRIPT_REAL": "double", "SCRIPT_STR": "string"}


def script(kind: str, fn: Callable[..., pd.Series], *columns: Column) -> Column:
    """fn gets a pandas Series for each column, batch by batch."""
    packed = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(columns)])

    @F.pandas_udf(TYPES[kind])
    def run(rows: pd.DataFrame) -> pd.Series:
        return fn(*[rows[c] for c in rows.columns])

    return run(packed)


def script_table(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn maps each batch of rows to rows."""

    def each(frames):
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(each, schema)


def script_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fn maps each group whole; for groups that fit a task by their meaning."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def script_aggregate(kind: str, fn: Callable[..., float], *columns: Column) -> Column:
    """fn maps a group's Series to one value. A group meets whole in a task: for groups that are small by their meaning."""

    @F.pandas_udf(TYPES[kind])
    def run(*values: pd.Series) -> float:
        return fn(*values)

    return run(*columns)


def predicted(df: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], columns: Sequence[str], schema: str) -> DataFrame:
    """df with the columns that a model makes of some others, batch by batch. The model goes to the tasks as it is, so it is small; a row
    with a NULL input gets NULLs."""
    packed = F.struct(*[F.col(c).alias(c) for c in columns])

    @F.pandas_udf(schema)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return model(rows)

    known = packed
    for c in columns:
        known = F.when(F.col(c).isNotNull(), known)
    filled = F.coalesce(known, F.struct(*[F.lit(0).cast(dict(df.dtypes)[c]).alias(c) for c in columns]))
    out = df.withColumn("__made", run(filled)).withColumn("__made", F.when(known.isNotNull(), F.col("__made")))
    return out.select(*df.columns, "__made.*")
