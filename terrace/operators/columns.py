"""Column operators: DataFrame in, DataFrame out, lazy but for add_index and promote_headers, which number rows and so run a job."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .spread import ranged

#: Spark types of the type names that flows and models use.
TYPES = {
    "string": "string", "integer": "bigint", "int64": "bigint", "real": "double", "double": "double", "number": "double", "boolean": "boolean", "date": "date",
    "datetime": "timestamp", "time": "string", "spatial": "string", "binary": "binary", "currency": "decimal(19,4)", "percentage": "double",
}


def name(column: str) -> Column:
    """The column of exactly that name, dots and spaces included."""
    return F.col("`" + column.replace("`", "``") + "`")


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    taken = [names.get(c, c).lower() for c in df.columns]
    if len(set(taken)) < len(taken):
        raise ValueError("a new name is taken; names differ by more than case")
    return df.withColumnsRenamed(dict(names))


def remove(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select([name(c) for c in columns])


def reorder(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """The named columns first, the others after them in their order."""
    return df.select([name(c) for c in [*first, *(c for c in df.columns if c not in first)]])


def duplicate(df: DataFrame, column: str, new: str | None = None) -> DataFrame:
    return df.withColumn(new or f"{column}_copy", name(column))


def change_type(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Values that do not fit become NULL."""
    return df.withColumns({c: name(c).try_cast(TYPES.get(t, t)) for c, t in types.items()})


def split_by_delimiter(df: DataFrame, column: str, delimiter: str, parts: int) -> DataFrame:
    """column becomes column.1 to column.n; parts that are not there are NULL."""
    pieces = F.split(name(column), re.escape(delimiter) if len(delimiter) > 1 else f"[{delimiter}]" if delimiter not in "^\\[]" else "\\" + delimiter, -1)
    return df.withColumns({f"{column}.{i + 1}": F.get(pieces, F.lit(i)) for i in range(parts)}).drop(column)


def split_by_position(df: DataFrame, column: str, starts: Sequence[int]) -> DataFrame:
    """Cuts at 0-based starts into column.1 to column.n."""
    ends = [*starts[1:], None]
    cut = {f"{column}.{i + 1}": F.substring(name(column), F.lit(a + 1), F.lit(b - a) if b is not None else F.length(name(column))) for i, (a, b) in enumerate(zip(starts, ends, strict=True))}
    return df.withColumns(cut).drop(column)


def merge(df: DataFrame, columns: Sequence[str], new: str, separator: str = " ") -> DataFrame:
    """One text column of several, NULLs left out; the sources go."""
    return df.withColumn(new, F.concat_ws(separator, *[name(c).cast("string") for c in columns])).drop(*[c for c in columns if c != new])


def add(df: DataFrame, new: str, value: Column, kind: str | None = None) -> DataFrame:
    return df.withColumn(new, value.try_cast(TYPES.get(kind, kind)) if kind else value)


def conditional(cases: Sequence[tuple[Column, object]], default: object = None) -> Column:
    """The value of the first case that holds."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def add_index(df: DataFrame, new: str, order: Sequence[Column | str], start: int = 1, step: int = 1) -> DataFrame:
    """Numbers the rows in that order, which is to be total.

    Rows are dealt out by ranges of the order; each range counts its rows, and what stands before it is added, so that no
    task meets all rows. The ranges are a checkpoint, as their ends depend on a sample and must not be drawn twice.
    """
    cut = ranged(df, [F.col(o) if isinstance(o, str) else o for o in order]).withColumn("__nth", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = cut.groupBy("__part").agg(F.count("*").alias("__n"))  # a row for each partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = cut.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part")
    return at.withColumn(new, (F.col("__before") + F.col("__nth")) * step + start).drop("__part", "__nth", "__before", "__at")


def transpose(df: DataFrame, key: str, keys: Sequence[str]) -> DataFrame:
    """Columns become rows and the given keys become columns: one row for each other column, its name in `column`."""
    values = [c for c in df.columns if c != key]
    long = df.select(name(key), *[name(c).cast("string").alias(c) for c in values]).unpivot(key, values, "column", "value")
    return long.groupBy("column").pivot(key, list(keys)).agg(F.first("value"))


def promote_headers(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The first row in that order names the columns and goes; rows that equal it stay. A column without a name keeps its old one."""
    numbered = add_index(df, "__row", order)
    first = numbered.where("__row = 1").drop("__row").first()
    if first is None:
        raise ValueError("no row to take the names from")
    return numbered.where("__row > 1").drop("__row").toDF(*[c if v is None else str(v) for c, v in zip(df.columns, first, strict=True)])


def demote_headers(df: DataFrame, position: str | None = None) -> DataFrame:
    """The names become a row of text, the columns Column1 to ColumnN. Rows have no order of their own: `position` names a column
    that is 0 for the row of names and 1 for the others, to sort by."""
    header = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType([T.StructField(c, T.StringType()) for c in df.columns]))
    new = [f"Column{i + 1}" for i in range(len(df.columns))]
    rows = df.select([name(c).cast("string") for c in df.columns]).toDF(*new)
    if position:
        return header.toDF(*new).withColumn(position, F.lit(0)).union(rows.withColumn(position, F.lit(1)))
    return header.toDF(*new).union(rows)


def expand_struct(df: DataFrame, column: str, fields: Sequence[str], prefix: str = "") -> DataFrame:
    """Fields of a nested column as columns, in its place."""
    return df.withColumns({prefix + f: name(column)[f] for f in fields}).drop(column)


def expand_rows(df: DataFrame, column: str) -> DataFrame:
    """A row for each element of an array column; rows without elements stay, with NULL."""
    return df.withColumn(column, F.explode_outer(name(column)))
