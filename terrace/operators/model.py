"""Sets, groups, bins, parameters, calendar, time intelligence and row-level security."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .cleaning import remap


def in_set(c: Column, members: Sequence) -> Column:
    """Never NULL: NULL is out, unless it is a member."""
    known = [m for m in members if m is not None]
    out = F.coalesce(c.isin(known), F.lit(False))
    return out | c.isNull() if len(known) < len(members) else out


def grouped(c: Column, groups: Mapping[str, Sequence], default: str | None = "Other") -> Column:
    """label -> values; the default for the rest, or the value itself without one."""
    pairs = {str(v): label for label, values in groups.items() for v in values}
    if default is None:
        return remap(c.cast("string"), pairs)
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c.cast("string")), F.lit(default))


def grouped_by_table(df: DataFrame, column: str, table: DataFrame, default: str, new: str) -> DataFrame:
    """Large groups: table(value, label) is joined, whatever its size."""
    side = table.select(F.col("value").alias("_value"), F.col("label").alias(new))
    return df.join(side, df[column] == side["_value"], "left").drop("_value").fillna({new: default})


def bins(c: Column, size: float = 10) -> Column:
    """The lower edge of the value's bin."""
    return F.floor(c / size) * size


def combined(columns: Sequence[Column]) -> Column:
    return F.concat_ws(" | ", *[c.cast("string") for c in columns])


def range_table(spark: SparkSession, low: int, high: int, step: int) -> DataFrame:
    """The values of a range parameter, both ends included."""
    return spark.range(low, high + 1, step).withColumnRenamed("id", "value")


def list_table(spark: SparkSession, members: Sequence[tuple]) -> DataFrame:
    """(value, alias) of a list parameter. The caller names the members, so they are sent to the tasks of what joins them: dealt by so few
    values, a large table would come to a task for each."""
    return F.broadcast(spark.createDataFrame(list(members), "value string, alias string"))


def checked(value, allowed: Sequence):
    if value not in allowed:
        raise ValueError(f"{value!r} is not one of the allowed values")
    return value


def switch(choice: str, branches: Mapping[str, Column]) -> Column:
    """The measure or dimension that a parameter picks."""
    return branches[checked(choice, list(branches))]


def calendar(df: DataFrame, column: str, first_year: int = 2020, last_year: int = 2030) -> DataFrame:
    """A row for each day of the years, widened to whole years of the data."""
    ends = df.agg(F.least(F.min(F.year(column)), F.lit(first_year)).alias("a"), F.greatest(F.max(F.year(column)), F.lit(last_year)).alias("b"))
    days = ends.select(F.explode(F.sequence(F.make_date("a", F.lit(1), F.lit(1)), F.make_date("b", F.lit(12), F.lit(31)))).alias("date"))
    return days.select(
        "date",
        F.trunc("date", "month").alias("month_start"),
        F.year("date").alias("year"),
        F.concat(F.lit("Q"), F.quarter("date")).alias("quarter"),
        F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"),
        F.dayofmonth("date").alias("day"),
        (F.weekday("date") + 1).alias("day_of_week"),
        F.date_format("date", "EEEE").alias("day_name"),
    )


def year_to_date(c: Column, date: str, keys: Sequence[str] = ()) -> Column:
    w = Window.partitionBy(*keys, F.year(date)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(c).over(w)


def prior_year(df: DataFrame, date: str, measure: str, new: str, keys: Sequence[str] = ()) -> DataFrame:
    """The measure of the same day (or month start) a year before, by join: gaps in the dates do no harm."""
    side = df.select(*[F.col(k).alias(f"_{k}") for k in keys], F.add_months(date, 12).alias("_date"), F.col(measure).alias(new))
    on = df[date] == side["_date"]
    for k in keys:
        on = on & df[k].eqNullSafe(side[f"_{k}"])
    return df.join(side, on, "left").drop("_date", *[f"_{k}" for k in keys])


def growth(now: Column, before: Column) -> Column:
    return F.try_divide(now - before, before)


def secured(df: DataFrame, column: str, user: str, allowed: Mapping[str, Sequence]) -> DataFrame:
    """Rows whose value the user may see; a user without an entry sees none."""
    return df.where(F.col(column).isin(list(allowed.get(user, []))))


def secured_by_table(df: DataFrame, column: str, user: str, grants: DataFrame) -> DataFrame:
    """grants(user, value)."""
    mine = grants.where(F.col("user") == user).select(F.col("value").alias(column))
    return df.join(mine, column, "left_semi")


def is_member(group: str, groups: Sequence[str]) -> Column:
    return F.lit(group in groups)


def any_role(predicates: Sequence[Column]) -> Column:
    """Roles of several models: what any of them shows."""
    out = F.lit(False)
    for p in predicates:
        out = out | F.coalesce(p, F.lit(False))
    return out


def user_domain(user: str) -> Column:
    """What stands before the backslash of a login; empty without one."""
    return F.lit(user.rpartition("\\")[0])


def user_attribute(attributes: Mapping[str, str], name: str) -> Column:
    """NULL for an attribute that the user has not."""
    return F.lit(attributes.get(name)).cast("string")


def domain(df: DataFrame, column: str) -> DataFrame:
    """The values that a parameter may take, from a table."""
    return df.select(F.col(column).alias("value")).where("value is not null").distinct()


def parameter(value, kind: str, allowed: Sequence | None = None, low=None, high=None) -> Column:
    """A scalar parameter as a typed literal. A value that is not allowed, or out of its range, is an error; NULL is allowed only by name."""
    if allowed is not None:
        checked(value, allowed)
    if value is not None and (low is not None and value < low or high is not None and value > high):
        raise ValueError(f"{value!r} is not from {low!r} to {high!r}")
    return F.lit(value).cast(kind)
