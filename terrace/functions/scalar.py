"""Scalar functions with the null rules of the business-intelligence formulas: Column in, Column out, no Python per row.

Undefined is NULL, never an error: division by zero, roots and logarithms outside their domain, text that is no number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_lit = lambda x: x if isinstance(x, Column) else F.lit(x)


# logic
def iif(test: Column, yes, no, unknown=None) -> Column:
    return F.when(test, _lit(yes)).when(~test, _lit(no)).otherwise(_lit(unknown))


def case(c: Column, pairs: Sequence[tuple], default=None) -> Column:
    out = None
    for value, result in pairs:
        out = F.when(c == _lit(value), _lit(result)) if out is None else out.when(c == _lit(value), _lit(result))
    return out.otherwise(_lit(default))


def isnull(c: Column) -> Column:
    return c.isNull()


def ifnull(a: Column, b) -> Column:
    return F.coalesce(a, _lit(b))


def nullif(a: Column, b) -> Column:
    return F.nullif(a, _lit(b))


def zn(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def isnumber(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def isdate(c: Column) -> Column:
    return c.try_cast("date").isNotNull()


def least_of(a: Column, b) -> Column:
    """NULL if either is."""
    b = _lit(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def greatest_of(a: Column, b) -> Column:
    b = _lit(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


# text
def length(c: Column) -> Column:
    return F.length(c)


def left(c: Column, n: int) -> Column:
    return F.left(c, F.lit(n))


def right(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def mid(c: Column, start: int, n: int | None = None) -> Column:
    return F.substring(c, F.lit(start), F.lit(n) if n is not None else F.length(c))


def contains(c: Column, text: str) -> Column:
    return c.contains(text)


def starts_with(c: Column, text: str) -> Column:
    """Leading spaces do not count."""
    return F.ltrim(c).startswith(text)


def ends_with(c: Column, text: str) -> Column:
    """Trailing spaces do not count."""
    return F.rtrim(c).endswith(text)


def find(c: Column, text: str, start: int = 1) -> Column:
    """From 1; 0 if it is not there."""
    return F.locate(text, c, start)


def find_nth(c: Column, text: str, n: int) -> Column:
    times = F.floor((F.length(c) - F.length(F.replace(c, F.lit(text), F.lit("")))) / len(text))
    return F.when(c.isNull(), None).when(times >= n, F.length(F.substring_index(c, text, n)) + 1).otherwise(0)


def split(c: Column, delimiter: str, token: int = 1) -> Column:
    """From 1, or from the end if negative; empty beyond."""
    return F.split_part(c, F.lit(delimiter), F.lit(token))


def space(n: int) -> Column:
    return F.repeat(F.lit(" "), F.lit(n))


def proper(c: Column) -> Column:
    return F.initcap(c)


def text(c: Column) -> Column:
    return c.cast("string")


def regexp_match(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def regexp_extract(c: Column, pattern: str, group: int = 1) -> Column:
    """NULL without a match; an empty match is empty."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def regexp_replace(c: Column, pattern: str, new: str) -> Column:
    return F.regexp_replace(c, pattern, new)


# numbers
def to_int(c: Column) -> Column:
    """Cut towards zero; NULL for text that is no number. Whole numbers are exact, whatever their size."""
    return F.coalesce(c.try_cast("bigint"), c.try_cast("double").try_cast("bigint"))


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def divide(a: Column, b) -> Column:
    return F.try_divide(a.cast("double"), _lit(b).cast("double"))


def div(a: Column, b) -> Column:
    """Integer quotient, cut towards zero; NULL for zero."""
    return F.call_function("div", a, F.nullif(_lit(b), F.lit(0)))


def modulo(a: Column, b) -> Column:
    """With the dividend's sign; NULL for zero."""
    return F.try_mod(a, _lit(b))


def sqrt(c: Column) -> Column:
    return F.when(c >= 0, F.sqrt(c))


def ln(c: Column) -> Column:
    return F.when(c > 0, F.ln(c))


def log(c: Column, base: float = 10) -> Column:
    return F.when(c > 0, F.log10(c) if base == 10 else F.ln(c) / math.log(base))


def power(c: Column, n) -> Column:
    return F.pow(c.cast("double"), _lit(n))


def asin(c: Column) -> Column:
    return F.when(F.abs(c) <= 1, F.asin(c))


def acos(c: Column) -> Column:
    return F.when(F.abs(c) <= 1, F.acos(c))


def cot(c: Column) -> Column:
    return F.try_divide(F.lit(1.0), F.tan(c))


def hexbin(x: Column, y: Column) -> tuple[Column, Column]:
    """The centre of the hexagon of side 1 that the point lies in: the centres are two rectangular grids, shifted by half a cell,
    and the nearer of a point's two nearest is its own."""
    wide = F.sqrt(F.lit(3.0))
    a = (wide * F.round(x / wide), F.lit(3.0) * F.round(y / 3.0))
    b = (wide * (F.floor(x / wide) + 0.5), F.lit(3.0) * (F.floor(y / 3.0) + 0.5))
    away = lambda c: (x - c[0]) * (x - c[0]) + (y - c[1]) * (y - c[1])
    near = away(a) <= away(b)
    return F.when(near, a[0]).otherwise(b[0]), F.when(near, a[1]).otherwise(b[1])


def distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance in the radius's unit."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.when(h > 1, F.lit(1.0)).otherwise(F.sqrt(h)))


_RAW = ("UPPER", "LOWER", "TRIM", "LENGTH", "ABS", "ROUND")


def raw_sql(function: str, c: Column) -> Column:
    """A function by name, from a short list."""
    if function.upper() not in _RAW:
        raise ValueError(f"{function} is not one of {', '.join(_RAW)}")
    return F.call_function(function.lower(), c)


# dates
def date_part(part: str, c: Column) -> Column:
    """weekday is 1 on Sundays, week that of ISO 8601, iso-weekday 1 on Mondays."""
    plain = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "weekday": F.dayofweek, "week": F.weekofyear, "iso-week": F.weekofyear}
    if part == "second":
        return F.second(c)
    if part == "iso-weekday":
        return F.weekday(c) + 1
    if part == "iso-year":
        return F.extract(F.lit("YEAROFWEEK"), c)
    if part == "iso-quarter":
        return F.quarter(F.date_add(F.trunc(c, "week"), 3))
    return plain[part](c)


def date_name(part: str, c: Column) -> Column:
    named = {"month": "MMMM", "weekday": "EEEE"}
    return F.date_format(c, named[part]) if part in named else date_part(part, c).cast("string")


def date_trunc(part: str, c: Column, week_start: int = 1) -> Column:
    """week_start: 1 Monday to 7 Sunday."""
    if part == "week" and week_start != 1:
        return F.date_trunc("week", c - F.make_dt_interval(F.lit(week_start - 1))) + F.make_dt_interval(F.lit(week_start - 1))
    return F.date_trunc(part, c)


def date_diff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of the part between a and b."""
    if part in ("hour", "minute", "second"):
        span = {"hour": 3600, "minute": 60, "second": 1}[part]
        return ((F.unix_timestamp(F.date_trunc(part, b)) - F.unix_timestamp(F.date_trunc(part, a))) / span).cast("bigint")
    if part == "day":
        return F.datediff(b, a)
    if part == "week":
        return (F.datediff(F.date_trunc("week", b), F.date_trunc("week", a)) / 7).cast("int")
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if part == "quarter":
        return (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)
    return {"month": months, "year": F.year(b) - F.year(a)}[part]


def date_add(part: str, n: int, c: Column) -> Column:
    """Days beyond a month's end become its last day."""
    months = {"month": 1, "quarter": 3, "year": 12}
    if part in months:
        return c + F.make_ym_interval(F.lit(0), F.lit(n * months[part]))
    days = {"day": 1, "week": 7}
    if part in days:
        return c + F.make_dt_interval(F.lit(n * days[part]))
    seconds = {"hour": 3600, "minute": 60, "second": 1}[part] * n
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))


def make_date(y: Column, m: Column, d: Column) -> Column:
    """NULL for a day that there is not."""
    return F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")).try_cast("date")


def make_datetime(y: Column, m: Column, d: Column, hour: Column, minute: Column, second: Column) -> Column:
    """NULL for a time that there is not."""
    return F.try_make_timestamp(y, m, d, hour, minute, second)


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """hh:mm:ss as text; NULL outside a day."""
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    return F.when(ok, F.concat_ws(":", *[F.lpad(c.cast("string"), 2, "0") for c in (hour, minute, second)]))


def date_parse(pattern: str, c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern))


# clock
def now(at=None) -> Column:
    """The moment of the query, one for all its rows; `at` (a datetime or a Column) stands for it in tests and repeated runs."""
    return F.current_timestamp() if at is None else _lit(at)


def today(at=None) -> Column:
    """The day of now()."""
    return now(at).cast("date")


def date_plus(c: Column, days) -> Column:
    """A date, or a time, so many days later; parts of a day count for times. NULL beyond the calendar."""
    n = _lit(days).cast("double")
    whole = F.floor(n).try_cast("int")
    at = c.cast("timestamp_ntz") + F.make_dt_interval(whole, F.lit(0), F.lit(0), F.round((n - F.floor(n)) * 86400, 6).cast("decimal(18,6)"))
    return at


def days_between(a: Column, b: Column) -> Column:
    """Days from b to a, with parts of a day."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp_ntz").cast("timestamp")) / 1e6
    return (seconds(a) - seconds(b)) / 86400
