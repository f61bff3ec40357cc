"""Value cleaning: Column in, Column out."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def replace_text(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def replace_value(c: Column, old, new) -> Column:
    """The whole value; NULL can be replaced too."""
    return F.when(c.eqNullSafe(F.lit(old)), F.lit(new)).otherwise(c)


def replace_nulls(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def replace_errors(c: Column, kind: str, value) -> Column:
    """c as that type; the value where it has none."""
    return F.coalesce(c.try_cast(kind), F.lit(value))


def clean(c: Column) -> Column:
    """Without control characters."""
    return F.regexp_replace(c, r"[\x00-\x1F\x7F]", "")


def trim_spaces(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def proper(c: Column) -> Column:
    """Title case by space-separated words."""
    return F.initcap(c)


def remove_letters(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{L}", "")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{N}", "")


def remove_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{P}", "")


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def before(c: Column, mark: str) -> Column:
    """What stands before the first mark; all if there is none."""
    return F.substring_index(c, mark, 1)


def after(c: Column, mark: str) -> Column:
    """What stands after the first mark; empty if there is none."""
    return F.when(c.contains(mark), F.substring(c, F.locate(mark, c) + len(mark), F.length(c))).when(c.isNotNull(), F.lit(""))


def within(c: Column, start: str, end: str) -> Column:
    return F.regexp_extract(c, f"{re.escape(start)}(.*?){re.escape(end)}", 1)


def pad(c: Column, width: int, fill: str = " ", left: bool = True) -> Column:
    return F.lpad(c, width, fill) if left else F.rpad(c, width, fill)


def fill_down(c: Column, over: WindowSpec) -> Column:
    """The last value that is not NULL, up to this row of the ordered window."""
    return F.last(c, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def fill_up(c: Column, over: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing))


def remap(c: Column, values: Mapping[str, str]) -> Column:
    """NULL and values that are not named stay."""
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def replace_chain(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """One whole-value replacement after the other."""
    for old, new in pairs:
        c = replace_value(c, old, new)
    return c


def json_field(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_record(c: Column, schema: str) -> Column:
    return F.from_json(c, schema)


def xml_record(c: Column, schema: str) -> Column:
    return F.from_xml(c, schema)
