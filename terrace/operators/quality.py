"""Comparison, data quality, drift and lineage checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compare(expected: DataFrame, actual: DataFrame, keys: Sequence[str], measure: str, tolerance: float = 0.01) -> DataFrame:
    """keys, expected, actual, ok: within the relative tolerance; a row that one side lacks is not ok, two NULLs are."""
    e = expected.select(*keys, F.col(measure).alias("expected"), F.lit(1).alias("_e"))
    a = actual.select(*keys, F.col(measure).alias("actual"), F.lit(1).alias("_a"))
    both = e.join(a, list(keys), "full")
    near = F.abs(F.col("expected") - F.col("actual")) <= tolerance * F.abs("expected")
    same = F.col("expected").eqNullSafe(F.col("actual")) | F.coalesce(near, F.lit(False))
    return both.select(*keys, "expected", "actual", (same & F.col("_e").isNotNull() & F.col("_a").isNotNull()).alias("ok"))


def null_ratio(c: Column) -> Column:
    """Share of NULL or empty values."""
    return F.avg(F.when(c.isNull() | (c.cast("string") == ""), 1.0).otherwise(0.0))


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each column: rows, nulls, distinct, least, greatest. Each column is counted by value on its own, from a scan of
    that column, so that no row is multiplied and no task holds the distinct values."""
    found = None
    for c in columns:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        total = lambda n: F.coalesce(F.sum(n), F.lit(0).cast("bigint"))
        row = values.agg(
            total("n").alias("n_rows"), total(F.when(F.col("v").isNull(), F.col("n"))).alias("n_nulls"), F.count("v").alias("n_distinct"),
            F.min("v").cast("string").alias("least"), F.max("v").cast("string").alias("greatest"),
        ).select(F.lit(c).alias("column_name"), "*")
        found = row if found is None else found.union(row)
    return found


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n_rows, n_distinct, ratio of distinct values to rows; NULL for an empty table."""
    found = profile(df, columns)
    return found.select("column_name", "n_rows", "n_distinct", F.try_divide(F.col("n_distinct").cast("double"), F.col("n_rows")).alias("ratio"))


def counts_agree(expected: DataFrame, actual: DataFrame, columns: Sequence[str], share: float = 0.02, least: int = 2) -> DataFrame:
    """column_name, expected, actual, ok: distinct values differ by no more than `least` or that share of the expected ones."""
    e, a = profile(expected, columns), profile(actual, columns)
    both = e.select("column_name", F.col("n_distinct").alias("expected")).join(a.select("column_name", F.col("n_distinct").alias("actual")), "column_name")
    return both.withColumn("ok", F.abs(F.col("expected") - F.col("actual")) <= F.greatest(F.lit(float(least)), F.col("expected") * share))


#: From the narrowest on; a type takes in those before it.
WIDTHS = ("boolean", "int", "bigint", "double", "string")
_DATES = ("date", "timestamp")


def widened(a: str, b: str) -> str:
    """The narrowest type that holds both: of numbers, of dates, or text."""
    if a == b:
        return a
    if a in _DATES and b in _DATES:
        return "timestamp"
    if "boolean" in (a, b) or a not in WIDTHS or b not in WIDTHS:
        return "string"
    return max(a, b, key=WIDTHS.index)


def drift_table(old: DataFrame, new: DataFrame) -> DataFrame:
    """kind, column_name of every change between two schemas."""
    rows = [(kind, x if isinstance(x, str) else x[0]) for kind, found in schema_drift(old, new).items() for x in found]
    return old.sparkSession.createDataFrame(rows, "kind string, column_name string")


def coercions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns and the share of their values that can be read as integer, real or date: a date's year is from 1 to 9999, as SQL has
    it, though Spark alone reads up to seven digits and a sign as a year."""
    dated = lambda c: F.coalesce(F.year(F.col(c).try_cast("date")).between(1, 9999), F.lit(False))
    read = lambda c, t: dated(c) if t == "date" else F.col(c).try_cast(t).isNotNull()
    share = lambda c, t: F.avg(F.when(read(c, t), 1.0).otherwise(0.0))
    one = df.agg(*[share(c, t).alias(f"{c}_{t}") for c in columns for t in ("bigint", "double", "date")])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{c}_{t}").alias(f"as_{t}") for t in ("bigint", "double", "date")]) for c in columns])
    return one.select(F.inline(rows))


def schema_drift(old: DataFrame, new: DataFrame) -> dict[str, list]:
    """added, removed and retyped columns; a removed and an added one of the same type and place count as renamed."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    added, removed = [c for c in b if c not in a], [c for c in a if c not in b]
    renamed = [(x, y) for x in removed for y in added if a[x] == b[y] and old.columns.index(x) == new.columns.index(y)]
    return {
        "added": [c for c in added if c not in [y for _, y in renamed]],
        "removed": [c for c in removed if c not in [x for x, _ in renamed]],
        "renamed": renamed,
        "retyped": [(c, a[c], b[c]) for c in a if c in b and a[c] != b[c]],
    }


def settings_drift(old: Mapping, new: Mapping) -> dict[str, list]:
    """The same for connection settings."""
    return {"added": sorted(new.keys() - old.keys()), "removed": sorted(old.keys() - new.keys()), "changed": sorted(k for k in old.keys() & new.keys() if old[k] != new[k])}


def column_overlap(a: DataFrame, b: DataFrame) -> float:
    """Jaccard similarity of the column names."""
    x, y = {c.lower() for c in a.columns}, {c.lower() for c in b.columns}
    return len(x & y) / len(x | y) if x | y else 0.0


def name_similarity(a: str, b: str) -> float:
    """Jaccard similarity of letter pairs."""
    pairs = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    x, y = pairs(a.lower()), pairs(b.lower())
    return len(x & y) / len(x | y) if x | y else float(a.lower() == b.lower())


_PERSONAL = r"(?i)(e.?mail|phone|mobile|ssn|social.?sec|passport|birth|address|zip|postal|card.?n|iban|salary|(first|last|full|user|customer|c).?name)"


def personal_columns(df: DataFrame) -> list[str]:
    """Columns whose names suggest personal data."""
    import re

    return [c for c in df.columns if re.search(_PERSONAL, c)]


def definition_conflicts(models: Mapping[str, Mapping[str, str]]) -> list[tuple[str, list[str]]]:
    """Measures that several models define unlike each other, with the models. Spaces and case count in quoted texts and names only;
    a sum in another order is another definition."""
    import re

    parts = lambda text: re.split(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)""", text)
    plain = lambda text: tuple(p if i % 2 else "".join(p.lower().split()) for i, p in enumerate(parts(text)))
    names = sorted({m for held in models.values() for m in held})
    unlike = [m for m in names if len({plain(held[m]) for held in models.values() if m in held}) > 1]
    return [(m, [model for model, held in models.items() if m in held]) for m in unlike]


def unmet(needs: Mapping[str, Sequence[str]], columns: Sequence[str]) -> list[tuple[str, str]]:
    """(measure, name) of what measures need and neither a measure nor a column is. A cycle of measures is an error."""
    order_of([(n, m) for m, all_of in needs.items() for n in all_of])
    return [(m, n) for m, all_of in needs.items() for n in all_of if n not in needs and n not in columns]


def order_of(edges: Sequence[tuple[str, str]]) -> list[str]:
    """Names so that each comes after what it needs; edges (needed, needing). A cycle is an error."""
    from graphlib import TopologicalSorter

    graph: dict[str, set[str]] = {}
    for a, b in edges:
        graph.setdefault(a, set())
        graph.setdefault(b, set()).add(a)
    return list(TopologicalSorter({k: sorted(graph[k]) for k in sorted(graph)}).static_order())


def deep_equal(a: Column, b: Column, kind: T.DataType, tolerance: float = 0.0) -> Column:
    """Whether two values of one type agree, whatever is inside: numbers within the relative tolerance (of the larger one), NaN with NaN, lists in
    order and of one length, maps by key, structs by field, NULL with NULL. Never NULL."""
    if isinstance(kind, T.ArrayType):
        inner = F.forall(F.zip_with(a, b, lambda x, y: deep_equal(x, y, kind.elementType, tolerance)), lambda hit: hit)
        inner = (F.size(a) == F.size(b)) & inner
    elif isinstance(kind, T.MapType):
        keys = F.array_sort(F.map_keys(a))
        inner = (F.size(a) == F.size(b)) & F.forall(keys, lambda k: F.map_contains_key(b, k) & deep_equal(F.try_element_at(a, k), F.try_element_at(b, k), kind.valueType, tolerance))
    elif isinstance(kind, T.StructType):
        inner = F.lit(True)
        for f in kind.fields:
            inner = inner & deep_equal(a[f.name], b[f.name], f.dataType, tolerance)
    elif isinstance(kind, T.NumericType) and tolerance:
        x, y = a.cast("double"), b.cast("double")
        inner = (F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y))) | (a == b)
    else:
        inner = a == b
    return F.coalesce(F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(inner), F.lit(False))


def compare_deep(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """keys, column_name, kind of each difference: a value that differs, or a row that is missing or extra (column_name NULL). Columns
    of another type, or that one side lacks, are an error: they differ before any row is read."""
    columns = [c for c in expected.columns if c not in keys]
    if (a := dict(expected.dtypes)) != (b := dict(actual.dtypes)):
        raise TypeError(f"the types differ: {sorted(set(a.items()) ^ set(b.items()))}")
    left, right = (df.select(*keys, F.struct(*columns).alias(name)) for df, name in ((expected, "__e"), (actual, "__a")))
    right = right.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__a")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    both = left.join(right, on, "full")
    difference = lambda c, kind: F.struct(F.lit(c).cast("string").alias("column_name"), F.lit(kind).alias("kind"))
    values = [F.when(~deep_equal(F.col("__e")[c], F.col("__a")[c], expected.schema[c].dataType, tolerance), difference(c, "differs")) for c in columns]
    found = F.when(F.col("__a").isNull(), F.array(difference(None, "missing"))).when(F.col("__e").isNull(), F.array(difference(None, "extra"))).otherwise(F.array_compact(F.array(*values)))
    named = [F.when(F.col("__e").isNull(), F.col(f"__k{i}")).otherwise(F.col(k)).alias(k) for i, k in enumerate(keys)]
    return both.select(*named, F.inline(found))


def row_counts(expected: DataFrame, actual: DataFrame, keys: Sequence[str], share: float = 0.0) -> DataFrame:
    """keys, expected, actual, ok: rows of each group on both sides, within that share of the expected ones; a group that one side lacks has 0."""
    e, a = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit(s)) for s, df in enumerate((expected, actual)))
    both = e.unionByName(a).groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0).cast("long")).alias(n) for s, n in enumerate(("expected", "actual"))])
    return both.withColumn("ok", F.abs(F.col("expected") - F.col("actual")) <= F.col("expected") * share)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and a fingerprint of the rows, whatever order they stand in: the sums of two hashes of each, repeated rows counted. Columns
    go by name."""
    names = sorted(df.columns)
    values = [F.col(f"`{c}`") for c in names]
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), *values, *[v.isNull() for v in values]).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws(":", F.lit(",".join(names)), h(1).cast("string"), h(2).cast("string")).alias("fingerprint"))


def renamed_by_values(old: DataFrame, new: DataFrame, least: float = 0.5) -> DataFrame:
    """removed, added, likeness: columns that went and columns that came, of one type, whose distinct values have a Jaccard similarity of
    `least` or more, by sketches of the values; exact up to some thousand distinct ones."""
    from .joins import column_sketches

    a, b = dict(old.dtypes), dict(new.dtypes)
    pairs = [(x, y) for x in a for y in b if x not in b and y not in a and a[x] == b[y]]
    schema = "removed string, added string"
    spark = old.sparkSession
    if not pairs:
        return spark.createDataFrame([], schema + ", likeness double")
    held = column_sketches({"old": old, "new": new}, {("old", x) for x, _ in pairs} | {("new", y) for _, y in pairs})
    side = lambda t, c, s: held.where(F.col("table") == t).select(F.col("column").alias(c), F.col("sketch").alias(s))
    met = spark.createDataFrame(pairs, schema).join(side("old", "removed", "x"), "removed").join(side("new", "added", "y"), "added")
    both = F.theta_sketch_estimate(F.theta_intersection("x", "y")) / F.theta_sketch_estimate(F.theta_union("x", "y"))
    return met.select("removed", "added", both.alias("likeness")).where(F.col("likeness") >= least)
