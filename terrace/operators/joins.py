"""Joins, blends and relationship checks. Catalyst picks the strategy from statistics; nothing is broadcast by hand."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import checkpoint_dir
from .quality import name_similarity, widened

HOW = {
    "inner": "inner", "left": "left", "right": "right", "full": "full",
    "leftOnly": "left_anti", "rightOnly": "left_anti", "semi": "left_semi",
}


def _on(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], nulls_match: bool) -> Column:
    out = None
    for a, b in keys:
        hit = left[a].eqNullSafe(right[b]) if nulls_match else left[a] == right[b]
        out = hit if out is None else out & hit
    return out


def join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner", nulls_match: bool = False) -> DataFrame:
    """Joins on pairs of key columns; column names of the sides differ. rightOnly and notInner give rows without a partner."""
    if how == "rightOnly":
        return join(right, left, [(b, a) for a, b in keys], "leftOnly", nulls_match)
    if how == "notInner":
        return join(left, right, keys, "leftOnly", nulls_match).unionByName(join(left, right, keys, "rightOnly", nulls_match), allowMissingColumns=True)
    return left.join(right, _on(left, right, keys, nulls_match), HOW[how])


def cross(left: DataFrame, right: DataFrame, most: int = 10_000) -> DataFrame:
    """All pairs, which is what is asked for; the side that is known to hold `most` rows or fewer is sent to the other's tasks.
    Two larger tables are an error, as nobody reads all pairs of them."""
    for small, other, first in ((right, left, True), (left, right, False)):
        if small.limit(most + 1).count() <= most:
            pairs = other.crossJoin(F.broadcast(small))
            return pairs if first else pairs.select(*[left[c] for c in left.columns], *[right[c] for c in right.columns])
    raise ValueError(f"both sides hold more than {most} rows")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, keys: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows whose point lies in the other side's [low, high).

    Intervals are dealt into the buckets of `width` that they touch and points into their own, so that the join has an
    equality to shuffle on instead of a nested loop.
    """
    p = left.withColumn("_bucket", F.floor(F.col(point) / width))
    r = right.where(F.col(high) > F.col(low)).withColumn("_slots", F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    r = r.withColumn("_slot", F.explode("_slots")).drop("_slots")
    on = (p["_bucket"] == r["_slot"]) & (p[point] >= r[low]) & (p[point] < r[high])
    for a, b in keys:
        on = on & (p[a] == r[b])
    return p.join(r, on).drop("_bucket", "_slot")


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: Sequence[str], bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """For each left row the values of the last right row of its key at or before its time; of right rows at one time, the
    largest values. Right rows without key or time match nothing.

    Both sides are laid in one ordered window by key and bucket of time, and the last right row before each bucket comes from one
    row for each bucket: a key with a large share of all rows is spread over its buckets. `bucket` is a function of time that
    never falls; dates and timestamps go by day if none is given, other kinds of time by key alone.
    """
    from pyspark.sql.window import Window

    if bucket is None and dict(left.dtypes)[left_time] in ("date", "timestamp", "timestamp_ntz"):
        bucket = lambda at: F.date_trunc("day", at)
    picked = F.struct(F.col("_t"), *values)
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"))
    b = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key), F.col(right_time).alias("_t"), *values, F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_seen", F.when(F.col("_side") == 0, picked))
    before = F.lit(None).cast(both.schema["_seen"].dataType)
    by = [key]
    if bucket:
        both, by = both.withColumn("_bucket", bucket(F.col("_t"))), [key, "_bucket"]
        ends = both.groupBy(*by).agg(F.max("_seen").alias("_end"))
        earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(F.col(key).alias("_key"), F.col("_bucket").alias("_of"), F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
        both = both.join(ends, both[key].eqNullSafe(F.col("_key")) & both["_bucket"].eqNullSafe(F.col("_of")), "left").drop("_key", "_of")
        before = F.col("_before")
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.coalesce(F.max("_seen").over(w), before))
    return found.where("_side = 1").withColumns({v: F.col("_last")[v] for v in values}).drop("_t", "_side", "_seen", "_last", "_bucket", "_before")


def related(many: DataFrame, one: DataFrame, keys: Sequence[tuple[str, str]], columns: Sequence[str]) -> DataFrame:
    """Attributes of the one side on the rows of the many side."""
    side = one.select(*[b for _, b in keys], *[c for c in columns if c not in [b for _, b in keys]])
    return many.join(side, _on(many, side, keys, False), "left").drop(*[side[b] for _, b in keys if b not in columns])


def lookup(df: DataFrame, table: DataFrame, keys: Sequence[tuple[str, str]], value: str) -> DataFrame:
    """The value of the key's only row; NULL where rows disagree."""
    one = table.groupBy(*[b for _, b in keys]).agg(F.when(F.min(value).eqNullSafe(F.max(value)), F.min(value)).alias(value))
    return df.join(one, _on(df, one, keys, False), "left").drop(*[one[b] for _, b in keys])


def blend(primary: DataFrame, secondary: DataFrame, links: Sequence[tuple[str, str]], measures: Mapping[str, Column]) -> DataFrame:
    """The secondary's measures at the grain of the links, on the rows of the primary: no row of it is multiplied. Without links the
    two are appended, columns by name."""
    if not links:
        return primary.unionByName(secondary, allowMissingColumns=True)
    side = secondary.groupBy(*[F.col(b).alias(f"_link_{i}") for i, (_, b) in enumerate(links)]).agg(*[m.alias(n) for n, m in measures.items()])
    on = None
    for i, (a, _) in enumerate(links):
        hit = primary[a] == side[f"_link_{i}"]
        on = hit if on is None else on & hit
    return primary.join(side, on, "left").drop(*[f"_link_{i}" for i in range(len(links))])


def is_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: whether the key names a row, measured."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.agg((F.max("n") <= 1).alias("is_unique"), F.count("*").alias("keys"), F.sum("n").alias("n_rows"))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct child keys without a parent."""
    keys = child.select(F.col(child_key).alias("key")).where("key is not null")
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti").distinct()


def aligned_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], how: str = "inner") -> DataFrame:
    """A join whose keys may differ in type: both sides take the narrowest type that holds both."""
    a, b = dict(left.dtypes), dict(right.dtypes)
    for x, y in keys:
        kind = widened(a[x], b[y])
        left, right = left.withColumn(x, F.col(x).cast(kind)), right.withColumn(y, F.col(y).cast(kind))
    return join(left, right, keys, how)


#: Types whose values can be a key, by family: keys of one family compare as text.
_FAMILY = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole", "string": "text", "date": "date"}


def _stems(df: DataFrame) -> dict[str, str]:
    """Column names in lower case, without the prefix that all columns of a table share."""
    head = df.columns[0].partition("_")[0] + "_"
    shared = len(df.columns) > 1 and all(c.startswith(head) for c in df.columns)
    return {c: (c[len(head) :] if shared else c).lower() for c in df.columns}


def _alike(tables: Mapping[str, DataFrame], least: float) -> list[tuple[str, str, str, str, float]]:
    """Pairs of key columns (child, child_column, parent, parent_column) of one family with names alike: those of the columns, or
    the child's and the parent's table and column together."""
    stems = {t: _stems(df) for t, df in tables.items()}
    out = []
    for c, child in tables.items():
        for p, parent in tables.items():
            for x, a in child.dtypes:
                for y, b in parent.dtypes:
                    if c != p and a in _FAMILY and _FAMILY[a] == _FAMILY.get(b):
                        named = max(name_similarity(stems[c][x], stems[p][y]), name_similarity(stems[c][x].replace("_", ""), (p + stems[p][y]).replace("_", "").lower()))
                        if named >= least:
                            out.append((c, x, p, y, named))
    return out


#: Logarithm of the hashes that a column's sketch keeps: shares are off by some per cent.
SKETCH_K = 12


def column_sketches(tables: Mapping[str, DataFrame], columns: set[tuple[str, str]]) -> DataFrame:
    """table, column, rows (with a value), sketch of the distinct values (as text): a row for each column. Each table is read once, and
    no value is shuffled: a task passes on one sketch of each column."""
    out, spark = None, next(iter(tables.values())).sparkSession
    for t, df in tables.items():
        mine = [c for c in df.columns if (t, c) in columns]
        if not mine:
            continue
        value = lambda c: F.col(f"`{c}`").cast("string")
        one = df.agg(*[f.alias(f"{n}{i}") for i, c in enumerate(mine) for n, f in (("r", F.count(value(c))), ("s", F.theta_sketch_agg(F.concat(F.lit("="), value(c)), SKETCH_K)))])  # a sketch leaves out empty texts
        cells = [F.struct(F.lit(c).alias("column"), F.col(f"r{i}").alias("rows"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(mine)]
        found = one.select(F.lit(t).alias("table"), F.inline(F.array(*cells)))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no columns to sketch")
    checkpoint_dir(spark)
    return out.checkpoint()


def likely(tables: Mapping[str, DataFrame], pairs: Sequence[tuple[str, str, str, str, float]], slack: float = 0.1) -> list[tuple[str, str, str, str, float]]:
    """Of pairs (child, child_column, parent, parent_column, ...) those whose sketches do not rule them out: the parent's values may be
    distinct, and some of the child's may be among them. The sketches err by less than `slack`."""
    if not pairs:
        return []
    held = column_sketches(tables, {(t, c) for a, x, b, y, *_ in pairs for t, c in ((a, x), (b, y))})
    spark = held.sparkSession
    asked = spark.createDataFrame([(i, a, x, b, y) for i, (a, x, b, y, *_) in enumerate(pairs)], "i int, child string, child_column string, parent string, parent_column string")
    child = held.select(F.col("table").alias("child"), F.col("column").alias("child_column"), F.col("sketch").alias("mine"))
    parent = held.select(F.col("table").alias("parent"), F.col("column").alias("parent_column"), "rows", F.col("sketch").alias("theirs"))
    met = asked.join(child, ["child", "child_column"]).join(parent, ["parent", "parent_column"])
    distinct, both = F.theta_sketch_estimate("theirs"), F.theta_sketch_estimate(F.theta_intersection("mine", "theirs"))
    found = met.where((distinct >= F.col("rows") * (1 - slack)) & (both > 0)).select("i").collect()  # a number for each pair
    return [pairs[i] for i in sorted(r["i"] for r in found)]


def inferred(tables: Mapping[str, DataFrame], least: float = 0.95, alike: float = 0.5) -> DataFrame:
    """child, child_column, parent, parent_column, share, score of the relationships that names suggest and data bear out: the
    parent's column names a row, and holds that share of the child's rows with a key. score: mean of share and likeness of names.

    Every table is read twice: once for sketches, which leave the likely pairs, and once for the values of their columns, which
    are counted together, and meet by value.
    """
    named = _alike(tables, alike)
    if not named:
        raise ValueError("no columns whose names are alike")
    pairs, spark, long = likely(tables, named), next(iter(tables.values())).sparkSession, None
    columns = {(t, c) for a, x, b, y, _ in pairs for t, c in ((a, x), (b, y))}
    for t, df in tables.items():
        cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in df.columns if (t, c) in columns]
        if cells:
            rows = df.select(F.explode(F.array(*cells)).alias("_x")).select(F.lit(t).alias("table"), "_x.column", "_x.value").where("value is not null")
            long = rows if long is None else long.unionByName(rows)
    if long is None:
        return spark.createDataFrame([], "child string, child_column string, parent string, parent_column string, share double, score double")
    checkpoint_dir(spark)
    counts = long.groupBy("table", "column", "value").agg(F.count("*").alias("n")).checkpoint()
    seen = counts.groupBy("table", "column").agg(F.sum("n").alias("rows"), F.max("n").alias("most"))  # a row for each column
    asked = spark.createDataFrame(pairs, "child string, child_column string, parent string, parent_column string, named double")
    asked = asked.join(seen.select(F.col("table").alias("child"), F.col("column").alias("child_column"), "rows"), ["child", "child_column"])
    asked = asked.join(seen.where("most = 1").select(F.col("table").alias("parent"), F.col("column").alias("parent_column")), ["parent", "parent_column"])
    held = counts.select(F.col("table").alias("parent"), F.col("column").alias("parent_column"), "value")
    child = counts.select(F.col("table").alias("child"), F.col("column").alias("child_column"), "value", "n").join(F.broadcast(asked), ["child", "child_column"])  # a row for each pair of columns
    met = child.join(held, ["parent", "parent_column", "value"]).groupBy("child", "child_column", "parent", "parent_column", "named", "rows").agg(F.sum("n").alias("met"))
    share = F.col("met") / F.col("rows")
    return met.select("child", "child_column", "parent", "parent_column", share.alias("share"), ((share + F.col("named")) / 2).alias("score")).where(F.col("share") >= least)


def resolve(columns: Sequence[str], wanted: str) -> str | None:
    """The column that a relationship means: of that very name, else the only one that is the same but for case, spaces, marks
    and a table in front; None if there is none or more than one."""
    if wanted in columns:
        return wanted
    plain = lambda c: "".join(x for x in c.rpartition(".")[2].lower() if x.isalnum())
    found = [c for c in columns if plain(c) == plain(wanted)]
    return found[0] if len(found) == 1 else None


def join_path(edges: Sequence[tuple[str, str]], start: str, end: str) -> list[str] | None:
    """The tables from start to end along the fewest relationships, the earlier ones first; None if they do not meet."""
    back: dict[str, str] = {start: start}
    queue = [start]
    for table in queue:
        for a, b in edges:
            for x, y in ((a, b), (b, a)):
                if x == table and y not in back:
                    back[y] = x
                    queue.append(y)
    if end not in back:
        return None
    path = [end]
    while path[-1] != start:
        path.append(back[path[-1]])
    return path[::-1]


def diagnose(tables: Mapping[str, DataFrame], relationships: Sequence[tuple[str, str, str, str]]) -> list[tuple[str, str]]:
    """(problem, where) of a model's relationships (child, child column, parent, parent column), from schemas alone: a table or
    column that is not there, keys whose types do not compare, a second path between two tables, a table that nothing joins."""
    out, sound = [], []
    for c, x, p, y in relationships:
        where, kinds = f"{c}.{x} -> {p}.{y}", []
        for t, column in ((c, x), (p, y)):
            found = resolve(tables[t].columns, column) if t in tables else None
            if t not in tables:
                out.append(("no such table", t))
            elif found is None:
                out.append(("no such column", f"{t}.{column}"))
            else:
                kinds.append(dict(tables[t].dtypes)[found])
        if len(kinds) == 2:
            sound.append((c, p, where))
            if kinds[0] != kinds[1] and widened(*kinds) == "string":
                out.append(("types do not compare", where))
    for (_, _, where), active in zip(sound, active_edges([(c, p) for c, p, _ in sound]), strict=True):
        if not active:
            out.append(("second path", where))
    joined = {t for c, p, _ in sound for t in (c, p)}
    return out + [("joined by nothing", t) for t in tables if t not in joined]


def active_edges(edges: Sequence[tuple[str, str]]) -> list[bool]:
    """Which relationships stay active so that any two tables have one path: the earlier ones win."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for a, b in edges:
        ra, rb = root(a), root(b)
        out.append(ra != rb)
        parent[ra] = rb
    return out
