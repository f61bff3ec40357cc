"""Table calculations over partitions of any size: ranks and positions, sliding frames and recursions by ranges of the rows.

The Column builders of tablecalc lay a partition in one window, which one task sorts. Here rows are laid in ranges of the
partition's keys and order; each range is worked on its own, and what passes from one to the next is a few numbers for each range.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .spread import beside, ranged

#: Rows of a block of a sliding frame, without the rows beside it that its frames reach.
BLOCK = 1 << 15
KINDS = ("index", "first", "last", "size", "rank", "dense", "modified", "percent")


def _columns(order: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c, descending in order]


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], wanted: Mapping[str, str], ties: Sequence[str] = (), lookups: Sequence[tuple[str, str, int]] = ()) -> DataFrame:
    """df with new columns. wanted: {new name: one of KINDS}; order: (column, descending), ties: columns that order rows of equal
    values, for index, first, last and lookups. lookups: (new name, column, offset), NULL beyond the partition.

    rank is 1, 2, 2, 4 and dense 1, 2, 2, 3; modified gives equal values their last rank, 1, 3, 3, 4; percent is (rank - 1) / (size - 1),
    0 for a single row; first and last are offsets to the partition's ends. NULL keys are a partition; NULLs come first, last if descending.
    """
    if unknown := set(wanted.values()) - set(KINDS):
        raise ValueError(f"no such position: {sorted(unknown)}")
    values = [c for c, _ in order]

    def within(cut: DataFrame) -> DataFrame:
        by_value = Window.partitionBy("__part", *keys).orderBy(*_columns(order))
        by_place = Window.partitionBy("__part", *keys).orderBy("__at")
        more = {"__rank": F.rank().over(by_value), "__dense": F.dense_rank().over(by_value), "__to": F.count(F.lit(1)).over(by_value.rangeBetween(Window.unboundedPreceding, 0))}
        near = {f"__near{i}": (F.lag(c, -k) if k < 0 else F.lead(c, k)).over(by_place) for i, (_, c, k) in enumerate(lookups)}
        return cut.withColumns(more | near)

    cut = ranged(df, [*[F.col(k) for k in keys], *_columns(order), *ties], within)
    value = F.struct(*values)
    ends = cut.groupBy(*keys, "__part").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__start"), F.max("__dense").alias("__d"), F.min_by(value, "__at").alias("__low"), F.max_by(value, "__at").alias("__high"),
        F.max("__rank").alias("__last_rank"), F.max(F.when(F.col("__dense") == 1, F.col("__to"))).alias("__first_to"),
    )  # fmt: skip  # a row for each range that a partition touches
    along = Window.partitionBy(*keys).orderBy("__part")
    earlier, later = along.rowsBetween(Window.unboundedPreceding, -1), along.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumn("__goes_on", F.coalesce(F.lag("__high").over(along).eqNullSafe(F.col("__low")) & F.lag("__n").over(along).isNotNull(), F.lit(False)))
    ends = ends.withColumns({
        "__before": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__size": F.sum("__n").over(Window.partitionBy(*keys)), "__next": F.coalesce(F.lead("__goes_on").over(along), F.lit(False)),
        "__values": F.coalesce(F.sum("__d").over(earlier), F.lit(0)) - F.sum(F.col("__goes_on").cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)),
    })
    one_run = F.col("__d") == 1  # its value fills the range: the run's ends lie where it begins or ends
    ends = ends.withColumns({
        "__from": F.last(F.when(~(one_run & F.col("__goes_on")), F.col("__before") + F.col("__last_rank")), ignorenulls=True).over(earlier),
        "__until": F.first(F.when(~(one_run & F.col("__next")), F.col("__before") + F.col("__first_to")), ignorenulls=True).over(later),
    })
    ends = ends.select(*keys, "__part", "__start", "__n", "__d", "__before", "__size", "__values", "__goes_on", "__next", "__from", "__until")
    rows = beside(cut, ends, [*keys, "__part"])
    index = F.col("__before") + F.col("__at") - F.col("__start") + 1
    rank = F.when(F.col("__goes_on") & (F.col("__dense") == 1), F.col("__from")).otherwise(F.col("__before") + F.col("__rank"))
    modified = F.when(F.col("__next") & (F.col("__dense") == F.col("__d")), F.col("__until")).otherwise(F.col("__before") + F.col("__to"))
    found = {
        "index": index, "first": 1 - index, "last": F.col("__size") - index, "size": F.col("__size"), "rank": rank, "dense": F.col("__values") + F.col("__dense"), "modified": modified,
        "percent": F.when(F.col("__size") > 1, (rank - 1) / (F.col("__size") - 1)).otherwise(F.lit(0.0)),
    }
    rows = rows.withColumn("__index", index)
    for i, (new, c, offset) in enumerate(lookups):
        rows = _looked_up(rows, keys, new, c, offset, f"__near{i}")
    return rows.select(*df.columns, *[(found[k] if k == "percent" else found[k].cast("long")).alias(new) for new, k in wanted.items()], *[new for new, _, _ in lookups])


def _looked_up(rows: DataFrame, keys: Sequence[str], new: str, c: str, offset: int, near: str) -> DataFrame:
    """The column `near` is right where the range holds the row that is looked up. The others meet the rows at the ranges' edges."""
    at, far = F.col("__at") - F.col("__start"), abs(offset)
    inside = (at + offset >= 0) & (at + offset < F.col("__n"))
    edges = rows.where((F.col("__n") < F.col("__size")) & ((at < far) | (at >= F.col("__n") - far)))
    edges = edges.select(*[F.col(k).alias(f"__e{i}") for i, k in enumerate(keys)], F.col("__index").alias("__place"), F.col(c).alias("__there"))
    wanted = F.when(inside, -F.col("__index")).otherwise(F.col("__index") + offset)  # no edge's place is below 1, and none is asked for twice as often as another
    on = F.col("__wanted") == F.col("__place")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__e{i}"))
    met = rows.withColumn("__wanted", wanted).join(edges, on, "left")
    return met.withColumn(new, F.when(inside, F.col(near)).otherwise(F.col("__there"))).drop("__wanted", "__place", "__there", *[f"__e{i}" for i in range(len(keys))])


def framed(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], first: int, last: int, wanted: Mapping[str, tuple], block: int = BLOCK) -> DataFrame:
    """df with order statistics of the rows from first to last, relative to each row in a total order. wanted: {new name: ("percentile",
    column, p)} interpolated between the two nearest values, or ("countd", column). NULLs are ignored; a frame without values gives NULL, or 0.

    Rows are numbered, and dealt into blocks that also hold the rows beside them that their frames reach. Along a block the
    frame's values are kept in order: a row that comes in or goes out is found by bisection, and nothing is sorted again.
    """
    if first > last:
        raise ValueError("a frame begins before it ends")
    numbered = positions(df, keys, order, {"__index": "index", "__size": "size"})
    place, end = F.col("__index") - 1, F.col("__size") - 1
    clip = lambda c: F.greatest(F.lit(0).cast("long"), F.least(c, end))
    own = F.floor(place / block)
    dealt = numbered.withColumns({"__own": own, "__block": F.explode(F.sequence(F.floor(clip(place - last) / block), F.floor(clip(place - first) / block)))})
    # a row whose own block is none of those that its value is for comes once more, for itself
    itself = numbered.withColumns({"__own": own, "__block": own})
    apart = (own < F.floor(clip(place - last) / block)) | (own > F.floor(clip(place - first) / block))
    dealt = dealt.union(itself.where(apart))
    used = sorted({spec[1] for spec in wanted.values()})
    halo = F.col("__own") != F.col("__block")
    slim = [c if c in keys or c in used else F.when(~halo, F.col(c)).alias(c) for c in df.columns]
    dealt = dealt.select(*slim, "__index", "__block", halo.alias("__halo"))
    laid = dealt.repartition(*keys, "__block").sortWithinPartitions(*keys, "__block", "__index")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {'double' if s[0] == 'percentile' else 'long'}" for n, s in wanted.items()])
    columns, group = df.columns, [*keys, "__block"]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held is not None else pa.Table.from_batches([batch])
            names = list(zip(*(held.column(c).to_pylist() for c in group), strict=True))
            done = bisect_left(range(len(names)), True, key=lambda i: names[i] == names[-1]) if names else 0  # the last block may go on
            yield from finished(held.slice(0, done), names[:done])
            held = held.slice(done)
        if held is not None:
            yield from finished(held, list(zip(*(held.column(c).to_pylist() for c in group), strict=True)))

    def finished(rows: pa.Table, names: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not names:
            return
        index, is_halo = rows.column("__index").to_pylist(), rows.column("__halo").to_pylist()
        values = {c: rows.column(c).to_pylist() for c in used}
        edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
        out = rows.filter(pa.array([not h for h in is_halo])).select(columns)
        for new, spec in wanted.items():
            found: list = []
            for a, b in zip(edges, edges[1:], strict=False):
                found += _slide(spec, values[spec[1]][a:b], index[a:b], is_halo[a:b], first, last)
            out = out.append_column(new, pa.array(found, pa.float64() if spec[0] == "percentile" else pa.int64()))
        yield from out.combine_chunks().to_batches()

    return laid.mapInArrow(along, schema)


def _slide(spec: tuple, values: list, index: list[int], is_halo: list[bool], first: int, last: int) -> list:
    """The statistic of the frame of each row that is not of the halo; index: the rows' numbers, which grow, one by one inside a frame."""
    out: list = []
    kept: list = []
    counts: Counter = Counter()
    come = gone = 0
    for i, skip in zip(index, is_halo, strict=True):
        if skip:
            continue
        while come < len(index) and index[come] <= i + last:
            if (v := values[come]) is not None:
                if spec[0] == "percentile":
                    insort(kept, v)
                else:
                    counts[v] += 1
            come += 1
        while gone < come and index[gone] < i + first:
            if (v := values[gone]) is not None:
                if spec[0] == "percentile":
                    del kept[bisect_left(kept, v)]
                else:
                    counts[v] -= 1
                    if not counts[v]:
                        del counts[v]
            gone += 1
        if spec[0] == "countd":
            out.append(len(counts))
        elif kept:
            at = (len(kept) - 1) * spec[2]
            low = int(at)
            high = min(low + 1, len(kept) - 1)
            out.append(float(kept[low] + (kept[high] - kept[low]) * (at - low)))
        else:
            out.append(None)
    return out


def previous_affine(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]], a: Column, b: Column, seed: float, new: str) -> DataFrame:
    """new = a * (new of the row before, or seed at first) + b along each partition, in a total order.

    Steps of this kind compose to one of the same kind: each range folds its own, the folds of a partition's ranges are composed in
    order, and each row's step is applied to what stands before its range. A row whose a or b is NULL gets NULL, and the next one
    goes on from the value before it.
    """
    cut = ranged(df.withColumns({"__a": a.cast("double"), "__b": b.cast("double")}), [*[F.col(k) for k in keys], *_columns(order)])
    names = cut.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, times, plus = None, 1.0, 0.0
        for batch in batches:  # a range in its order
            groups = list(zip(*(batch.column(c).to_pylist() for c in [*keys, "__part"]), strict=True))
            out_times, out_plus = [], []
            for group, x, y in zip(groups, batch.column("__a").to_pylist(), batch.column("__b").to_pylist(), strict=True):
                if group != here:
                    here, times, plus = group, 1.0, 0.0
                if x is not None and y is not None:
                    times, plus = x * times, x * plus + y
                out_times.append(times)
                out_plus.append(plus)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out_times, pa.float64()), pa.array(out_plus, pa.float64())], names=[*names, "__times", "__plus"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields) + ", __times double, __plus double"
    folded = cut.mapInArrow(fold, schema)
    ends = folded.groupBy(*keys, "__part").agg(F.max_by(F.struct("__times", "__plus"), "__at").alias("__step"))
    steps = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__part", "__step"))).alias("__steps"))  # one for each range that a partition touches
    applied = lambda times, plus, x: F.when(x == 0, plus).otherwise(times * x + plus)  # noqa: E731  no infinity times zero
    start = F.struct(F.array().cast("array<double>").alias("found"), F.lit(float(seed)).alias("x"))
    add = lambda acc, e: F.struct(F.concat(acc["found"], F.array(acc["x"])).alias("found"), applied(e["__step"]["__times"], e["__step"]["__plus"], acc["x"]).alias("x"))
    starts = steps.select(*keys, F.explode(F.arrays_zip(F.col("__steps.__part").alias("part"), F.aggregate("__steps", start, add, lambda acc: acc["found"]).alias("x"))).alias("__e"))
    starts = starts.select(*keys, F.col("__e.part").alias("__part"), F.col("__e.x").alias("__x"))
    value = F.when(F.col("__a").isNotNull() & F.col("__b").isNotNull(), applied(F.col("__times"), F.col("__plus"), F.col("__x")))
    return beside(folded, starts, [*keys, "__part"]).select(*df.columns, value.alias(new))
