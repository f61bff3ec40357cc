"""Hard negatives by a pivot table: the rows of another label that come nearest below an anchor's positives.

Inner products become distances: a row gets one more component, the root of what its squared length lacks to the longest row's,
and an anchor a zero; then |anchor - row|^2 = |anchor|^2 + longest^2 - 2 * product. Each row's distances to a few pivots are
stored beside it. By the triangle inequality they bracket its distance to an anchor, and so its product; the products of rows
whose bracket meets a window of wanted scores are computed, exactly, in whole numbers.

A row lives in the cell of its nearest pivot, dealt by hash into parts that a task can hold. An anchor is searched in its own
cell first; its best scores there raise the window's lower end, and it goes on to the cells whose range of distances can still
reach the window. Positives and negatives are searched in the same way, positives in the parts of the anchor's label. What
reaches the driver: one row for each length of vectors, one for each cell, and SAMPLE rows of a length for the choice of
its pivots. Only the choice of pivots hangs on the sample; the result is exact whatever it is. Lengths beyond the LENGTHS most
frequent have no pivots: their rows are one cell, and all of it is checked.

Rows with a null vec_id, label or vector, or with a null or non-finite component, take no part. A component x counts as
floor(scale * x), within 2^100 either way; a score beyond 64 bits counts as the nearest that fits. Vectors are compared with
those of their own length; empty ones have the score 0. Equal rows are one row. Rows that repeat an id with another label or
vector are rows of their own, told apart by the columns anchor_row and positive_row (a hash); a row with the anchor's id is
never its positive or negative. Equal scores go by vec_id, then by that hash. An anchor without positives, or a positive
without negatives in its window, gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

PIVOTS, SAMPLE, LENGTHS = 16, 2048, 32
#: Components of the vectors that a task holds at a time.
HELD = 1 << 21
LEAST, MOST = -(2**63) + 1, 2**63 - 1
_KINDS = {1: "<i2", 2: "<i4", 4: "<f8"}  # bytes of a component, halved


def packed(v: np.ndarray) -> bytes:
    """Whole numbers in doubles as the smallest kind of components that holds them."""
    top = np.abs(v).max(initial=0)
    return v.astype("<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8").tobytes()


def unpacked(vectors: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((len(vectors), n))
    for i, b in enumerate(vectors):
        if n:
            out[i] = np.frombuffer(b, _KINDS[len(b) // (2 * n)])
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of x with y, all whole numbers: exact, and held within 64 bits."""
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(1, len(y)) < 2**53:
        return (x @ y).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    return np.array([min(MOST, max(LEAST, int((whole(row) * whole(y)).sum()))) for row in x], np.int64)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, n (length), v (whole numbers), square (squared length), row (hash) of the rows that take part, equal ones once."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("v", pa.binary()), ("square", pa.float64())])
        for batch in common.slices(batches, 1024):
            rows = []
            for vec_id, label, v in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True):
                if None not in (vec_id, label, v) and None not in v:
                    a = np.array(v, np.float64)
                    if np.isfinite(a).all():
                        a = np.clip(np.floor(np.clip(a, -(2.0**110), 2.0**110) * scale), -(2.0**100), 2.0**100) + 0.0
                        rows.append((vec_id, label, len(a), packed(a), float(a @ a)))
            yield common.record(out, list(zip(*rows, strict=True)) or [[]] * 5)

    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return plain.mapInArrow(pick, "vec_id long, label long, n int, v binary, square double").distinct().withColumn("row", F.xxhash64("label", "v"))


class Pivots:
    """Points far apart, and the distances to them of rows and anchors of one length. longest: the largest squared length."""

    def __init__(self, sample: np.ndarray, longest: float, pivots: int = PIVOTS):
        self.longest = longest
        points = self._raised(sample)
        far, chosen = ((points - points.mean(axis=0)) ** 2).sum(axis=1), []
        for _ in range(min(pivots, len(points))):
            k = int(np.argmax(far))
            if chosen and not far[k] > 0:
                break
            chosen.append(points[k])
            apart = ((points - points[k]) ** 2).sum(axis=1)
            far = apart if len(chosen) == 1 else np.minimum(far, apart)
        self.points = np.array(chosen)

    def _raised(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        more = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(0.0, self.longest - (x * x).sum(axis=1)))
        return np.concatenate([x, more[:, None]], axis=1)

    def distances(self, x: np.ndarray, anchors: bool = False) -> np.ndarray:
        x = self._raised(x, anchors)
        return np.stack([np.sqrt(((x - p) ** 2).sum(axis=1)) for p in self.points], axis=1).astype(np.float32)


def bracket(low: np.ndarray, high: np.ndarray, own: np.ndarray, square: float, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest score that an anchor can have with rows whose distances to the pivots (the first axis) are from low
    to high. Distances are rounded to 32 bits, which the slack outweighs."""
    whole = square + longest
    least = np.maximum(np.maximum(own[:, None] - high, low - own[:, None]).max(axis=0, initial=0), 0).astype(np.float64)
    most = (high + own[:, None]).min(axis=0, initial=np.float32(np.inf)).astype(np.float64)
    slack = 1e-5 * whole + 1
    return (whole - most * most) / 2 - slack, (whole - least * least) / 2 + slack


class Index:
    """The pivot table of quantised rows: table (rows with cell and d, the distances) and, by length, the cells."""

    def __init__(self, rows: DataFrame, held: int = HELD, pivots: int = PIVOTS):
        self.rows = rows = common.written(rows, "quantised")
        longest = {r["n"]: r["longest"] for r in rows.groupBy("n").agg(F.max("square").alias("longest")).collect()}
        sample: dict[int, list[bytes]] = {}
        for r in common.sampled(rows.select("vec_id", "n", "v"), "vec_id", "n", SAMPLE, LENGTHS).collect():
            sample.setdefault(r["n"], []).append(bytes(r["v"]))
        self.longest = longest
        self.pivots = of = {n: Pivots(unpacked(sorted(some), n), longest[n], pivots) for n, some in sample.items()}

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.slices(batches, 1024):
                lengths, vectors = batch.column("n").to_numpy(), batch.column("v").to_pylist()
                cells, distances = np.zeros(len(vectors), np.int32), [[]] * len(vectors)
                for n in of.keys() & set(lengths.tolist()):
                    at = np.flatnonzero(lengths == n)
                    d = of[n].distances(unpacked([vectors[i] for i in at], n))
                    cells[at] = d.argmin(axis=1)
                    for i, x in zip(at, d, strict=True):
                        distances[i] = x
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(distances, pa.list_(pa.float32()))], names=[*batch.schema.names, "cell", "d"])

        schema = "vec_id long, label long, n int, v binary, square double, row long, cell int, d array<float>"
        self.table = common.written(rows.mapInArrow(measure, schema), "pivot-table")
        ends = [f(F.get("d", F.lit(i))).alias(f"{name}{i}") for i in range(pivots) for name, f in (("low", F.min), ("high", F.max))]
        #: by length: (cell, its parts, its least and greatest distances to the pivots)
        self.cells: dict[int, list[tuple[int, int, np.ndarray, np.ndarray]]] = {}
        for r in self.table.groupBy("n", "cell").agg(F.count("*").alias("rows"), *ends).collect():
            known = range(len(of[r["n"]].points) if r["n"] in of else 0)
            low, high = (np.array([r[f"{name}{i}"] for i in known], np.float32) for name in ("low", "high"))
            self.cells.setdefault(r["n"], []).append((r["cell"], -(-r["rows"] * max(1, r["n"]) // held), low, high))


_WINDOWS = pa.list_(pa.struct([("w", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))
_PLACED = pa.schema(
    [("n", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("within", pa.int64()), ("query", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("row", pa.int64()), ("v", pa.binary()), ("square", pa.float64()), ("d", pa.list_(pa.float32())), ("windows", _WINDOWS)]
)
_DDL = "n int, cell int, part int, within long, query long, vec_id long, label long, row long, v binary, square double, d array<float>, windows array<struct<w:int,low:long,high:long>>"


def _visits(index: Index, asked: DataFrame, same: bool, own_cell: bool) -> DataFrame:
    """A row for each anchor and part that it has to search: those of its own cell, or those of the others that can reach a window."""
    pivots, cells, longest = index.pivots, index.cells, index.longest

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 256):
            rows = []
            for q in batch.to_pylist():
                d = pivots[q["n"]].distances(unpacked([q["v"]], q["n"]), anchors=True)[0] if q["n"] in pivots else np.zeros(0, np.float32)
                for cell, parts, low, high in cells[q["n"]]:
                    if own_cell != (cell == q["cell"]):
                        continue
                    least, most = bracket(low[:, None], high[:, None], d, q["square"], longest[q["n"]])
                    if own_cell or any(w["low"] <= most[0] and w["high"] >= least[0] for w in q["windows"]):
                        rows += [(q["n"], cell, part, q["label"] if same else None, q["query"], q["vec_id"], q["label"], q["row"], q["v"], q["square"], d, q["windows"]) for part in range(parts)]
            yield common.record(_PLACED, list(zip(*rows, strict=True)) or [[]] * len(_PLACED))

    return asked.select("query", "vec_id", "label", "row", "n", "v", "square", "cell", "windows").mapInArrow(place, _DDL)


def _found(index: Index, asked: DataFrame, want: int, same: bool, own_cell: bool) -> DataFrame:
    """query, w, vec_id, row, score: of each part that is searched, the best `want` rows of each window."""
    parts, longest = {(n, c): p for n, some in index.cells.items() for c, p, _, _ in some}, index.longest

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1024):
            part = [h % parts[n, c] for n, c, h in zip(*(batch.column(c).to_pylist() for c in ("n", "cell", "h")), strict=True)]
            nothing = [None] * batch.num_rows
            of = {**{c: batch.column(c) for c in ("n", "cell", "vec_id", "label", "row", "v", "square", "d")}, "part": part, "within": batch.column("label") if same else nothing, "query": nothing, "windows": nothing}
            yield common.record(_PLACED, [of[c] for c in _PLACED.names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("query", pa.int64()), ("w", pa.int32()), ("vec_id", pa.int64()), ("row", pa.int64()), ("score", pa.int64())])
        here, held, ready = None, [], None
        for batch in common.slices(batches, 1024):
            found: list[tuple] = []
            for r in batch.to_pylist():
                if (key := (r["n"], r["cell"], r["part"], r["within"])) != here:
                    here, held, ready = key, [], None
                if r["query"] is None:  # a part's rows come before its anchors
                    held.append((r["vec_id"], r["label"], r["row"], r["v"], r["d"]))
                    continue
                if not held:
                    continue
                if ready is None:
                    ids, labels, rows, v, d = zip(*held, strict=True)
                    ready = np.array(ids, np.int64), np.array(labels, np.int64), np.array(rows, np.int64), unpacked(v, r["n"]), np.array(d, np.float32).T
                    held = [True]
                ids, labels, rows, vectors, table = ready
                others = ids != r["vec_id"]
                if not same:
                    others &= labels != r["label"]
                if len(table):
                    least, most = bracket(table, table, np.array(r["d"], np.float32), r["square"], longest[r["n"]])
                    maybe = others & np.logical_or.reduce([(most >= w["low"]) & (least <= w["high"]) for w in r["windows"]])
                else:
                    maybe = others
                at = np.flatnonzero(maybe)
                anchor = unpacked([r["v"]], r["n"])[0]
                score = products(vectors, anchor)[at] if 4 * len(at) > len(ids) else products(vectors[at], anchor)
                for w in r["windows"]:
                    ok = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
                    if len(ok) > want:
                        ok = ok[score[ok] >= np.partition(score[ok], len(ok) - want)[len(ok) - want]]
                    ok = ok[np.lexsort((rows[at[ok]], ids[at[ok]], -score[ok]))][:want]
                    found += [(r["query"], w["w"], int(ids[i]), int(rows[i]), int(s)) for i, s in zip(at[ok], score[ok], strict=True)]
            yield common.record(out, list(zip(*found, strict=True)) or [[]] * 5)

    data = index.table.withColumn("h", F.pmod(F.xxhash64("vec_id", "row"), F.lit(1 << 40))).mapInArrow(deal, _DDL)
    placed = data.union(_visits(index, asked, same, own_cell)).repartition("n", "cell", "part", "within")
    return placed.sortWithinPartitions("n", "cell", "part", "within", F.col("query").isNotNull()).mapInArrow(search, "query long, w int, vec_id long, row long, score long")


def _best(found: DataFrame, want: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query", "w").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= want)


def search(index: Index, asked: DataFrame, want: int, same: bool) -> DataFrame:
    """query, w, vec_id, row, score, rank: of each window of each anchor the best `want` rows of the same or of other labels.
    asked: rows of the index's table with query (a number) and windows (w, low, high: the scores wanted)."""
    first = common.written(_best(_found(index, asked, want, same, True), want), "own-cells")
    reached = first.where(F.col("rank") == want).select(F.col("query").alias("_query"), F.col("w").alias("_w"), F.col("score").alias("_reached"))
    windows = asked.select("query", F.explode("windows").alias("x")).select("query", "x.*")
    raised = windows.join(reached, (F.col("query") == F.col("_query")) & (F.col("w") == F.col("_w")), "left")
    raised = raised.select("query", F.struct("w", F.greatest("low", "_reached").alias("low"), "high").alias("x")).groupBy("query").agg(F.collect_list("x").alias("windows"))
    rest = _found(index, asked.drop("windows").join(raised, "query"), want, same, False)
    return _best(first.drop("rank").unionByName(rest), want)


def mined(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, **how) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row, positive_row: for the first `positives`
    rows of each anchor's label the first `negatives` rows of other labels that score from low to high per cent of the positive.
    vectors: vec_id, embedding, label. anchors: the vec_id of the anchors."""
    index = Index(quantised(vectors, scale), **how)
    asked = index.table.join(anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
    asked = common.written(asked.withColumn("query", F.monotonically_increasing_id()), "anchors")  # the anchors' numbers are settled here
    any_score = F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).alias("low"), F.lit(MOST).alias("high")))
    near = common.written(search(index, asked.withColumn("windows", any_score), positives, True), "positives")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("query", pa.int64()), ("w", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])
        for batch in batches:
            rows = [(q, w, -(-low * s // 100), high * s // 100) for q, w, s in zip(*(batch.column(c).to_pylist() for c in ("query", "rank", "score")), strict=True)]
            yield common.record(out, list(zip(*[r for r in rows if r[2] <= r[3]], strict=True)) or [[]] * 4)

    windows = near.select("query", "rank", "score").mapInArrow(bounded, "query long, w int, low long, high long")
    windows = windows.groupBy("query").agg(F.collect_list(F.struct("w", "low", "high")).alias("windows"))
    far = search(index, asked.join(windows, "query"), negatives, False).select("query", "w", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("query", F.col("rank").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("row").alias("positive_row"))
    own = asked.select("query", F.col("vec_id").alias("anchor_id"), F.col("row").alias("anchor_row"))
    return far.join(near, ["query", "w"]).join(own, "query").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_row", "positive_row")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of five positives of the rows whose vec_id is divisible by 50, the labels of every seventh id moved on.
    Rows without a label or a usable vector take no part."""
    vectors = common.table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(vectors.withColumn("label", moved), vectors.where("vec_id % 50 = 0").select("vec_id"))
