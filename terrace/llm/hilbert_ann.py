"""Approximate nearest neighbours by several shifted Hilbert orderings.

Each ordering projects the vectors on a few random directions, shifts them, cuts every direction at quantiles and numbers
the cells along a Hilbert curve. The curve's key ranges (64 of equal weight) are the partitions: a vector goes to its range
on every curve, a query to its own range and to the next on either side. There it is compared with all vectors by cosine and
keeps its nearest; the windows of all curves merge by query and are ranked once more.

The index (directions, quantiles, range ends) is fitted on the distinct vectors of a bounded sample; every row is indexed.
A vector is brought to components of 1 or less by a power of two, which keeps all its bits, so that no norm over- or underflows;
scores divide it by its largest component, so that exact multiples of one vector are ties. Equal vectors are searched once, with the smallest ids they stand for, so that a vector a third of the table holds
makes no large group. A range with more vectors than `held` is dealt out by hash, and its queries go to each part: a task
holds one part, and queries pass. A score comes from one formula, whatever window found it.

Vectors are compared with those of their own length, and each length has curves of its own, fitted on its own part of the
sample. A length with fewer than FIT distinct vectors has none, as ranges set by so few hold too few vectors for a recall of
0.9: its queries, and those whose windows held fewer than k others, are compared with all vectors of the length, block by block.

Recall at 5 against brute force is in the README; it depends on the share of a curve that a window covers, not on the size.
Vectors that are null, zero, or hold null or non-finite components take no part. A repeated vec_id is one candidate for each
of its vectors; a query is left out of its own candidates by id. Different vectors of one query id are queries of their own,
told apart by query_row, a hash of the vector; equal rows are one query. Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

CURVES, DIMENSIONS, BITS, RANGES, REACH = 32, 8, 3, 64, 1
#: Distinct vectors that the index is fitted on, and vectors of a range that a task holds.
SAMPLE, HELD = 8192, 4096
#: Distinct vectors of a length that has curves, at least; and such lengths at most, the most frequent ones.
FIT, LENGTHS = 256, 8


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of each row of cells, by the transposition of its axes."""
    x = [cells[:, i].astype(np.uint32) for i in range(cells.shape[1])]
    one, last = np.uint32(1), len(x) - 1
    for level in range(bits - 1, 0, -1):
        bit = np.uint32(1 << level)
        low = bit - one
        for i in range(len(x)):
            hit = (x[i] & bit) != 0
            swap = np.where(hit, np.uint32(0), (x[0] ^ x[i]) & low)
            x[0] = np.where(hit, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros(len(cells), np.uint32)
    for level in range(bits - 1, 0, -1):
        bit = np.uint32(1 << level)
        turn = np.where((x[last] & bit) != 0, turn ^ (bit - one), turn)
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for v in x:
            key = key << one | ((v ^ turn) >> np.uint32(level) & one)
    return key


class Curves:
    """The index: ranges(vectors) -> the key range of each vector on each curve."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dimensions: int = DIMENSIONS, bits: int = BITS, ranges: int = RANGES, seed: int = 3):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dimensions = min(dimensions, width)
        self.bits = bits
        self.direction = [np.linalg.qr(rng.normal(size=(width, width)))[0][:, :dimensions] for _ in range(curves)]
        self.cut, self.end = [], []
        for d in self.direction:
            p = sample @ d
            share = np.clip(np.linspace(0, 1, (1 << bits) + 1)[1:-1] + rng.uniform(-0.3, 0.3) / (1 << bits), 0, 1)  # the curve's shift
            self.cut.append(np.quantile(p, share, axis=0).T)
            keys = np.sort(self._keys(p, len(self.cut) - 1, sample))
            self.end.append(keys[(np.arange(1, ranges) * len(keys)) // ranges])

    def _keys(self, p: np.ndarray, c: int, x: np.ndarray) -> np.ndarray:
        cells = np.stack([np.searchsorted(cut, p[:, j]) for j, cut in enumerate(self.cut[c])], axis=1)
        # vectors of one cell are ordered by their first projection, so that a range can end inside a crowded cell
        fine = np.clip((p[:, 0] + 1) * (1 << 22), 0, (1 << 23) - 1).astype(np.uint64)
        return hilbert_keys(cells, self.bits) << np.uint64(23) | fine

    def ranges(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(end, self._keys(x @ d, c, x), side="right") for c, (d, end) in enumerate(zip(self.direction, self.end, strict=True))], axis=1)


def _rows(vectors: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(-1, width)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(axis=1, keepdims=True)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the same row of y, as scaled by _scaled()."""
    return np.clip((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1)), -1.0, 1.0)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and the vector over a power of two in doubles (v, little-endian bytes; n of them) of the rows that take part."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("vec_id", pa.int64()), ("n", pa.int32()), ("v", pa.binary())])
        for batch in batches:
            ids, found = [], []
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
                if vec_id is not None and v and None not in v:
                    a = np.array(v, np.float64)
                    top = np.abs(a).max()
                    if 0 < top < np.inf:
                        ids.append(vec_id)
                        found.append((np.ldexp(a, -int(np.frexp(top)[1])) + 0.0).tobytes())  # -0.0 and 0.0 are equal
            yield common.record(out, [ids, [len(b) // 8 for b in found], found])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(pick, "vec_id long, n int, v binary")


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v, its length n and the k + 1 smallest ids that hold it: tasks keep so many of each vector they meet before anything is grouped."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("v", pa.binary()), ("ids", pa.list_(pa.int64()))])
        met: dict[bytes, list[int]] = {}
        for batch in batches:
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held = met.setdefault(v, [])
                held.append(vec_id)
                if len(held) > 4 * (k + 1):
                    held[:] = sorted(set(held))[: k + 1]
            if len(met) > 20_000:
                yield common.record(out, [list(met), [sorted(set(x))[: k + 1] for x in met.values()]])
                met = {}
        yield common.record(out, [list(met), [sorted(set(x))[: k + 1] for x in met.values()]])

    part = rows.select("vec_id", "v").mapInArrow(least, "v binary, ids array<long>")
    whole = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return part.groupBy("v").agg(whole.alias("ids")).withColumn("n", (F.octet_length("v") / 8).cast("int"))


def _nearest(asked: np.ndarray, own: list[int], held: np.ndarray, unit: np.ndarray, ids: list[list[int]], k: int) -> list[tuple[int, int, float]]:
    """(query, place, score) of the k + 1 nearest in held of each row of asked, and of some more, without those that only
    stand for the query's own id."""
    out = []
    least, alone = np.array([x[0] for x in ids], np.int64), np.array([len(x) == 1 for x in ids])
    for i, s in enumerate(_unit(asked) @ unit.T):
        s[alone & (least == own[i])] = -np.inf
        best = np.flatnonzero(s > -np.inf)
        if len(best) > k + 1:  # the product's last bits hang on its shape: whatever may be among the nearest is scored by the one formula
            best = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1] - 1e-9)
        score = cosines(np.broadcast_to(asked[i], (len(best), asked.shape[1])), held[best])
        if len(best) > 4 * (k + 1):  # ties at the end: the smallest ids are enough
            some = sorted(range(len(best)), key=lambda j: (-score[j], least[best[j]]))[: k + 1]
            best, score = best[some], score[some]
        out += [(i, int(j), float(x)) for j, x in zip(best, score, strict=True)]
    return out


def compared(placed: DataFrame, k: int) -> DataFrame:
    """query, id, ids, score: the nearest to each query among the vectors of its place. placed: place, is_query, v, and id and
    ids: the least id and the ids of a vector, the number and the vec_id of a query."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("score", pa.float64())])
        here, vectors, ids, held, unit = None, [], [], None, None
        for batch in common.slices(batches, 1024):
            places = batch.column("place").to_numpy()
            edges = np.flatnonzero(np.diff(places)) + 1
            found: list[tuple] = []
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(places)], strict=True):
                if places[a] != here:
                    here, vectors, ids, held = places[a], [], [], None
                is_query = batch.column("is_query").slice(a, b - a).to_numpy(zero_copy_only=False)
                v, number, many = (batch.column(c).slice(a, b - a).to_pylist() for c in ("v", "id", "ids"))
                m = int((~is_query).sum())  # vectors come before queries
                vectors += v[:m]
                ids += many[:m]
                if m < b - a and vectors:
                    if held is None or len(held) != len(vectors):
                        held = _scaled(_rows(vectors, len(vectors[0]) // 8))
                        unit = _unit(held)
                    for i, j, score in _nearest(_scaled(_rows(v[m:], held.shape[1])), [x[0] for x in many[m:]], held, unit, ids, k):
                        found.append((number[m + i], ids[j][0], ids[j], score))
            yield common.record(out, list(zip(*found, strict=True)) or [[]] * 4)

    ordered = placed.repartition("place").sortWithinPartitions("place", "is_query")
    return ordered.mapInArrow(compare, "query long, id long, ids array<long>, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, **index) -> DataFrame:
    """query_id, rank, vec_id, score, query_row: the k nearest vectors(vec_id, embedding) found for each of the rows that have a
    vec_id of queries."""
    rows = common.written(valid(vectors), "vectors")
    data = common.written(distinct_vectors(rows, k), "distinct-vectors")
    lengths = data.select("n").distinct().limit(LENGTHS).count()
    sample: dict[int, set[bytes]] = {}
    for r in common.sampled(data.select(F.col("ids")[0].alias("id"), "n", "v"), "id", "n", SAMPLE // max(1, lengths), LENGTHS).collect():
        sample.setdefault(r["n"], set()).add(bytes(r["v"]))
    curves = {n: Curves(_unit(_rows(sorted(some), n)), **index) for n, some in sample.items() if len(some) >= FIT}
    asked = rows.join(queries.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi").distinct()
    asked = asked.select(F.monotonically_increasing_id().alias("query"), "vec_id", F.xxhash64("v").alias("query_row"), "n", "v")
    asked = common.written(asked, "queries")  # the numbers of the queries are settled here
    many = {r["n"]: r["count"] for r in data.where(F.col("n").isin(*curves)).groupBy("n").count().collect()} if curves else {}
    first, layout = 0, {}  # of each length with curves: its first place, its ranges on a curve, the parts of a range
    for n, c in curves.items():
        ranges = len(c.end[0]) + 1
        parts = -(-many[n] * 2 // ranges // HELD) or 1
        layout[n] = (first, ranges, parts)
        first += len(c.end) * ranges * parts

    def place(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("place", pa.int64()), ("is_query", pa.bool_()), ("id", pa.int64()), ("ids", pa.list_(pa.int64())), ("v", pa.binary())])
        for batch in common.slices(batches, 1024):
            number, v, ids, widths = (batch.column(c).to_pylist() for c in ("id", "v", "ids", "n"))
            where, of = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for n in layout.keys() & set(widths):
                (base, ranges, parts), rows_of = layout[n], np.flatnonzero(np.array(widths) == n)
                part = np.array([number[i] for i in rows_of], np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                at = curves[n].ranges(_unit(_rows([v[i] for i in rows_of], n)))
                for c in range(at.shape[1]):
                    for step in range(-REACH, REACH + 1) if query else (0,):
                        ok = np.flatnonzero((at[:, c] + step >= 0) & (at[:, c] + step < ranges))
                        to = base + (c * ranges + at[ok, c] + step) * parts
                        for p in range(parts) if query else (part[ok].astype(np.int64) % parts,):
                            where.append(to + p)
                            of.append(rows_of[ok])
            where, of = np.concatenate(where), np.concatenate(of).tolist()
            yield common.record(out, [where, [query] * len(of), [number[i] for i in of], [ids[i] for i in of], [v[i] for i in of]])

    ddl = "place long, is_query boolean, id long, ids array<long>, v binary"
    numbered = asked.select(F.col("query").alias("id"), F.array("vec_id").alias("ids"), "n", "v")
    placed = data.select(F.col("ids")[0].alias("id"), "ids", "n", "v").mapInArrow(lambda b: place(b, False), ddl).union(numbered.mapInArrow(lambda b: place(b, True), ddl))

    def ranked(near: DataFrame) -> DataFrame:
        once = near.groupBy("query", "id").agg(F.max("score").alias("score"), F.first("ids").alias("ids")).join(asked.select("query", "vec_id", "query_row"), "query")
        each = once.select("query", F.col("vec_id").alias("query_id"), "query_row", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
        nearest = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
        return each.withColumn("rank", nearest).where(F.col("rank") <= k)

    found = common.written(ranked(compared(placed, k)), "nearest")
    rest = asked.join(found.where(F.col("rank") == k), "query", "left_anti")
    blocks = -(-data.count() // HELD) or 1
    # the rest: against all vectors of the length, in blocks
    place_of = lambda block: F.shiftleft(F.col("n").cast("long"), 32) + block
    every = data.join(rest.select("n").distinct(), "n", "left_semi").select(place_of(F.pmod(F.xxhash64("v"), F.lit(blocks))).alias("place"), F.lit(False).alias("is_query"), F.col("ids")[0].alias("id"), "ids", "v")
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block")
    passing = rest.select("n", "v", "query", "vec_id", block).select(place_of(F.col("_block")).alias("place"), F.lit(True).alias("is_query"), F.col("query").alias("id"), F.array("vec_id").alias("ids"), "v")
    whole = ranked(compared(every.union(passing), k))
    done = found.join(rest.select("query"), "query", "left_anti").unionByName(whole)
    return done.select("query_id", "rank", "vec_id", "score", "query_row")


def op4_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to each row whose vec_id is divisible by 50. Rows without a usable vector take no part."""
    vectors = common.table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 50 = 0").select("vec_id"))
