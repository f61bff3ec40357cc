"""Harmonic packing of token sequences.

A document's ids (its text's and an end id) are cut into pieces whose lengths are floor(capacity / k) for whole k: as many
pieces of the whole capacity as it has, then time and again the longest such length that is not over what is left. All
pieces of class k have one length, and k of them fill a bin, so every class fills its bins with a fixed count, on its own:
a piece's bin and offset follow from its ordinal within its class. A task counts its pieces by class; sums of these counts
over the tasks turn its ordinals into the class's. Only each class's last bin may stay open. The pieces of these open bins,
fewer than k for each class whatever the input (some 4,500 in all at 1,024), are packed by best fit.

Null texts count as empty and yield the end id alone; repeated or null doc_ids are packed as documents of their own; other
columns are ignored; an empty table yields no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import byte_bpe

CAPACITY = 1024
PIECES = pa.schema(
    [("part", pa.int32()), ("k", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
)
PIECES_DDL = "part int, k int, ordinal long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@lru_cache(maxsize=4096)
def cut(rest: int, capacity: int) -> tuple[tuple[int, int], ...]:
    """(class, length) of the pieces of fewer ids than the capacity, longest first."""
    out = []
    while rest:
        k = -(-capacity // rest)
        k += capacity // k > rest
        out.append((k, capacity // k))
        rest -= capacity // k
    return tuple(out)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, longest first into the fullest bin that has room."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: dict[int, list[int]] = {}
    opened = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = [r for r in room if r >= size and room[r]]
        if fits:
            left = min(fits)
            b = room[left].pop()
        else:
            left, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - left
        room.setdefault(left - size, []).append(b)
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """The pieces of documents(doc_id, text) with their class and their ordinal among a task's pieces of that class."""

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe(tokenizer_path), TaskContext.get().partitionId()
        end, met = end_id.to_bytes(4, "little"), np.zeros(capacity + 1, np.int64).tolist()
        for batch in common.slices(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = bpe.encode(text) + end
                n, at = len(ids) // 4, 0
                for k, length in ((1, capacity),) * (n // capacity) + cut(n % capacity, capacity):
                    rows.append((part, k, met[k], doc_id, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), n))
                    met[k] += 1
                    at += length
            yield common.record(PIECES, list(zip(*rows, strict=True)) or [[]] * len(PIECES))

    return common.plain(docs).mapInArrow(cut_all, PIECES_DDL)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (ids without padding) per piece."""
    cutting = common.written(pieces(docs, capacity, end_id, tokenizer_path), "pieces")
    counts = cutting.groupBy("k", "part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("k", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # one row for each class, of which there are `capacity` at most
    totals = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("_n").alias("n")).collect()}
    first, full = 0, []
    for k in sorted(totals):
        full.append((k, first, totals[k] // k * k))
        first += totals[k] // k
    classes = docs.sparkSession.createDataFrame(full, "k int, _first long, _closed long")
    placed = cutting.join(bases, ["k", "part"]).join(F.broadcast(classes), "k").withColumn("_nth", F.col("_base") + F.col("ordinal"))
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"]
    closed = placed.where("_nth < _closed").withColumns(
        {
            "sequence_id": F.expr("_first + _nth div k"),
            "offset": F.expr("_nth % k * length"),
            "sequence_tokens": F.expr("k * length"),
        }
    )

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_nth"], ascending=[False, True])
        bins, rows["offset"] = best_fit(rows["length"].to_numpy(), capacity)
        rows["sequence_id"] = bins + first
        rows["sequence_tokens"] = rows.groupby("sequence_id")["length"].transform("sum")
        return rows[out]

    ddl = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
    rest = placed.where("_nth >= _closed").groupBy(F.lit(0).alias("_all")).applyInPandas(lambda _, rows: fill(rows), ddl)
    return closed.select(out).unionByName(rest)


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1,024 ids. Null and empty texts are their end id; rows of one doc_id are packed each."""
    return pack(common.table(spark, sf_dir, "documents"))
