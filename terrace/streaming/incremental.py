"""Streaming forms: file streams, windowed aggregates with watermarks, incremental refresh."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_each: int = 100) -> DataFrame:
    """New files of a folder as a stream, so many in a micro-batch."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_each).load(path)


def windowed(df: DataFrame, time: str, length: str, keys: Sequence[str], measures: Mapping[str, Column], late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Measures by time window and keys; rows later than the watermark are left out, and state before it is dropped.

    The same on a table and on a stream.
    """
    w = F.window(time, length, slide) if slide else F.window(time, length)
    found = df.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(*[m.alias(n) for n, m in measures.items()])
    return found.select(F.col("window.start").alias("window_start"), *keys, *measures)


def between(df: DataFrame, column: str, start, end) -> DataFrame:
    """[start, end): the range of an incremental refresh."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def refresh_range(anchor: Column, keep_months: int = 12, refresh_days: int = 3) -> dict[str, Column]:
    """What a rolling refresh keeps and what it reads again, up to the day after the anchor."""
    end = F.date_add(anchor.cast("date"), 1)
    return {"keep_from": F.add_months(end, -keep_months), "refresh_from": F.date_add(end, -refresh_days), "end": end}


def date_column(columns: Sequence[str]) -> str | None:
    """The best column to refresh by: an update date before a creation date before any date."""
    for mark in ("updat", "modif", "creat", "date", "time", "ts"):
        found = [c for c in columns if mark in c.lower()]
        if found:
            return found[0]
    return None


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Each key's last row by `order`, then by its other columns. A largest value and not a window, so that a hot key costs one
    row for each task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not order and not rest:
        return df.distinct()
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def upsert(stream: DataFrame, keys: Sequence[str], apply: Callable[[DataFrame, int], None], checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Each micro-batch, its last row of each key by `order`, is handed to `apply`; runs until the source is read."""

    def each(batch: DataFrame, n: int) -> None:
        apply(latest(batch, keys, order), n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
