"""A table that is refreshed from its source by a stored high-water mark."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpoint_dir
from ..sources.writers import replace_partitions

_DAY = "_day"


class RefreshedTable:
    """A Parquet table in folders by day of `column`, with the mark of what has been read.

    refresh() reads the source from `days` days before the mark on, replaces the days that it finds, drops those in that range
    that the source no longer has, drops those that are out of the kept months, and advances the mark last. So late and changed
    rows within the range are taken in, and a run that is cut short at any point is made good by the next, which starts from the
    same mark. Rows without a time are left out; rows that come later than the range stay out. A table that has never held a row
    cannot be read.
    """

    def __init__(self, spark: SparkSession, path: str, column: str, days: int = 3, keep_months: int | None = None):
        self.spark, self.path, self.column, self.days, self.keep_months = spark, path, column, days, keep_months
        self._rows, self._marks = f"{path}/rows", f"{path}/marks"

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def mark(self) -> dt.datetime | dt.date | None:
        fs, p = self._at(self._marks)
        return self.spark.read.parquet(self._marks).agg(F.max("mark")).first()[0] if fs.exists(p) else None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self._rows).drop(_DAY)

    def _range(self, source: DataFrame) -> tuple[DataFrame, dt.date | None]:
        """What is read of the source, and the first day of it."""
        mark, time = self.mark(), F.col(self.column)
        if mark is None:
            return source.where(time.isNotNull()), None
        since = (mark.date() if isinstance(mark, dt.datetime) else mark) - dt.timedelta(days=self.days)
        return source.where(time >= F.lit(since).cast(source.schema[self.column].dataType)), since  # a constant, which the scan gets

    def refresh(self, source: DataFrame) -> None:
        fresh, since = self._range(source)
        staged = f"{checkpoint_dir(self.spark)}/refresh/{uuid.uuid4().hex}"  # so that the source is read once
        fresh.withColumn(_DAY, F.to_date(self.column)).write.parquet(staged)
        rows = self.spark.read.parquet(staged)
        days = {r[_DAY]: r["top"] for r in rows.groupBy(_DAY).agg(F.max(self.column).alias("top")).collect()}  # a row for each day
        if days:
            replace_partitions(rows.hint("rebalance", _DAY), self._rows, [_DAY])
        self._drop(since, days)
        if days:
            self._advance(max(days.values()))
        fs, p = self._at(staged)
        fs.delete(p, True)

    def _drop(self, since: dt.date | None, days: dict) -> None:
        """Folders of days that are gone from the source, or too old to keep."""
        fs, p = self._at(self._rows)
        if not fs.exists(p):
            return
        held = {dt.date.fromisoformat(n.partition("=")[2]): n for n in (s.getPath().getName() for s in fs.listStatus(p)) if n.startswith(f"{_DAY}=")}
        top = max([*held, *days])
        oldest = dt.date.min
        if self.keep_months is not None:
            months = top.year * 12 + top.month - 1 - self.keep_months
            oldest = dt.date(months // 12, months % 12 + 1, 1)
        for day, name in held.items():
            if day < oldest or since is not None and day >= since and day not in days:
                fs.delete(self._at(f"{self._rows}/{name}")[1], True)

    def _advance(self, mark) -> None:
        self.spark.createDataFrame([(mark,)], ["mark"]).write.mode("append").parquet(self._marks)
