"""The folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; one of our own where it is unset, in local mode only."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file:///tmp/checkpoints/terrace"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return (sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; removed at the end of scratch(), if it is made inside one."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


def remove_folder(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write in the shared folder inside this block is removed at its end, when the caller has written the result.
    Blocks nest; a folder belongs to the innermost one."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            remove_folder(spark, path)


def materialised(df: DataFrame) -> DataFrame:
    """df as a table written in the shared folder (under buffered/) and read again: what follows cannot fold into it, and what
    reads it twice makes it once. The folder goes with the scratch() around it; without one the caller removes it."""
    path = new_folder(df.sparkSession, "buffered/table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
