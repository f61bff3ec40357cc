"""Row-level change capture: what differs between two snapshots, and its application to a partitioned table.

A change is a row of the table with _change (insert, update or delete) and _version (a number that grows from snapshot to
snapshot); of a deleted row only the keys are given. Keys name a row within a snapshot; a NULL key is a key like any other. Of
rows that repeat a key the largest one counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..shared import remove_folder
from ..sources.writers import replace_partitions
from .incremental import latest, upsert

#: Column that a kept table is partitioned by: a hash of the key.
BUCKET = "_bucket"


def row_hash(columns: Sequence[str]) -> Column:
    """128 bits of a row's values; NULL and missing places count, so that no value can pass into its neighbour."""
    values = [F.col(c) for c in columns] + [F.col(c).isNull() for c in columns]
    return F.struct(F.xxhash64(F.lit(1), *values).alias("a"), F.xxhash64(F.lit(2), *values).alias("b"))


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right, strict=True):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def changes(old: DataFrame, new: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """The rows that turn one snapshot into the other. Of the old one only keys and hashes are shuffled."""
    rest = [c for c in new.columns if c not in keys]
    mine = [f"_old_{i}" for i in range(len(keys))]
    before = latest(old.select(*new.columns), keys, []).select(*[F.col(k).alias(m) for k, m in zip(keys, mine, strict=True)], row_hash(rest).alias("_was"))
    after = latest(new, keys, []).withColumn("_is", row_hash(rest))
    met = after.join(before, _same(keys, mine), "full")
    kind = F.when(F.col("_was").isNull(), "insert").when(F.col("_is").isNull(), "delete").when(F.col("_was") != F.col("_is"), "update")
    key = {k: F.when(F.col("_is").isNull(), F.col(m)).otherwise(F.col(k)).alias(k) for k, m in zip(keys, mine, strict=True)}
    found = met.withColumn("_change", kind).where("_change is not null")
    return found.select(*[key.get(c, F.col(c)) for c in new.columns], "_change", F.lit(version).cast("long").alias("_version"))


class KeptTable:
    """A Parquet table in buckets of its key's hash, to which changes are applied; a change rewrites the buckets it falls in.

    Every row keeps the version of its last change, and a change is applied only to a row of no later version, so a batch that
    is applied again, whole or in part, leaves the table as it is. A deleted row is left out; its batch may be repeated, but not
    one before it, as streams never do. The new buckets are written whole beside the table before any old one is touched: a run
    that is cut short while they replace the old ones is made good by the next apply(), or by recover().
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.columns = schema.fieldNames()
        self._pending = f"{path}.pending"
        self._schema = StructType([*schema.fields]).add("_version", "long").add(BUCKET, "integer")

    def _placed(self, df: DataFrame) -> DataFrame:
        """NULL keys count as such: they are hashed by the flag."""
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys, *[F.col(k).isNull() for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def recover(self) -> None:
        """Puts in place what a run that was cut short has written whole."""
        if self._exists(f"{self._pending}/_SUCCESS"):
            replace_partitions(self.spark.read.schema(self._schema).parquet(self._pending), self.path, [BUCKET])
        remove_folder(self.spark, self._pending)

    def _held(self) -> DataFrame:
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(self.path).where("_version is not null")

    def read(self) -> DataFrame:
        return self._held().select(*self.columns)

    def apply(self, batch: DataFrame) -> None:
        """batch: changes of any versions; the last one of each row counts."""
        self.recover()
        last = self._placed(latest(batch.select(*self.columns, "_change", "_version"), self.keys, ["_version"]))
        touched = sorted(r[BUCKET] for r in last.select(BUCKET).distinct().collect())  # `buckets` at most
        if not touched:
            return
        held = self._held().where(F.col(BUCKET).isin(touched))  # reads these folders only
        rows = last.withColumn("_new", F.lit(1)).unionByName(held.withColumns({"_new": F.lit(0), "_change": F.lit("held")}))
        rest = [c for c in self.columns if c not in self.keys]
        best = rows.groupBy(*self.keys, BUCKET).agg(F.max(F.struct("_version", "_new", "_change", *rest)).alias("_row"))
        kept = best.where("_row._change != 'delete'").select(*[c if c in self.keys else F.col("_row")[c].alias(c) for c in self.columns], "_row._version", BUCKET)
        # an overwrite by folders leaves a folder without rows as it was: each touched one gets a row without a version
        marks = self.spark.createDataFrame([(b,) for b in touched], f"{BUCKET} int")
        out = kept.unionByName(marks, allowMissingColumns=True).hint("rebalance", BUCKET)
        out.write.partitionBy(BUCKET).parquet(self._pending)
        self.recover()


def keep_up(stream: DataFrame, table: KeptTable, checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes, micro-batch by micro-batch, until the source is read."""
    return upsert(stream, table.keys, lambda batch, _: table.apply(batch), checkpoint, ["_version"])
