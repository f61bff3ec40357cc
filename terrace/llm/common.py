"""What several operators share: the shared folder, written intermediate tables, bounded labelled samples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrace.shared import new_folder, remove_folder

#: Documents handled at once inside a task, and bytes of more than one; bound a task's memory whatever the Arrow batch size and the texts.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 21
#: Strata of a sample unless said otherwise, the most frequent ones.
STRATA = 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table written in the shared folder and read again: a cut in the lineage that survives lost executors. The folder goes
    with the scratch() around it, if there is one."""
    spark = df.sparkSession
    path = new_folder(spark, f"terrace/{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(df: DataFrame) -> None:
    """Deletes the files behind a table of written() that nothing reads any more."""
    spark = df.sparkSession
    for f in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/terrace/" in f:
            remove_folder(spark, f)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds).cast("int")


def sampled(df: DataFrame, key: str, stratum: str, most: int, strata: int = STRATA) -> DataFrame:
    """At most `most` rows of each of the `strata` most frequent strata, chosen by a hash of the key.

    Two passes over two narrow columns: the strata are counted, then thinned by hash to about twice `most`, and only
    what is left is ranked, so that no stratum meets whole in one task. Nothing is collected.
    """
    counts = df.groupBy(F.col(stratum).alias("_stratum")).count().orderBy(F.desc("count"), "_stratum").limit(strata)
    shares = counts.select("_stratum", (F.lit(2.0 * most + 50) / F.col("count")).alias("_share"))
    at = F.abs(F.xxhash64(F.col(key).cast("string")) % 1_000_003) / 1_000_003.0
    thin = df.join(F.broadcast(shares), F.col(stratum).eqNullSafe(F.col("_stratum"))).where(at <= F.col("_share")).drop("_stratum", "_share")
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key).cast("string")), key))
    return thin.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def bounded(rows: DataFrame, size: str, total: int, key: str = "doc_id") -> DataFrame:
    """Of a sample of rows (a bounded number), in the order of a hash of their key, as many as have sizes of `total` in all; a row that
    has a sixteenth of it alone is left out. Rows are taken whole or not at all."""
    order = Window.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit(3)), key, size)
    fit = rows.where(F.col(size) <= total // 16).withColumn("_sum", F.sum(size).over(order))
    return fit.where(F.col("_sum") <= total).drop("_sum")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, folds: int = 5) -> DataFrame:
    """doc_id, text, label of at most `most` training rows for each label value; rows of fold 0 never get in."""
    ok = labels.where((fold(F.col("doc_id"), folds) != 0) & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).distinct()
    return texts_of(docs, sampled(ok, "doc_id", "label", most))


def texts_of(docs: DataFrame, few: DataFrame) -> DataFrame:
    """The rows of few (a bounded number, with a doc_id) with one text each, that of least hash where a doc_id is repeated."""
    others = [c for c in few.columns if c != "doc_id"]
    found = plain(docs).join(F.broadcast(few), "doc_id").groupBy("doc_id", *others).agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_one"))
    return found.select("doc_id", F.col("_one.text").alias("text"), *others)


def plain(docs: DataFrame) -> DataFrame:
    """The two columns that operators read, whatever else there is."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from _halved(batch.slice(at, rows))


def _halved(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows < 2 or batch.nbytes <= SLICE_BYTES:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _halved(batch.slice(0, half))
    yield from _halved(batch.slice(half))


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """Whole texts in UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
