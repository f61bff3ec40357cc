"""From raw documents to packed sequences: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes to the shared folder as Parquet and reads
again as the next one's docs. The first four return the columns of documents. Both quality stages learn from the labelled
rows of the tables in sf_dir, whatever docs they are to judge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrace.llm import common, line_dedup, packing, passage_quality, quality_rules, simhash
from terrace.shared import new_folder, remove_folder, scratch


#: Texts in an Arrow batch, of which a task holds two: Spark's own number is made for narrow rows.
BATCH = 1000


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches from here on, if the session has Spark's own number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lean(spark)
    trees = quality_rules.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality_rules.keep(docs, trees)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = passage_quality.fit(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return passage_quality.keep(docs, model)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose every line is in earlier ones lose all their words, and go."""
    return line_dedup.deduplicated(docs, keep_emptied=False)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("line dedup", line_dedup_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Learned models and token ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's table goes when the next one is written, and what a stage writes for itself when its own is."""
    docs, before = common.table(spark, sf_dir, "documents"), ""
    for name, stage in STAGES:
        path = new_folder(spark, f"terrace/{name.replace(' ', '-')}")
        with scratch(spark):
            found = stage(spark, docs, sf_dir)
            found.write.parquet(path)
        if before:
            remove_folder(spark, before)
        docs, before = spark.read.schema(found.schema).parquet(path), path
    return docs
