"""Corpus pipeline: each stage reads what the one before it kept, written as Parquet between them.

quality -> near duplicates -> decontamination -> secrets -> mixing. All stages but the last return the
columns of documents. Null and empty texts: rated like any text, never duplicates, never
leaks. Where ids repeat or are missing, the stages that go by id number the rows themselves: every
row is a document of its own. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, fold, unused
from airlattice.llm.decontam import without_leaks
from airlattice.llm.mixing import mix
from airlattice.llm.neardup import near_duplicates
from airlattice.llm.quality import keep_good, learn
from airlattice.llm.secrets import redact, scan

DROPPED_ROWS = 1_000_000   # ids of 8 bytes that may be sent to every task


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates good; it learns from four of five folds of the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_good(docs, learn(docs, labels.where(fold(F.col("doc_id"), 5) != 0)))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents and a column that tells all their rows apart: doc_id, or a number written with them."""
    again = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1")
    if again.isEmpty():
        return docs, "doc_id"
    key = unused(docs, "row_number")
    return Scratch(docs.sparkSession).save(docs.withColumn(key, F.monotonically_increasing_id()), "numbered"), key


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (5-word shingles, similarity 0.8): that of the smallest id."""
    rows, key = _keyed(docs)
    found = near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), Scratch(spark), words=5, percent=80)
    dropped = found.where("NOT kept").select(F.col("doc_id").alias(key))
    if key != "doc_id":     # numbers do not follow the ids
        own = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group")).join(
            rows.select(F.col(key).alias("_row"), F.col("doc_id").alias("_id")), "_row")
        first = own.groupBy("_group").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("_first"))
        dropped = own.join(first.select(F.col("_first._row").alias("_row")), "_row", "left_anti").select(F.col("_row").alias(key))
    if dropped.count() <= DROPPED_ROWS:
        dropped = F.broadcast(dropped)
    return rows.join(dropped, key, "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked."""
    rows, key = _keyed(docs)
    found = scan(rows.select(F.col(key).alias("doc_id"), "text", "source"), Scratch(spark))
    return redact(rows, found, key).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: how many words to take of each document; none taken, none listed."""
    return mix(docs, Scratch(spark)).where(F.col("taken") > 0)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("secrets", secrets), ("mixing", mixing)]

# The stages fit models and match fuzzily, which SQL does not state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
    return docs
