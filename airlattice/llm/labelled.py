"""A bounded, seeded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of about ``per_class`` labelled documents per class, by a seeded hash.

    Only classes 0 and 1 count; conflicting repeated labels of a document keep the largest.
    The bound is on labelled rows, so the label side stays small whatever the corpus.
    """
    y = (labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
         .withColumn("draw", F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 30)) / float(1 << 30)))
    n = {r["label"]: r["n"] for r in y.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    keep = F.lit(False)
    for value, count in n.items():
        keep = keep | ((F.col("label") == value) & (F.col("draw") < per_class / count))
    ids = y.where(keep).select("doc_id", "label")
    # At most about 2 * per_class ids of two numbers each: a proven small side.
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
