"""op5: quality score of every document, learned from the folds that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import fold
from airlattice.llm.quality import learn, predict
from airlattice.llm.queries import query, table


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    out = fold(F.col("doc_id"), 5) == 0
    model = learn(docs, table(spark, sf_dir, "labels").where(~out))
    return predict(docs, model, out.alias("held_out"))
