"""op9: toxicity score of every document, learned from the folds that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, fold
from airlattice.llm.queries import query, table
from airlattice.llm.toxicity import learn, predict


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    out = fold(F.col("doc_id"), 4) == 2
    scratch = Scratch(spark)
    model = learn(docs, table(spark, sf_dir, "labels").where(~out), scratch)
    scratch.close()
    return predict(docs, model, out.alias("held_out"))
