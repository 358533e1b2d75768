"""op10: language of every document, learned from the folds that are not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import fold
from airlattice.llm.langid import identify
from airlattice.llm.queries import query, table


@query("op10_langid")
def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; rejected marks texts far from every centroid."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = fold(F.col("doc_id"), 3) == 1
    found = identify(docs, docs.where(~out), out.alias("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
