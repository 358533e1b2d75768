"""op6: benchmark items held by documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlattice.llm.decontam import find_leaks
from airlattice.llm.queries import query, table


@query("op6_decontam")
def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, bm25, question_overlap, answer_overlap: one row per document and test item it leaks."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
