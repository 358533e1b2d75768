"""op1: lattice likelihood and add-one baseline of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch, fold
from airlattice.llm.queries import query, table
from airlattice.llm.scoring import score


@query("op1_lattice")
def op1_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fold(F.col("doc_id"), 7) == 2, Scratch(spark))
