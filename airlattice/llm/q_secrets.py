"""op8: secret candidates of all documents with the forest's verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.llm.common import Scratch
from airlattice.llm.queries import query, table
from airlattice.llm.secrets import scan


@query("op8_secrets")
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_chars, value_sha256, label, probability, is_secret of every candidate."""
    found = scan(table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select("doc_id", "start", F.length("value").alias("n_chars"), F.sha2("value", 256).alias("value_sha256"),
                        "label", "probability", "is_secret")
