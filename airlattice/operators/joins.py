"""Join helpers shared by the operators.

Only tables built from constants (bands, names, zones) are broadcast by a hint.
Data-derived small sides (per-sensor statistics, catalogues) are left to AQE, which
measures the materialised shuffle output at run time and converts the join to a
broadcast only under ``spark.sql.adaptive.autoBroadcastJoinThreshold``; above it the
sort-merge join stays, and AQE's skew-join split handles a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_constant(df: DataFrame) -> DataFrame:
    """Broadcast a table built from constants (size known when the plan is written)."""
    return F.broadcast(df)


def join_stats(big: DataFrame, stats: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join per-key statistics back to the rows they were computed from.

    The statistics side has one row per key; AQE decides broadcast vs. shuffle from its
    measured size, so nothing is broadcast blind.
    """
    return big.join(stats, on=keys, how=how)
