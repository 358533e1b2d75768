"""Aggregate column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_avg(c, scale: int | None = None, over=None) -> Column:
    """Mean of a column; with ``scale`` the sum is taken in DECIMAL(38, scale).

    A decimal sum does not depend on the order rows arrive in, so the mean is the same
    on every run and every partitioning (a double sum is not). Use it for values that
    lie on a 10^-scale grid.
    """
    col = F.col(c) if isinstance(c, str) else c

    def w(agg: Column) -> Column:
        return agg.over(over) if over is not None else agg

    if scale is None:
        return w(F.avg(col))
    n = w(F.count(col))
    return F.when(n > 0, w(F.sum(col.cast(f"decimal(38,{scale})"))).cast("double") / n)


def sql_exact_avg(c: str, scale: int) -> str:
    """The same mean as SQL text (for oracle queries)."""
    return (f"(CASE WHEN count({c}) > 0 THEN CAST(sum(CAST({c} AS DECIMAL(38,{scale}))) AS DOUBLE)"
            f" / count({c}) END)")
