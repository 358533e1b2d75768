"""Air-quality sub-indices (H2) and the row AQI (A1) as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlattice.constants import AQI_BREAKPOINTS, AQI_INPUTS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub_index(pollutant: str, value) -> Column:
    """Index of one pollutant concentration.

    The first band whose ceiling is >= the value is used and the index interpolates
    from zero concentration: ``trunc((hi - lo) * c / ceiling + lo)``. A value above
    every band, a null, or a NaN yields 0. An unknown pollutant raises ``KeyError``.
    """
    bands = AQI_BREAKPOINTS[pollutant]
    c = _col(value).cast("double")
    expr = None
    for ceiling, hi, lo in bands:
        band_value = ((F.lit(float(hi - lo)) * c) / F.lit(float(ceiling)) + F.lit(float(lo))).cast("int")
        cond = c <= F.lit(float(ceiling))
        expr = F.when(cond, band_value) if expr is None else expr.when(cond, band_value)
    # NaN <= x is false and null <= x is null, so both fall through to 0.
    return expr.otherwise(F.lit(0))


def aqi(columns: dict | None = None) -> Column:
    """Row AQI: the largest sub-index over co, no2, o3, pm2_5, pm10, so2.

    ``columns`` maps pollutant -> column (name or Column); missing pollutants count 0.
    """
    columns = columns or {p: p for p in AQI_INPUTS}
    parts = [sub_index(p, columns[p]) if p in columns else F.lit(0) for p in AQI_INPUTS]
    return F.greatest(*parts)


def sub_index_sql(pollutant: str, value_sql: str) -> str:
    """The same index as an SQL CASE text, for views registered with ``spark.sql``."""
    bands = AQI_BREAKPOINTS[pollutant]
    whens = " ".join(
        f"WHEN {value_sql} <= {float(ceiling)} THEN "
        f"CAST(trunc({float(hi - lo)} * {value_sql} / {float(ceiling)} + {float(lo)}) AS INTEGER)"
        for ceiling, hi, lo in bands
    )
    return f"(CASE {whens} ELSE 0 END)"
