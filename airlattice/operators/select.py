"""Feature selection by OLS p-values (M6) and backward elimination (M7).

The data are read once: ``series.gram_sums`` reduces every series to its sufficient
statistics (n, sums, cross-products) in one grouped aggregation. The elimination then
runs on those few numbers per series by sweeping features out (``sweep``), so it never
rescans the readings however many rounds it takes, and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from airlattice.constants import SIGNIFICANCE_LEVEL
from airlattice.operators import sweep
from airlattice.operators.series import gram_sums


def select_features(df: DataFrame, keys: list[str], x: list[str], y: str, alpha: float = SIGNIFICANCE_LEVEL,
                    scale: int | None = None, digits: int | None = None) -> DataFrame:
    """M6 + M7 per series: keys, selected (array<string>), p_values (array<double>)."""
    return sweep.select(gram_sums(df, keys, x, y, scale, digits), keys, x, y, alpha)


def feature_statistics(df: DataFrame, keys: list[str], x: list[str], y: str,
                       scale: int | None = None, digits: int | None = None) -> DataFrame:
    """M6: keys, feature, coefficient, t, p of the fit on all features."""
    return sweep.statistics(gram_sums(df, keys, x, y, scale, digits), keys, x, y)
