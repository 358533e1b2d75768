"""Pair distances as column expressions over a pair row (left ``a_*``, right ``b_*``).

H12 numeric (Euclidean, city-block), H13 binary over one-hot / coded categories
(Jaccard, Hamming, Euclidean), H14 weighted Hamming, H15 Gower-like mix. These are
applied to pair rows produced by an equi-join or a window, never to a full product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("euclidean", "cityblock")
CATEGORICAL = ("euclidean", "jaccard", "hamming", "weighted-hamming")


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, cols)


def numeric(a: list[str], b: list[str], metric: str = "euclidean") -> Column:
    """H12 over paired numeric columns."""
    if metric == "euclidean":
        return F.sqrt(_sum([(F.col(x) - F.col(y)) * (F.col(x) - F.col(y)) for x, y in zip(a, b)]))
    if metric == "cityblock":
        return _sum([F.abs(F.col(x) - F.col(y)) for x, y in zip(a, b)])
    raise ValueError(f"unknown numeric distance {metric!r}; one of {', '.join(NUMERIC)}")


def differing(a: list[str], b: list[str]) -> Column:
    """Number of categorical attributes whose values differ (null-safe)."""
    return _sum([F.when(F.col(x).eqNullSafe(F.col(y)), 0).otherwise(1) for x, y in zip(a, b)])


def categorical(a: list[str], b: list[str], metric: str = "jaccard") -> Column:
    """H13 on one-hot encoded categories, from the count d of differing attributes
    among m: Hamming on codes d/m, Jaccard on dummies 2d/(m+d), Euclid sqrt(2d)."""
    m = float(len(a))
    d = differing(a, b).cast("double")
    if metric == "hamming":
        return d / F.lit(m)
    if metric == "jaccard":
        return (F.lit(2.0) * d) / (F.lit(m) + d)
    if metric == "euclidean":
        return F.sqrt(F.lit(2.0) * d)
    raise ValueError(f"unknown categorical distance {metric!r}")


def weighted_hamming(a: list[str], b: list[str], freq_a: list[str]) -> Column:
    """Per attribute 1 if different else the shared value's relative frequency;
    harmonic mean over attributes."""
    parts = [F.when(F.col(x).eqNullSafe(F.col(y)), F.col(f)).otherwise(F.lit(1.0))
             for x, y, f in zip(a, b, freq_a)]
    return F.lit(float(len(parts))) / _sum([F.lit(1.0) / p for p in parts])


def gower(num: Column, cat: Column, n_num: int, n_cat: int) -> Column:
    """(D_num * n_num + D_cat * n_cat) / n over pre-scaled numeric columns."""
    return (F.lit(1.0) * (num * F.lit(float(n_num)) + cat * F.lit(float(n_cat)))) / F.lit(float(n_num + n_cat))
