"""The training frame (M2, M3, M4, M8) and its stored statistics.

One row per (series, hour): the label, lags that the series' own PACF selects, all time
features, the weather of the hour before (J6), and the chronological split. Columns with a
unit are scaled per series by statistics of the training rows only; the statistics are a table
to store with the model, and the forecast applies them again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.functions import timefeat as T
from airlattice.operators import series as S
from airlattice.operators.forecast import exogenous
from airlattice.operators.quantiles import robust_stats
from airlattice.operators.select import select_features
from airlattice.session import cut_lineage


@dataclass
class Frame:
    rows: DataFrame
    stats: DataFrame
    features: list[str]


def training_frame(series: DataFrame, weather: DataFrame, keys: list[str], ts: str, value: str, lags: int,
                   threshold: float, scaler: str = "min_max", weather_keys: list[str] | None = None,
                   as_of=None) -> Frame:
    """Rows with ``label``, ``is_train`` and scaled ``features`` (lags not selected, and hours
    without weather, are null), the scaler statistics, and the feature list.

    ``as_of`` cuts the series off (P11): nothing later is learned from.
    """
    if as_of is not None:
        series = S.cutoff(series, ts, as_of)
    exo = [c for c in weather.columns if c not in (weather_keys or keys) + [ts]]
    rows = S.lag_features(series, keys, ts, value, lags, threshold)
    rows = exogenous(rows, weather, weather_keys or keys, ts, exo)
    rows = S.chrono_split(rows, keys, ts).withColumn("label", F.col(value))
    lag_cols = [f"lag_{k}" for k in range(1, lags + 1)]
    # lags carry the label's unit: one pair of statistics for the value scales them all
    stats = S.scale_stats(rows.filter("is_train"), keys, [value, *exo], scaler)
    rows = rescale(rows, stats, keys, value, lag_cols, exo)
    before = set(rows.columns)
    rows = T.time_features(rows, ts)
    times = [c for c in rows.columns if c not in before and (c.endswith("_cos") or c.endswith("_sin"))]
    features = lag_cols + exo + times
    return Frame(rows.select(*keys, ts, "label", "is_train", *features), stats, features)


def pooled_frame(rows: DataFrame, keys: list[str], ts: str, features: list[str], label: str = "label") -> Frame:
    """M8 of a model that all series share: the chronological split, the lags scaled by the label's median and quartiles (they carry its
    unit), and the features that backward elimination keeps. Both learn from the training rows only; where no feature
    is significant all stay."""
    rows = cut_lineage(S.chrono_split(rows, keys, ts))
    stats = robust_stats(rows.filter("is_train"), [], [label])
    found = stats.first()
    middle, spread = (found[f"_a_{label}"] or 0.0, found[f"_b_{label}"] or 1.0) if found else (0.0, 1.0)
    rows = rows.withColumns({c: (F.col(c) - F.lit(middle)) / F.lit(spread) for c in features if c.startswith("lag_")})
    picked = select_features(rows.filter("is_train"), [], features, label).first()
    kept = (picked and picked["selected"]) or features
    return Frame(rows.select(*keys, ts, label, "is_train", *kept), stats, kept)


def rescale(rows: DataFrame, stats: DataFrame, keys: list[str], value: str, lag_cols: list[str], exo: list[str]) -> DataFrame:
    """Apply stored statistics: lags by those of the value, each weather column by its own."""
    joined = S.join_stats(rows, stats, keys)

    def scaled(c: str, of: str):
        spread = F.when(F.col(f"_b_{of}") == 0, F.lit(1.0)).otherwise(F.col(f"_b_{of}"))
        return (F.col(c) - F.col(f"_a_{of}")) / spread
    out = joined.withColumns({**{c: scaled(c, value) for c in lag_cols}, **{c: scaled(c, c) for c in exo}})
    return out.drop(*[f"_{x}_{c}" for x in "ab" for c in [value, *exo]])
