"""Recursive forecast with weather and stored scaling.

Every series is one row: its last values, the weather rows of the horizon as one array, the stored scaler statistics
and its model. The steps are a fold over that row: a step builds the features (lags of the values so far, the weather of the
hour before, clock), scales them by the stored statistics, predicts, and appends the result. All series go through
one projection, whatever the model: coefficients are a dot product, trees are arrays that are walked in place.

A failed step (no prediction, NaN or negative) is null in the result. In the history it keeps the placeholder that the
step began with, as in the reference: the result of the step before (null if that failed too), at the first step 0.

Defined cases: a series shorter than the lags has null lags (a linear model that uses them fails, trees send them left); hours without
weather have null weather; a spread of 0 scales by 1; a series without statistics or model has null steps; weather rows
that repeat an hour count once (the smallest by their values).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import FORECAST_STEPS
from airlattice.functions import timefeat as T
from airlattice.operators import series as S
from airlattice.operators.forecast import exogenous, horizon
from airlattice.operators.frame import rescale
from airlattice.operators.joins import join_stats
from airlattice.operators.trees import BINS, predicted

CLOCK = ["hour_cos", "hour_sin", "dow_cos", "dow_sin"]


def names(lags: int, exo: list[str]) -> list[str]:
    """The features in the order in which models take them."""
    return [f"lag_{k}" for k in range(1, lags + 1)] + exo + CLOCK


def rows(history: DataFrame, weather: DataFrame, stats: DataFrame, keys: list[str], ts: str, value: str, lags: int,
         exo: list[str], weather_keys: list[str]) -> DataFrame:
    """The same features for every known hour, to train on: keys, ts, value and ``names``."""
    out = exogenous(S.lags(history.select(*keys, ts, value), keys, ts, value, lags), _hours(weather, weather_keys, ts, exo), weather_keys, ts, exo)
    out = rescale(out, stats, keys, value, [f"lag_{k}" for k in range(1, lags + 1)], exo)
    hc, hs = T.cyclic(F.hour(ts), 24)
    dc, ds = T.cyclic(F.weekday(ts), 7)
    return out.withColumns(dict(zip(CLOCK, (hc, hs, dc, ds)))).select(*keys, ts, value, *names(lags, exo))


def _hours(weather: DataFrame, weather_keys: list[str], ts: str, exo: list[str]) -> DataFrame:
    """One weather row per hour."""
    one = weather.groupBy(*weather_keys, ts).agg(F.min(F.struct(*exo)).alias("_w"))
    return one.select(*weather_keys, ts, *[F.col(f"_w.{c}").alias(c) for c in exo])


def state(history: DataFrame, weather: DataFrame, stats: DataFrame, keys: list[str], ts: str, value: str, lags: int,
          exo: list[str], weather_keys: list[str], as_of, steps: int = FORECAST_STEPS) -> DataFrame:
    """keys, _t0, _hist (``lags`` values, oldest first), _exo (per step the scaled weather), _a and _b (the value's scaling)."""
    known = S.cutoff(history, ts, as_of)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc()))
    last = known.withColumn("_n", back).where(F.col("_n") <= lags).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("t"), F.col(value).cast("double").alias("v")))), lambda e: e["v"]).alias("_hist"))
    last = last.withColumn("_hist", F.expr(f"concat(array_repeat(CAST(NULL AS DOUBLE), {lags} - size(_hist)), _hist)"))
    last = last.withColumn(ts, F.date_trunc("hour", F.lit(as_of).cast("timestamp")))
    # at most ``steps`` weather rows per series, as one array
    ahead = exogenous(horizon(last.select(*keys, ts), ts, steps), _hours(weather, weather_keys, ts, exo), weather_keys, ts, exo)
    ahead = rescale(ahead, stats, keys, value, [], exo)
    ahead = ahead.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", F.array(*[F.col(c).cast("double") for c in exo]).alias("x")))),
                                                 lambda e: e["x"]).alias("_exo"))
    scale = stats.select(*keys, F.col(f"_a_{value}").cast("double").alias("_a"),
                         F.when(F.col(f"_b_{value}") == 0, F.lit(1.0)).otherwise(F.col(f"_b_{value}").cast("double")).alias("_b"))
    return join_stats(join_stats(last.withColumnRenamed(ts, "_t0"), ahead, keys), scale, keys)


def _features(lags: int, hist: str, step: str) -> str:
    """SQL text: the scaled features of a step, in the order of ``names``."""
    t = f"(_t0 + make_interval(0, 0, 0, 0, {step}, 0, 0))"
    clock = [f"{g}((2.0D * pi() * CAST({part}({t}) AS DOUBLE)) / {m}D)" for part, m in (("hour", 24.0), ("weekday", 7.0)) for g in ("cos", "sin")]
    return (f"concat(transform(sequence(1, {lags}), k -> (element_at({hist}, -k) - _a) / _b), "
            f"coalesce(element_at(_exo, {step}), array()), array({', '.join(clock)}))")


def linear(weights: dict[str, float], intercept: float, lags: int, exo: list[str]) -> str:
    """SQL text of a linear model over the feature array ``x``; features without a weight are not used."""
    unknown = set(weights) - set(names(lags, exo))
    if unknown:
        raise ValueError(f"no such features: {sorted(unknown)}")
    # one sum from left to right, so that it is the same wherever it is worked out
    terms = [f"{float(weights[c])!r}D * x[{i}]" for i, c in enumerate(names(lags, exo)) if c in weights]
    return " + ".join([f"{float(intercept)!r}D", *terms])


def recursive(series: DataFrame, keys: list[str], ts: str, lags: int, model: str, models: DataFrame | None = None,
              steps: int = FORECAST_STEPS) -> DataFrame:
    """keys, step, ts, value of the ``state`` rows; ``model`` is SQL text over ``x`` and the columns of ``models`` (a row per series).

    The first step is left out, as in the reference.
    """
    if models is not None:
        series = join_stats(series, models, keys)
    step = (f"transform(array({_features(lags, 'acc.hist', 's')}), x -> {model})[0]")
    # named once: a one-element array carries the prediction into what follows
    fold = (f"aggregate(sequence(1, {steps}), named_struct('hist', _hist, 'preds', CAST(array() AS array<double>)), (acc, s) -> "
            f"transform(transform(array({step}), p -> CASE WHEN p >= 0 AND NOT isnan(p) THEN p END), p -> named_struct("
            f"'hist', slice(concat(acc.hist, array(coalesce(p, CASE WHEN s = 1 THEN 0.0D ELSE element_at(acc.preds, -1) END))), 2, {lags}), "
            f"'preds', concat(acc.preds, array(p))))[0]).preds")
    out = series.select(*keys, "_t0", F.posexplode(F.expr(fold)).alias("_i", "value"))
    return out.where("_i > 0").select(*keys, (F.col("_i") + 1).alias("step"),
                                      (F.col("_t0") + F.make_interval(hours=F.col("_i") + 1)).alias(ts), "value")


def trees(bins: int = BINS) -> str:
    """SQL text of the models that ``trees.fit`` makes, over the feature array ``x``."""
    return f"CASE WHEN trees IS NOT NULL THEN {predicted('x', bins)} END"
