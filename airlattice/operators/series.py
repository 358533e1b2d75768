"""Per-series operators.

A series is identified by key columns; every window here is partitioned by those
keys and ordered by time. Rows per series are bounded by the number of hours, not by
how many raw readings a sensor sends, so no window partition grows with data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import LOOKBACK_WEEKS, TRAIN_FRACTION
from airlattice.functions.stats import exact_avg
from airlattice.operators.joins import join_stats


def _w(keys, order):
    order = [order] if isinstance(order, str) else list(order)
    return Window.partitionBy(*keys).orderBy(*order)


def summary(weather: DataFrame, pollution: DataFrame, keys: list[str]) -> DataFrame:
    """Weather and pollution rows of the same series and hour (inner join)."""
    return weather.join(pollution, on=keys, how="inner")


def cutoff(df: DataFrame, ts: str, as_of) -> DataFrame:
    """Rows at or before ``as_of``."""
    return df.filter(F.col(ts) <= F.lit(as_of).cast("timestamp"))


def lookback(df: DataFrame, ts: str, as_of, weeks: int = LOOKBACK_WEEKS) -> DataFrame:
    """Rows in [as_of - weeks, as_of]."""
    end = F.lit(as_of).cast("timestamp")
    return df.filter((F.col(ts) >= end - F.expr(f"INTERVAL {weeks * 7} DAYS")) & (F.col(ts) <= end))


def lags(df: DataFrame, keys: list[str], order: str, value: str, max_lag: int,
         prefix: str = "lag_") -> DataFrame:
    """Positional lags 1..max_lag (rows, not hours) of ``value`` per series."""
    w = _w(keys, order)
    return df.withColumns({f"{prefix}{k}": F.lag(value, k).over(w) for k in range(1, max_lag + 1)})


def lead_align(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Row t takes row t+1's features; the last row of each series is dropped."""
    w = _w(keys, order)
    out = df.withColumns({c: F.lead(c, 1).over(w) for c in cols})
    out = out.withColumn("_last", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc())))
    return out.filter("_last > 1").drop("_last")


def tail(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The last ``n`` rows of each series."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def chrono_split(df: DataFrame, keys: list[str], order: str, frac: float = TRAIN_FRACTION,
                 flag: str = "is_train") -> DataFrame:
    """The first floor(n * frac) rows of each series are training rows."""
    w = _w(keys, order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return (df.withColumn("_rn", F.row_number().over(w))
              .withColumn(flag, F.col("_rn") <= F.floor(n * F.lit(frac)))
              .drop("_rn"))


def autocov(df: DataFrame, keys: list[str], order: str, value: str, max_lag: int,
            scale: int | None = 6) -> DataFrame:
    """Adjusted autocovariances r_0..r_L per series, r_k = sum d_t d_{t-k} / (n - k)
    with d = x - mean; one window pass for the lags, one grouped aggregation.

    Returns one row per series with an array ``acov`` (index k) and ``n``.
    """
    whole = Window.partitionBy(*keys)
    d = df.withColumns({"_m": exact_avg(value, scale, over=whole), "_n": F.count(value).over(whole)}) \
          .withColumn("_d", F.col(value) - F.col("_m"))
    w = _w(keys, order)
    d = d.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, max_lag + 1)})
    sums = [F.sum(F.col("_d") * F.col("_d")).alias("_s0")] + \
           [F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, max_lag + 1)]
    agg = d.groupBy(*keys).agg(F.first("_n").alias("n"), *sums)
    acov = F.array(*[F.when(F.col("n") - k > 0, F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / (F.col("n") - k))
                     for k in range(0, max_lag + 1)])
    return agg.select(*keys, "n", acov.alias("acov"))


SCALERS = ("min_max", "standard", "robust")


def _scale_exprs(c: str, kind: str, scale: int | None, over=None) -> tuple[Column, Column]:
    """A4: (centre, spread) aggregates of a scaler; any unknown ``kind`` means robust.
    ``over`` turns them into window aggregates."""
    def w(agg: Column) -> Column:
        return agg.over(over) if over is not None else agg

    if kind == "min_max":
        return w(F.min(c)), w(F.max(c)) - w(F.min(c))
    if kind == "standard":
        return exact_avg(c, scale, over), w(F.stddev_pop(c))
    return w(F.percentile(c, 0.5)), w(F.percentile(c, 0.75)) - w(F.percentile(c, 0.25))


def scale_stats(df: DataFrame, keys: list[str], cols: list[str], kind: str = "robust",
                scale: int | None = None) -> DataFrame:
    """A4: per-series scaler statistics as a table (to store with a model)."""
    aggs = []
    for c in cols:
        a, b = _scale_exprs(c, kind, scale)
        aggs += [a.alias(f"_a_{c}"), b.alias(f"_b_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def apply_scale(df: DataFrame, stats: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """M4: (x - a) / b with stored statistics; b = 1 where the spread is 0."""
    j = join_stats(df, stats, keys)
    return j.withColumns({c: (F.col(c) - F.col(f"_a_{c}")) /
                          F.when(F.col(f"_b_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_b_{c}"))
                          for c in cols}).drop(*[f"_a_{c}" for c in cols], *[f"_b_{c}" for c in cols])


def scale(df: DataFrame, keys: list[str], cols: list[str], kind: str = "robust",
          scale_digits: int | None = None) -> DataFrame:
    """M4: fit per-series scaler statistics and apply them in one window pass."""
    w = Window.partitionBy(*keys)
    out = {}
    for c in cols:
        a, b = _scale_exprs(c, kind, scale_digits, w)
        out[c] = (F.col(c) - a) / F.when(b == 0, F.lit(1.0)).otherwise(b)
    return df.withColumns(out)


def gram_sums(df: DataFrame, keys: list[str], x: list[str], y: str, scale: int | None = None,
              digits: int | None = None) -> DataFrame:
    """M6: sufficient statistics of an OLS fit with constant, per series, in one pass:
    n, sum x_i, sum x_i x_j (i <= j), sum x_i y, sum y, sum y^2 over complete rows.

    With ``scale`` (values on a 10^-scale grid) every sum is exact in decimal, so the
    result does not depend on row order; ``digits`` rounds it before the cast to double.
    """
    complete = df.dropna(subset=x + [y])

    def col(c):
        return F.col(c).cast(f"decimal(18,{scale})") if scale is not None else F.col(c)

    def total(e):
        s = F.sum(e)
        if scale is not None and digits is not None:
            s = F.round(s, digits)
        return s.cast("double")

    aggs = [F.count(F.lit(1)).cast("double").alias("n"), total(col(y)).alias(f"s_{y}"),
            total(col(y) * col(y)).alias(f"s_{y}_{y}")]
    for i, a in enumerate(x):
        aggs.append(total(col(a)).alias(f"s_{a}"))
        aggs.append(total(col(a) * col(y)).alias(f"s_{a}_{y}"))
        for b in x[i:]:
            aggs.append(total(col(a) * col(b)).alias(f"s_{a}_{b}"))
    return complete.groupBy(*keys).agg(*aggs)


def pacf(acov: DataFrame, keys: list[str], max_lag: int) -> DataFrame:
    """Partial autocorrelations 0..L per series from ``autocov`` output, by the Durbin-Levinson recursion as array
    expressions: each step keeps the coefficients of the order before (``phi``).

    The lag count follows the reference: max_lag if max_lag < n // 2, else n // 2 - 1. A series without variance
    has NaN beyond lag 0, one too short for a lag has lag 0 only.
    """
    nan = "double('NaN')"
    lags_ = f"CAST(CASE WHEN {max_lag} < n div 2 THEN {max_lag} ELSE n div 2 - 1 END AS INT)"
    step = (f"transform(array(named_struct('num', r[k] - aggregate(transform(s.phi, (p, j) -> p * r[k - 1 - j]), 0D, (u, v) -> u + v), "
            "'den', r[0] - aggregate(transform(s.phi, (p, j) -> p * r[j + 1]), 0D, (u, v) -> u + v))), "
            f"q -> transform(array(CASE WHEN q.den = 0 THEN {nan} ELSE q.num / q.den END), "
            "c -> named_struct('phi', array_append(transform(s.phi, (p, j) -> p - c * s.phi[k - 2 - j]), c), 'out', array_append(s.out, c)))[0])[0]")
    start = "named_struct('phi', CAST(array() AS array<double>), 'out', array(1D))"
    whole = (f"CASE WHEN l < 1 THEN array(1D) WHEN r[0] = 0 THEN concat(array(1D), array_repeat({nan}, l)) "
             f"ELSE aggregate(sequence(1, l), {start}, (s, k) -> {step}, s -> s.out) END")
    known = acov.select(*keys, "n", F.expr(lags_).alias("l"), F.expr(f"transform(acov, v -> coalesce(v, {nan}))").alias("r"))
    return known.select(*keys, "n", F.expr(whole).alias("pacf"))


def selected_lags(pacf_df: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Lags k >= 1 whose |PACF(k)| >= threshold, per series (array column ``lags``)."""
    idx = F.filter(F.sequence(F.lit(1), F.greatest(F.size("pacf") - 1, F.lit(1))),
                   lambda k: (F.size("pacf") > k) & ~F.isnan(F.element_at("pacf", k + 1))
                   & (F.abs(F.element_at("pacf", k + 1)) >= threshold))
    return pacf_df.select(*keys, idx.alias("lags"))


def lag_features(df: DataFrame, keys: list[str], order: str, value: str, max_lag: int,
                 threshold: float, scale: int | None = 6) -> DataFrame:
    """All lags 1..L computed once, nulled where the series' PACF does not
    select that lag; rows keep a ``lags`` array naming the selected ones."""
    sel = selected_lags(pacf(autocov(df, keys, order, value, max_lag, scale), keys, max_lag), keys, threshold)
    out = lags(df, keys, order, value, max_lag).join(sel, on=keys, how="left")
    return out.withColumns({f"lag_{k}": F.when(F.array_contains("lags", k), F.col(f"lag_{k}"))
                            for k in range(1, max_lag + 1)})
