"""Direct forecast (M14): one linear model per horizon, all from one pass over the rows.

The cross-products of horizon h go over the rows that have a value h rows ahead: all complete rows but the last h of
each series. So the sums of all rows are formed once, with the products of features and all labels, and the
sums of the rows at each distance from the end; horizon h takes away those of distances 1 to h. No row
is repeated per horizon. Tasks form the matrices of their rows; a fixed number of entries is shuffled and summed.

Defined cases: rows whose value is null or NaN are left out before positions are counted; a series no longer than
the lags has no features and no forecast; a horizon without rows predicts 0 coefficients (value 0); a table
without complete rows gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.functions import timefeat as T
from airlattice.operators.forecast import non_negative
from airlattice.operators.series import lags as lagged
from airlattice.session import ship_package

CLOCK = ["hour_cos", "hour_sin", "dow_cos", "dow_sin"]


def features(lags: int) -> list[str]:
    return [f"lag_{k}" for k in range(1, lags + 1)] + CLOCK


def frame(series: DataFrame, keys: list[str], ts: str, value: str, lags: int, steps: int) -> DataFrame:
    """keys, ts, the features, ``_ahead`` (the next values, at most ``steps``) and ``_back`` (1 for a series' last row);
    complete rows only."""
    known = series.select(*keys, ts, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull() & ~F.isnan(value))
    w = Window.partitionBy(*keys).orderBy(ts)
    rows = lagged(known, keys, ts, value, lags).withColumns({
        "_ahead": F.collect_list(value).over(w.rowsBetween(1, steps)),
        "_back": F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(ts).desc()))})
    hc, hs = T.cyclic(F.hour(ts), 24)
    dc, ds = T.cyclic(F.weekday(ts), 7)
    return rows.withColumns(dict(zip(CLOCK, (hc, hs, dc, ds)))).where(F.col(f"lag_{lags}").isNotNull()).select(
        *keys, ts, *features(lags), "_ahead", "_back")


def sums(rows: DataFrame, lags: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y of every horizon, each with a leading constant feature."""
    ship_package(rows.sparkSession)
    p = len(features(lags)) + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, cross = np.zeros((steps + 1, p, p)), np.zeros((p, steps))
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.column_stack([np.ones(n)] + [batch.column(c).to_numpy(zero_copy_only=False) for c in features(lags)])
            ahead, back = batch.column("_ahead"), batch.column("_back").to_numpy()
            size = np.diff(ahead.offsets.to_numpy())
            y = np.zeros((n, steps))            # a value that is not there adds nothing
            at = np.repeat(np.arange(n), size)
            y[at, np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)] = ahead.flatten().to_numpy(zero_copy_only=False)
            gram[0] += x.T @ x
            cross += x.T @ y
            for r in range(1, steps + 1):
                edge = x[back == r]
                gram[r] += edge.T @ edge
        every = np.concatenate([gram.ravel(), cross.ravel()])
        used = np.flatnonzero(every)
        yield pa.record_batch([pa.array(used), pa.array(every[used])], names=["entry", "v"])
    columns = rows.select(*features(lags), "_ahead", "_back")
    every = np.zeros((steps + 1) * p * p + p * steps)
    for r in columns.mapInArrow(work, "entry long, v double").groupBy("entry").agg(F.sum("v").alias("v")).collect():
        every[r["entry"]] = r["v"]
    gram = every[:(steps + 1) * p * p].reshape(steps + 1, p, p)
    return gram[0] - np.cumsum(gram[1:], 0), every[(steps + 1) * p * p:].reshape(p, steps).T


def fit(rows: DataFrame, lags: int, steps: int) -> np.ndarray:
    """Coefficients per horizon, the constant first."""
    gram, cross = sums(rows, lags, steps)
    return np.array([np.linalg.pinv(g) @ b for g, b in zip(gram, cross)])


def direct_forecast(series: DataFrame, keys: list[str], ts: str, value: str, lags: int, steps: int) -> DataFrame:
    """keys, step, ts, value: every series' last row under the model of every horizon."""
    rows = frame(series, keys, ts, value, lags, steps)
    beta = fit(rows, lags, steps)
    x = F.array(F.lit(1.0), *[F.col(c) for c in features(lags)])
    models = F.array(*[F.array(*[F.lit(float(v)) for v in b]) for b in beta])
    last = rows.where("_back = 1").select(*keys, ts, x.alias("_x"), models.alias("_m"))
    each = last.select(*keys, ts, F.posexplode(F.expr(
        "transform(_m, b -> aggregate(zip_with(b, _x, (u, v) -> u * v), 0.0D, (s, v) -> s + v))")).alias("_i", "_p"))
    return each.select(*keys, (F.col("_i") + 1).alias("step"), (F.col(ts) + F.make_interval(hours=F.col("_i") + 1)).alias(ts),
                       non_negative("_p").alias("value"))
