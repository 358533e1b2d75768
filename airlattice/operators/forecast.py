"""Forecast operators.

Model-driven forecasting (M13, M14) lives in ``operators.model``; this module holds
the relational parts: horizon generation, exogenous lookup, guards and assembly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import FORECAST_STEPS
from airlattice.session import cut_lineage


def non_negative(c) -> Column:
    """P17 + P20: negative or NaN predictions become null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col) & (col >= 0), col)


def horizon(last: DataFrame, ts: str = "ts", steps: int = FORECAST_STEPS) -> DataFrame:
    """Future rows step 1..steps, one hour apart, after each series' last ``ts``."""
    return (last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
                .withColumn(ts, F.col(ts) + F.make_interval(hours=F.col("step"))))


def last_rows(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """The last row of each series (by time)."""
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def exogenous(steps: DataFrame, weather: DataFrame, keys: list[str], ts: str = "ts",
              cols: list[str] | None = None) -> DataFrame:
    """For each step at time t the weather row of the same series at t - 1 h
    (left equi-join on the shifted time; no row -> nulls)."""
    cols = cols or [c for c in weather.columns if c not in keys + [ts]]
    w = weather.select(*keys, (F.col(ts) + F.expr("INTERVAL 1 HOUR")).alias("_wts"), *cols)
    j = steps.join(w, on=[*[steps[k] == w[k] for k in keys], steps[ts] == w["_wts"]], how="left")
    return j.select(*[steps[c] for c in steps.columns], *[w[c] for c in cols])


def assemble(long: DataFrame, keys: list[str], pollutants: list[str], ts: str = "ts",
             pollutant: str = "pollutant", value: str = "value", drop_first: bool = True) -> DataFrame:
    """Per-pollutant forecast rows -> one wide row per (series, ts);
    the first horizon step is dropped and invalid values become null."""
    src = long.filter(F.col("step") > 1) if drop_first else long
    wide = src.groupBy(*keys, ts).pivot(pollutant, pollutants).agg(F.first(value))
    return wide.withColumns({p: non_negative(p) for p in pollutants})


def direct_labels(df: DataFrame, keys: list[str], ts: str, value: str, steps: int = 24) -> DataFrame:
    """Labels for direct multi-horizon models: label_h = value h rows ahead."""
    w = Window.partitionBy(*keys).orderBy(ts)
    return df.withColumns({f"label_{h}": F.lead(value, h).over(w) for h in range(1, steps + 1)})


def publish(spark, forecasts: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None,
            order=None) -> DataFrame:
    """Upsert the newest forecast per key into the predictions store (replace
    semantics) and return the store. Published after computing (the reference publishes
    the previous run's file first).

    With ``partition_by`` (part of the key) only the partitions the forecasts touch are
    read and rewritten; the others stay as they are, also if the run is cut off."""
    from airlattice.sources import store

    stored = store.read_store(spark, path)
    if stored is not None:
        near = store.same_partitions(stored, forecasts, partition_by) if partition_by else stored
        forecasts = cut_lineage(store.upsert(near, forecasts, keys, "replace", order))  # read before it is overwritten
    else:
        forecasts = store.newest(forecasts, keys, order)
    store.overwrite(forecasts, path, partition_by)
    return spark.read.parquet(path)
