"""Read-side operators (P6-P10, J7, J9, J12): filters, lookups and views of stored data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlattice.constants import COUNTRIES, HISTORY_SPAN_SECONDS, POLLUTANTS


def active(df: DataFrame, status_col: str = "status") -> DataFrame:
    """ACTIVE sensors only."""
    return df.filter(F.col(status_col) == "ACTIVE")


def enabled_codes(setting: str | None) -> list[str]:
    """Parse a comma-separated list of country codes (trimmed, upper-cased,
    blanks ignored); unset or empty -> every supported country."""
    if setting:
        codes = sorted({c.strip().upper() for c in setting.split(",") if c.strip()})
        if codes:
            return codes
    return sorted(COUNTRIES)


def enabled(df: DataFrame, codes: list[str], code_col: str = "country_code") -> DataFrame:
    """Rows whose country is enabled."""
    return df.filter(F.col(code_col).isin(codes))


def refresh_catalogue(landed: DataFrame, stored: DataFrame | None, predicate=None) -> DataFrame:
    """S3: the freshly landed catalogue (filtered) if it has any row, else the last
    good stored copy. ``isEmpty`` reads at most one row."""
    fresh = landed.filter(predicate) if predicate is not None else landed
    if stored is not None and fresh.isEmpty():
        return stored
    return fresh


def lookup(df: DataFrame, order: list[str], **names) -> DataFrame:
    """Case-insensitive equality on every given column; first match in load order."""
    out = df
    for col, value in names.items():
        out = out.filter(F.lower(F.col(col).cast("string")) == str(value).lower())
    return out.orderBy(*order).limit(1)


def history(readings: DataFrame, start_epoch: int | None = None, end_epoch: int | None = None,
            as_of_epoch: int | None = None, ts_col: str = "ts") -> DataFrame:
    """Readings with ``start <= ts <= end`` (inclusive). Defaults: the week before
    ``as_of`` (hour-truncated). Rejects start > end and spans over one week."""
    if end_epoch is None:
        if as_of_epoch is None:
            raise ValueError("as_of_epoch is required when end is not given")
        end_epoch = as_of_epoch - as_of_epoch % 3600
    if start_epoch is None:
        start_epoch = end_epoch - HISTORY_SPAN_SECONDS
    if start_epoch > end_epoch:
        raise ValueError("start is after end")
    if end_epoch - start_epoch > HISTORY_SPAN_SECONDS:
        raise ValueError("range longer than one week")
    return between(readings, start_epoch, end_epoch, ts_col)


def between(df: DataFrame, start_epoch: int, end_epoch: int, ts_col: str = "ts") -> DataFrame:
    """Rows with ``start <= ts <= end``: the column itself against literals of its own
    type, so that the scan can skip by it."""
    kind = df.schema[ts_col].dataType
    lo, hi = (F.timestamp_seconds(F.lit(e)).cast(kind) for e in (start_epoch, end_epoch))
    return df.filter((F.col(ts_col) >= lo) & (F.col(ts_col) <= hi))


def city_view(cities: DataFrame, sensors: DataFrame, forecast: DataFrame) -> DataFrame:
    """City -> its sensors -> their forecast (pollutant, ts, value in that order), nested;
    a sensor without a forecast has an empty list. A list holds one sensor's horizon, and
    a city's list its sensors: what the view serves."""
    rows = forecast.groupBy("sensor_id").agg(F.array_sort(F.collect_list(F.struct("pollutant", "ts", "value"))).alias("forecast"))
    empty = F.array().cast(rows.schema["forecast"].dataType)
    with_rows = sensors.select("sensor_id", "city_key").join(rows, "sensor_id", "left")
    per_city = with_rows.groupBy("city_key").agg(F.array_sort(F.collect_list(
        F.struct("sensor_id", F.coalesce("forecast", empty).alias("forecast")))).alias("sensors"))
    return cities.join(per_city, "city_key").select(*cities.columns, "sensors")


def available_pollutants(long: DataFrame, keys: list[str], spark) -> DataFrame:
    """P10: (display name, column) of each pollutant a series has any value for."""
    names = spark.createDataFrame(list(POLLUTANTS.items()), "pollutant string, name string")
    present = (long.groupBy(*keys, "pollutant").agg(F.count("value").alias("_n"))
                   .filter("_n > 0").drop("_n"))
    return present.join(F.broadcast(names), on="pollutant", how="inner")


def fresh_or_stored(fresh: DataFrame, stored: DataFrame, keys: list[str], next_hour_epoch: int,
                    first_time_col: str = "first_time", data_col: str = "data") -> DataFrame:
    """Per key, the fresh forecast if its first point is the next hour, else the
    stored one, else an empty list."""
    f, s = fresh.alias("f"), stored.alias("s")
    j = f.join(s, on=keys, how="full_outer")
    use_fresh = F.col(f"f.{first_time_col}") == F.lit(next_hour_epoch)
    empty = F.array().cast(fresh.schema[data_col].dataType)
    return j.select(*keys, F.when(use_fresh, F.col(f"f.{data_col}"))
                    .otherwise(F.coalesce(F.col(f"s.{data_col}"), empty)).alias(data_col),
                    F.when(use_fresh, F.lit("fresh"))
                    .when(F.col(f"s.{data_col}").isNotNull(), F.lit("stored"))
                    .otherwise(F.lit("empty")).alias("source"))
