"""Deterministic views that let the driver's tables stand in for sensor data.

Each view exists twice: as a DataFrame builder (used by the queries) and as an SQL
text (used by the DuckDB oracle). Both must compute the same thing.

Mapping (fixed):
  * readings (long): ``events`` -> sensor_id = user_id, ts, pollutant from event_type,
    value.
  * hourly wide readings: per (sensor_id, hour) the mean of each pollutant; ``co`` is
    never measured, so it is an all-null column.
  * catalogue: ``region`` = country, ``nation`` = city, ``customer`` = sensor (its key
    is the events' user_id), ``supplier`` = query points. Coordinates derive from keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Event type -> pollutant column.
EVENT_POLLUTANT = {
    "click": "pm2_5",
    "error": "pm10",
    "purchase": "no2",
    "signup": "o3",
    "view": "so2",
}
MEASURED = ["pm2_5", "pm10", "no2", "o3", "so2"]
WIDE_POLLUTANTS = ["co", "no2", "o3", "pm2_5", "pm10", "so2"]
# Country codes given to the five regions (by r_regionkey).
REGION_CODES = ["MK", "RS", "BG", "GR", "DE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pollutant_col() -> F.Column:
    expr = None
    for etype, pol in EVENT_POLLUTANT.items():
        cond = F.col("event_type") == etype
        expr = F.when(cond, pol) if expr is None else expr.when(cond, pol)
    return expr


def readings_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per raw reading: sensor_id, ts, pollutant, value."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("user_id").alias("sensor_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        _pollutant_col().alias("pollutant"),
        F.col("value"),
    )


def hourly_mean_expr(etype: str) -> F.Column:
    """Hourly mean in micro-units: integer sum of 1e-4 units (exact, order-free),
    integer-divided by the count, returned as a double on the 1e-6 grid."""
    v = f"CASE WHEN event_type = '{etype}' THEN value END"
    n = f"count({v})"
    s4 = f"sum(CAST(round({v} * 10000) AS BIGINT))"
    return F.expr(f"CASE WHEN {n} > 0 THEN CAST(({s4} * 100) div {n} AS DOUBLE) / 1000000D END")


def events_between(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Raw events that can fall in hours within [since, until] (epoch seconds): literal
    bounds on the raw column, pushed to the scan; the hour is checked again later."""
    ev = table(spark, sf_dir, "events")
    kind = ev.schema["ts"].dataType
    if since is not None:
        ev = ev.filter(F.col("ts") >= F.timestamp_seconds(F.lit(since)).cast(kind))
    if until is not None:
        ev = ev.filter(F.col("ts") < F.timestamp_seconds(F.lit(until + 3600)).cast(kind))
    return ev


def hourly_wide(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None,
                sensors: DataFrame | None = None) -> DataFrame:
    """Hourly wide readings: sensor_id, ts (hour), co, no2, o3, pm2_5, pm10, so2; of the
    hours that ``since`` and ``until`` bound and the ``sensors`` (sensor_id) asked for.

    One aggregation with conditional aggregates: a single shuffle on (sensor, hour),
    partial aggregation map-side, all inside whole-stage codegen.
    """
    ev = events_between(spark, sf_dir, since, until).select("user_id", "ts", "event_type", "value")
    if sensors is not None:
        ev = ev.join(sensors.select(F.col("sensor_id").alias("user_id")).distinct(), "user_id", "left_semi")
    aggs = [
        hourly_mean_expr(etype).alias(pol)
        for etype, pol in EVENT_POLLUTANT.items()
    ]
    wide = (ev.groupBy(F.col("user_id").alias("sensor_id"),
                       F.date_trunc("hour", F.col("ts")).alias("ts"))
              .agg(*aggs))
    return wide.select("sensor_id", "ts", F.lit(None).cast("double").alias("co"),
                       "no2", "o3", "pm2_5", "pm10", "so2")


def coord(key: F.Column, mod: int, base: int) -> F.Column:
    """Derived coordinate: base + (key % mod) * 0.01, exact decimal then double."""
    return (F.lit(base) + (key % mod) * F.lit(0.01).cast("decimal(3,2)")).cast("double")


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City catalogue from ``nation``: city_key, city, country_code, lat, lon."""
    n = table(spark, sf_dir, "nation")
    code = F.element_at(F.array(*[F.lit(c) for c in REGION_CODES]), F.col("n_regionkey") + 1)
    return n.select(
        F.col("n_nationkey").alias("city_key"),
        F.col("n_name").alias("city"),
        code.alias("country_code"),
        coord(F.col("n_nationkey"), 97, 41).alias("lat"),
        coord(F.col("n_nationkey"), 89, 20).alias("lon"),
    )


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor catalogue from ``customer`` (c_custkey = events.user_id = sensor_id):
    sensor_id, city_key, status (INACTIVE for a negative balance), lat, lon."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("sensor_id"),
        F.col("c_nationkey").alias("city_key"),
        F.when(F.col("c_acctbal") < 0, "INACTIVE").otherwise("ACTIVE").alias("status"),
        coord(F.col("c_custkey"), 97, 41).alias("lat"),
        coord(F.col("c_custkey"), 89, 20).alias("lon"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query coordinates from ``supplier``: point_id, lat, lon (offset half a grid step)."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("point_id"),
        coord(F.col("s_suppkey") * 3, 97, 41).alias("lat"),
        coord(F.col("s_suppkey") * 7, 89, 20).alias("lon"),
    )


# ----------------------------------------------------------------------------- SQL
def _case_pollutant() -> str:
    whens = " ".join(f"WHEN event_type = '{e}' THEN '{p}'" for e, p in EVENT_POLLUTANT.items())
    return f"CASE {whens} END"


SQL_READINGS_LONG = f"""
SELECT user_id AS sensor_id, CAST(ts AS TIMESTAMP) AS ts, {_case_pollutant()} AS pollutant, value
FROM events
"""


def _sql_hourly_mean(etype: str) -> str:
    n = f"count(CASE WHEN event_type = '{etype}' THEN value END)"
    s4 = f"sum(CAST(round(CASE WHEN event_type = '{etype}' THEN value END * 10000) AS BIGINT))"
    return f"CASE WHEN {n} > 0 THEN CAST(({s4} * 100) // {n} AS DOUBLE) / CAST(1000000 AS DOUBLE) END"


SQL_HOURLY_WIDE = (
    "SELECT sensor_id, ts, CAST(NULL AS DOUBLE) AS co, no2, o3, pm2_5, pm10, so2 FROM ("
    "SELECT user_id AS sensor_id, date_trunc('hour', ts) AS ts, "
    + ", ".join(f"{_sql_hourly_mean(e)} AS {p}" for e, p in EVENT_POLLUTANT.items())
    + " FROM events GROUP BY user_id, date_trunc('hour', ts)) hw"
)


def _sql_coord(key: str, mod: int, base: int) -> str:
    return f"CAST({base} + ({key} % {mod}) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE)"


SQL_CITIES = (
    "SELECT n_nationkey AS city_key, n_name AS city, "
    "CASE n_regionkey " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(REGION_CODES))
    + " END AS country_code, "
    f"{_sql_coord('n_nationkey', 97, 41)} AS lat, {_sql_coord('n_nationkey', 89, 20)} AS lon FROM nation"
)

SQL_SENSORS = (
    "SELECT c_custkey AS sensor_id, c_nationkey AS city_key, "
    "CASE WHEN c_acctbal < 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS status, "
    f"{_sql_coord('c_custkey', 97, 41)} AS lat, {_sql_coord('c_custkey', 89, 20)} AS lon FROM customer"
)

SQL_POINTS = (
    "SELECT s_suppkey AS point_id, "
    f"{_sql_coord('(s_suppkey * 3)', 97, 41)} AS lat, {_sql_coord('(s_suppkey * 7)', 89, 20)} AS lon FROM supplier"
)


# ----------------------------------------------------------------------------- series
def _micro_mean(value: str = "value") -> F.Column:
    n = f"count({value})"
    s4 = f"sum(CAST(round({value} * 10000) AS BIGINT))"
    return F.expr(f"CASE WHEN {n} > 0 THEN CAST(({s4} * 100) div {n} AS DOUBLE) / 1000000D END")


def _sql_micro_mean(value: str = "value") -> str:
    n = f"count({value})"
    s4 = f"sum(CAST(round({value} * 10000) AS BIGINT))"
    return f"CASE WHEN {n} > 0 THEN CAST(({s4} * 100) // {n} AS DOUBLE) / CAST(1000000 AS DOUBLE) END"


def series_long(spark: SparkSession, sf_dir: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """Hourly series per (sensor_id, pollutant): ts (hour), value (micro-grid mean)."""
    ev = events_between(spark, sf_dir, since, until).select("user_id", "ts", "event_type", "value")
    return (ev.groupBy(F.col("user_id").alias("sensor_id"), _pollutant_col().alias("pollutant"),
                       F.date_trunc("hour", "ts").alias("ts"))
              .agg(_micro_mean().alias("value")))


SQL_SERIES_LONG = (
    f"SELECT user_id AS sensor_id, {_case_pollutant()} AS pollutant, date_trunc('hour', ts) AS ts, "
    f"{_sql_micro_mean()} AS value FROM events GROUP BY 1, 2, 3"
)


def network_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-network hourly series per pollutant: pollutant, ts, value."""
    ev = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    return (ev.groupBy(_pollutant_col().alias("pollutant"), F.date_trunc("hour", "ts").alias("ts"))
              .agg(_micro_mean().alias("value")))


SQL_NETWORK_SERIES = (
    f"SELECT {_case_pollutant()} AS pollutant, date_trunc('hour', ts) AS ts, "
    f"{_sql_micro_mean()} AS value FROM events GROUP BY 1, 2"
)
