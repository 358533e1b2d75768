"""Forecast-assembly and serving queries.

Forecast view (fixed): from each (sensor, pollutant) hourly series' last reading, 25
hourly steps with value = last value - 2 * step (so late steps go negative).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.constants import COUNTRY_ZONES, FORECAST_STEPS, POLLUTANTS
from airlattice.functions.aqi import aqi, sub_index_sql
from airlattice.operators import forecast as FC
from airlattice.operators import serve
from airlattice.operators.joins import broadcast_constant
from airlattice.plans import views as V
from airlattice.plans.registry import query

K = ["sensor_id", "pollutant"]
MEASURED = V.MEASURED


def forecast_long(spark, sf_dir):
    last = FC.last_rows(V.series_long(spark, sf_dir), K)
    steps = FC.horizon(last)
    return steps.select(*K, "step", "ts", (F.col("value") - F.lit(2.0) * F.col("step")).alias("value"))


SQL_FORECAST_LONG = f"""
SELECT sensor_id, pollutant, CAST(step AS INTEGER) AS step, ts + step * INTERVAL 1 HOUR AS ts, value - 2.0 * step AS value
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC) AS rn
                     FROM ({V.SQL_SERIES_LONG}) s) t WHERE rn = 1) l, range(1, 26) r(step)
"""


@query("non_negative", f"""
SELECT sensor_id, pollutant, step, ts, CASE WHEN value >= 0 AND NOT isnan(value) THEN value END AS value
FROM ({SQL_FORECAST_LONG}) f
""")
def non_negative(spark, sf_dir):
    f = forecast_long(spark, sf_dir)
    return f.withColumn("value", FC.non_negative("value"))


_WEATHER_SQL = """
SELECT user_id AS sensor_id, date_trunc('hour', ts) AS ts,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) / count(*) AS temp
FROM events GROUP BY 1, 2
"""


def weather(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (ev.groupBy(F.col("user_id").alias("sensor_id"), F.date_trunc("hour", "ts").alias("ts"))
              .agg((F.sum(k).cast("double") / F.count(F.lit(1))).alias("temp")))


@query("exogenous_lookup", f"""
WITH f AS ({SQL_FORECAST_LONG}), w AS ({_WEATHER_SQL}),
hist AS (SELECT sensor_id, pollutant, 0 AS step, ts, value FROM ({V.SQL_SERIES_LONG}) s),
steps AS (SELECT * FROM hist UNION ALL SELECT * FROM f)
SELECT steps.sensor_id, steps.pollutant, CAST(steps.step AS INTEGER) AS step, steps.ts, steps.value, w.temp
FROM steps LEFT JOIN w ON steps.sensor_id = w.sensor_id AND steps.ts = w.ts + INTERVAL 1 HOUR
""")
def exogenous_lookup(spark, sf_dir):
    hist = V.series_long(spark, sf_dir).select(*K, F.lit(0).alias("step"), "ts", "value")
    steps = hist.unionByName(forecast_long(spark, sf_dir))
    return FC.exogenous(steps, weather(spark, sf_dir), ["sensor_id"])


_ZONES = V.REGION_CODES


_ZONES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{z}')" for c, z in COUNTRY_ZONES.items()) + \
    ") z(country_code, zone)"


@query("forecast_pivot", f"""
WITH f AS ({SQL_FORECAST_LONG}),
w AS (PIVOT (SELECT sensor_id, ts, pollutant, value FROM f WHERE step > 1) ON pollutant IN ({", ".join(f"'{p}'" for p in MEASURED)}) USING first(value)),
s AS ({V.SQL_SENSORS}), c AS ({V.SQL_CITIES}), z AS ({_ZONES_SQL})
SELECT w.sensor_id, w.ts, timezone(z.zone, w.ts AT TIME ZONE 'UTC') AS local_ts,
  {", ".join(f"CASE WHEN {p} >= 0 AND NOT isnan({p}) THEN {p} END AS {p}" for p in MEASURED)}
FROM w JOIN s ON w.sensor_id = s.sensor_id JOIN c ON s.city_key = c.city_key JOIN z ON z.country_code = c.country_code
""")
def forecast_pivot(spark, sf_dir):
    wide = FC.assemble(forecast_long(spark, sf_dir), ["sensor_id"], MEASURED)
    s = V.sensors(spark, sf_dir).select("sensor_id", "city_key")
    c = V.cities(spark, sf_dir).select("city_key", "country_code")
    zones = spark.createDataFrame(list(COUNTRY_ZONES.items()), "country_code string, zone string")
    # the zones are a fixed table; cities grow with the catalogue and are left to AQE
    geo = s.join(c, "city_key").join(broadcast_constant(zones), "country_code")
    j = wide.join(geo, "sensor_id")
    return j.select("sensor_id", "ts", F.from_utc_timestamp("ts", F.col("zone")).alias("local_ts"), *MEASURED)


NEXT_HOUR = "2024-01-31 01:00:00"
STORED_CUT = "2024-01-29 00:00:00"


def _packed(long):
    return (long.filter(F.col("step") > 1)
                .groupBy(*K).agg(F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("data"))
                .withColumn("first_time", F.unix_seconds(F.col("data")[0]["ts"])))


@query("fresh_or_stored", f"""
WITH f AS (SELECT * FROM ({SQL_FORECAST_LONG}) x WHERE step > 1),
fa AS (SELECT sensor_id, pollutant, count(*) AS n, min(ts) AS first_ts, arg_min(value, ts) AS first_value FROM f GROUP BY 1, 2),
sl AS (SELECT * FROM ({V.SQL_SERIES_LONG}) s WHERE ts < TIMESTAMP '{STORED_CUT}'),
sf AS (SELECT sensor_id, pollutant, ts + step * INTERVAL 1 HOUR AS ts, value - 2.0 * step AS value, step
       FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC) AS rn FROM sl) t
             WHERE rn = 1) l, range(2, 26) r(step)),
sa AS (SELECT sensor_id, pollutant, count(*) AS n, min(ts) AS first_ts, arg_min(value, ts) AS first_value FROM sf GROUP BY 1, 2),
j AS (SELECT coalesce(fa.sensor_id, sa.sensor_id) AS sensor_id, coalesce(fa.pollutant, sa.pollutant) AS pollutant,
             fa.n AS fn, fa.first_ts AS ft, fa.first_value AS fv, sa.n AS sn, sa.first_ts AS st, sa.first_value AS sv
      FROM fa FULL OUTER JOIN sa ON fa.sensor_id = sa.sensor_id AND fa.pollutant = sa.pollutant)
SELECT sensor_id, pollutant,
  CASE WHEN ft = TIMESTAMP '{NEXT_HOUR}' THEN 'fresh' WHEN sn IS NOT NULL THEN 'stored' ELSE 'empty' END AS source,
  CAST(CASE WHEN ft = TIMESTAMP '{NEXT_HOUR}' THEN fn WHEN sn IS NOT NULL THEN sn ELSE 0 END AS INTEGER) AS n_points,
  CASE WHEN ft = TIMESTAMP '{NEXT_HOUR}' THEN ft ELSE st END AS first_ts,
  CASE WHEN ft = TIMESTAMP '{NEXT_HOUR}' THEN fv ELSE sv END AS first_value
FROM j
""")
def fresh_or_stored(spark, sf_dir):
    first = F.get("data", F.lit(0))     # null for an empty list
    return served(spark, sf_dir).select(
        *K, "source", F.size("data").cast("int").alias("n_points"), first["ts"].alias("first_ts"), first["value"].alias("first_value"))


def served(spark, sf_dir):
    """The list to serve per series and where it comes from."""
    fresh = _packed(forecast_long(spark, sf_dir))
    old = V.series_long(spark, sf_dir).filter(F.col("ts") < F.lit(STORED_CUT).cast("timestamp"))
    last = FC.last_rows(old, K)
    stored_long = FC.horizon(last).select(*K, "step", "ts", (F.col("value") - F.lit(2.0) * F.col("step")).alias("value"))
    stored = _packed(stored_long)
    next_epoch = 1706662800  # 2024-01-31 01:00:00 UTC
    return serve.fresh_or_stored(fresh, stored, K, next_epoch)


@query("city_forecast", f"""
WITH f AS (SELECT * FROM ({SQL_FORECAST_LONG}) x WHERE step > 1),
fs AS (SELECT sensor_id, count(*) AS n, count(CASE WHEN value >= 0 THEN 1 END) AS n_valid FROM f GROUP BY sensor_id),
s AS (SELECT * FROM ({V.SQL_SENSORS}) x WHERE status = 'ACTIVE'), c AS ({V.SQL_CITIES})
SELECT c.city_key, c.city, s.sensor_id, CAST(coalesce(fs.n, 0) AS INTEGER) AS n_points,
       CAST(coalesce(fs.n_valid, 0) AS INTEGER) AS n_valid
FROM c JOIN s ON c.city_key = s.city_key LEFT JOIN fs ON s.sensor_id = fs.sensor_id
""")
def city_forecast(spark, sf_dir):
    f = forecast_long(spark, sf_dir).filter("step > 1")
    per_sensor = f.groupBy("sensor_id").agg(
        F.collect_list(F.struct("pollutant", "ts", FC.non_negative("value").alias("value"))).alias("forecast"))
    sensors = serve.active(V.sensors(spark, sf_dir)).select("sensor_id", "city_key")
    cities = V.cities(spark, sf_dir).select("city_key", "city")
    j = sensors.join(per_sensor, "sensor_id", "left").join(cities, "city_key")
    empty = F.array().cast(per_sensor.schema["forecast"].dataType)
    j = j.withColumn("forecast", F.coalesce("forecast", empty))
    return j.select("city_key", "city", "sensor_id", F.size("forecast").cast("int").alias("n_points"),
                    F.size(F.filter("forecast", lambda x: x["value"].isNotNull())).cast("int").alias("n_valid"))


H_START, H_END = 1704844800, 1705449600  # 2024-01-10 00:00 .. 2024-01-17 00:00 UTC


@query("history_range", f"""
WITH hw AS ({V.SQL_HOURLY_WIDE})
SELECT *, greatest({", ".join(sub_index_sql(p, p) for p in V.WIDE_POLLUTANTS)}) AS aqi FROM hw
WHERE epoch(ts) BETWEEN {H_START} AND {H_END}
""")
def history_range(spark, sf_dir):
    h = serve.history(V.hourly_wide(spark, sf_dir, H_START, H_END), H_START, H_END)
    return h.withColumn("aqi", aqi())


@query("available_pollutants", f"""
WITH s AS ({V.SQL_SERIES_LONG}),
n AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in POLLUTANTS.items())}) t(pollutant, name))
SELECT s.sensor_id, s.pollutant, n.name FROM (SELECT sensor_id, pollutant FROM s GROUP BY 1, 2 HAVING count(value) > 0) s
JOIN n ON s.pollutant = n.pollutant
""")
def available_pollutants(spark, sf_dir):
    return serve.available_pollutants(V.series_long(spark, sf_dir), ["sensor_id"], spark)


@query("direct_horizon_labels", f"""
SELECT sensor_id, pollutant, ts, value, {", ".join(f"lead(value, {h}) OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) AS label_{h}" for h in range(1, 25))}
FROM ({V.SQL_SERIES_LONG}) n
""")
def direct_horizon_labels(spark, sf_dir):
    return FC.direct_labels(V.series_long(spark, sf_dir), K, "ts", "value", FORECAST_STEPS - 1)
