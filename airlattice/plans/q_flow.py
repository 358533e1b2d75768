"""Round trips through files, stores and models (S1-S4, S7, S12, S15-S17, P19, P23, T2), and the
nested and by-coordinate views compared row by row (J7, J9, J12)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from airlattice.functions import geo
from airlattice.operators import clean, evaluate, serve
from airlattice.operators import forecast as FC
from airlattice.operators import model as M
from airlattice.operators.nearest import nearest
from airlattice.plans import q_evaluate as QE
from airlattice.plans import q_serve as QS
from airlattice.plans import views as V
from airlattice.plans.q_geo import _sql_nearest
from airlattice.plans.q_ingest import NEW_FROM, OLD_CUT
from airlattice.plans.q_rows import scratch
from airlattice.plans.registry import ORACLE, query
from airlattice.sources import catalogue, files, landing, records, store

POLS = V.WIDE_POLLUTANTS
K = ["sensor_id", "pollutant"]


@query("readings_scan", f"""
SELECT sensor_id, CAST(epoch(ts) AS BIGINT) AS time, ts, no2, o3, pm2_5, pm10, so2 FROM ({V.SQL_HOURLY_WIDE}) hw
""")
def readings_scan(spark, sf_dir):
    """Readings dropped twice as CSV files, first one unit off; the later drop counts."""
    root = scratch(spark, "readings")
    cols = [p for p in POLS if p != "co"]
    hw = V.hourly_wide(spark, sf_dir).select("sensor_id", F.unix_seconds("ts").alias("time"), *cols)
    for off in (1.0, 0.0):
        hw.withColumns({p: F.col(p) + off for p in cols}).write.mode("append").option("header", "true").csv(root)
    schema = "sensor_id long, time long, " + ", ".join(f"{p} double" for p in cols)
    return files.read_readings(spark, root, schema, keys=["sensor_id"]).select("sensor_id", "time", "ts", *cols)


@query("catalogue_scan", f"""
SELECT CAST(sensor_id AS VARCHAR) AS sensor_id, status, CASE WHEN sensor_id % 10 = 0 THEN 'elsewhere' ELSE c.city END AS city,
       round(s.lat, 6) AS lat, round(s.lon, 6) AS lon
FROM ({V.SQL_SENSORS}) s JOIN ({V.SQL_CITIES}) c ON s.city_key = c.city_key
""")
def catalogue_scan(spark, sf_dir):
    """S2 + P19: a JSON document of sensors per city, read with the fixed schema; sensors without a
    city get the tag; a folder that is not there is empty."""
    root = scratch(spark, "catalogue")
    s = V.sensors(spark, sf_dir).join(V.cities(spark, sf_dir).select("city_key", "city"), "city_key")
    item = F.struct(F.col("sensor_id").cast("string").alias("sensorId"), "status",
                    F.concat_ws(",", "lat", "lon").alias("position"),
                    F.when(F.col("sensor_id") % 10 != 0, F.col("city")).alias("cityName"))
    s.groupBy("city_key").agg(F.to_json(F.collect_list(item)).alias("value")).select("value") \
        .repartition(8).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(root)
    found = catalogue.read_catalogue(spark, root, "sensors").unionByName(
        catalogue.read_catalogue(spark, root + "-none", "sensors"))
    tagged = catalogue.sensors_with_city(found, "elsewhere")
    lat, lon = geo.position("position")
    return tagged.select(F.col("sensorId").alias("sensor_id"), "status", F.col("cityName").alias("city"),
                         F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query("catalogue_fallback", f"""
SELECT sensor_id, city_key, status, lat, lon, row_number() OVER (ORDER BY sensor_id) AS place FROM ({V.SQL_SENSORS}) s WHERE status = 'ACTIVE'
""")
def catalogue_fallback(spark, sf_dir):
    """S3: nothing landed (upstream was empty), so the last good copy stays; a landed copy counts."""
    landed = V.sensors(spark, sf_dir)
    good = serve.refresh_catalogue(landed, None, F.col("status") == "ACTIVE")
    kept = serve.refresh_catalogue(landed.filter("sensor_id IS NULL"), good, F.col("status") == "ACTIVE")
    first = kept.groupBy(F.floor(F.col("sensor_id") / 1000).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = first.withColumn("base", F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    place = F.row_number().over(Window.partitionBy("b").orderBy("sensor_id")) + F.coalesce("base", F.lit(0))
    return kept.withColumn("b", F.floor(F.col("sensor_id") / 1000)).join(before, "b") \
        .select("sensor_id", "city_key", "status", "lat", "lon", place.cast("long").alias("place"))


_TAG = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query("weather_landing", f"""
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(floor(epoch(ts)) AS BIGINT) AS time, value AS temp,
                  event_id, {_TAG} AS k, {_TAG} % 6 + 1 AS n FROM events)
SELECT user_id, day, time, temp, k AS wind_speed, CASE WHEN n = 1 THEN event_id END AS gusts,
       {", ".join(f"CASE WHEN n > 1 AND n > {i} THEN event_id + {i} END AS gusts_{i}" for i in range(6))}
FROM e
""")
def weather_landing(spark, sf_dir):
    """Payloads with an hourly list, nested values and lists of one to six items."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    hour = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"), F.col("value").alias("temperature"),
                    k.alias("windSpeed"), F.lit("clear").alias("weather_text"), F.lit(1).alias("ozone"),
                    F.transform(F.sequence(F.lit(0).cast("long"), k % 6), lambda i: F.col("event_id") + i).alias("gusts"))
    payload = V.table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.collect_list(hour).alias("hourly"))
    return landing.land_weather(payload, ["user_id", "day"])


@query("weather_records", ORACLE["weather_landing"])
def weather_records(spark, sf_dir):
    """S4 over JSON text whose records have different keys, in one scan: no schema, no sizing pass."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    hour = F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"), F.col("value").alias("temperature"),
                    k.alias("windSpeed"), F.lit("clear").alias("weather_text"), F.lit(1).alias("ozone"),
                    F.transform(F.sequence(F.lit(0).cast("long"), k % 6), lambda i: F.col("event_id") + i).alias("gusts"))
    landed = V.table(spark, sf_dir, "events").groupBy("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.to_json(F.struct(F.collect_list(hour).alias("hourly"))).alias("payload"))
    wanted = {"dt": "bigint", "temperature": "double", "windSpeed": "bigint", "weather_text": "string", "ozone": "bigint",
              "gusts": "bigint"} | {f"gusts_{i}": "bigint" for i in range(6)}
    return records.land_weather(landed, "payload", ["user_id", "day"], wanted)


_KEYED = "SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, value FROM events"


@query("reconcile_rows", f"""
WITH l AS ({_KEYED} WHERE ts < {OLD_CUT}), s AS ({_KEYED} WHERE ts >= {NEW_FROM})
SELECT s.* FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = s.user_id AND l.ts = s.ts)
""")
def reconcile_rows(spark, sf_dir):
    return _reconcile(spark, sf_dir)[0]


@query("reconcile_outcomes", f"""
WITH l AS ({_KEYED} WHERE ts < {OLD_CUT}), s AS ({_KEYED} WHERE ts >= {NEW_FROM} AND user_id % 5 <> 0),
m AS (SELECT DISTINCT user_id FROM s WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = s.user_id AND l.ts = s.ts))
SELECT 'fetch' AS job, u.user_id, CASE WHEN m.user_id IS NOT NULL THEN 'done' ELSE 'skipped' END AS outcome
FROM (SELECT user_id FROM l UNION SELECT user_id FROM s) u LEFT JOIN m ON m.user_id = u.user_id
""")
def reconcile_outcomes(spark, sf_dir):
    return _reconcile(spark, sf_dir, "user_id % 5 <> 0")[1]


def _reconcile(spark, sf_dir, stored_if: str = "true"):
    """A local copy and a stored one that overlap in time."""
    ev = V.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    return clean.reconcile(ev.filter(F.col("ts") < F.expr(OLD_CUT)),
                           ev.filter(F.col("ts") >= F.expr(NEW_FROM)).filter(stored_if), ["user_id", "ts"], ["user_id"])


@query("bulk_insert", f"""
SELECT sensor_id, city_key, status, lat, lon, 2 AS copies, 2 AS ids FROM ({V.SQL_SENSORS}) s
""")
def bulk_insert(spark, sf_dir):
    """The catalogue appended twice, each row with an id of its own."""
    path = scratch(spark, "insert")
    for _ in range(2):
        store.insert(V.sensors(spark, sf_dir), path, with_id="_id")
    back = spark.read.parquet(path)
    return back.groupBy("sensor_id", "city_key", "status", "lat", "lon").agg(
        F.count(F.lit(1)).cast("int").alias("copies"), F.count_distinct("_id").cast("int").alias("ids"))


@query("error_sink", f"WITH {QE.SQL_ERRORS} SELECT * FROM e")
def error_sink(spark, sf_dir):
    """The error table by model; a second run of one model replaces only its part."""
    path = scratch(spark, "errors")
    e = QE.rounded_errors(spark, sf_dir)
    evaluate.write_errors(e.withColumn("mae", F.when(F.col("model") == "A", -1.0).otherwise(F.col("mae"))), path, ["model"])
    evaluate.write_errors(e.filter("model = 'A'"), path, ["model"])
    return spark.read.parquet(path).select(*e.columns)


@query("holdout_sink", f"SELECT * FROM ({QE.SQL_HOLDOUT}) h")
def holdout_sink(spark, sf_dir):
    """Holdout predictions stored by model and read back."""
    path = scratch(spark, "holdout")
    h = QE.holdout(spark, sf_dir)
    evaluate.write_holdout(h, path, ["model"])
    return spark.read.parquet(path).select(*h.columns)


@query("forecast_publish", f"""
SELECT s.city_key, f.sensor_id, f.pollutant, f.step, f.ts,
       CASE WHEN s.city_key < 5 THEN f.value + 100.0 ELSE f.value END AS value
FROM ({QS.SQL_FORECAST_LONG}) f JOIN ({V.SQL_SENSORS}) s ON s.sensor_id = f.sensor_id
""")
def forecast_publish(spark, sf_dir):
    """Forecasts published by city; a later run for five cities rewrites only their part."""
    path = scratch(spark, "published")
    f = QS.forecast_long(spark, sf_dir).join(V.sensors(spark, sf_dir).select("sensor_id", "city_key"), "sensor_id")
    f = f.select("city_key", *K, "step", "ts", "value")
    keys = ["city_key", *K, "step"]
    FC.publish(spark, f, path, keys, ["city_key"])
    later = f.filter("city_key < 5").withColumn("value", F.col("value") + 100.0)
    return FC.publish(spark, later, path, keys, ["city_key"]).select(*f.columns)


@query("sorted_sink", f"""
SELECT sensor_id, pollutant, ts, value, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts) AS place FROM ({V.SQL_SERIES_LONG}) s
""")
def sorted_sink(spark, sf_dir):
    """Readings written by time within their series; the place is that in the file."""
    path = scratch(spark, "sorted")
    store.write_sorted(V.series_long(spark, sf_dir), path, K, "ts")
    back = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    place = F.row_number().over(Window.partitionBy(*K).orderBy("f", "i"))
    return back.select(*K, "ts", "value", place.cast("long").alias("place"))


_SQL_ROUND_TRIP = f"""
SELECT pollutant, ts, true AS same FROM (
  SELECT pollutant, ts, value, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM ({V.SQL_NETWORK_SERIES}) n
  WINDOW w AS (PARTITION BY pollutant ORDER BY ts)) t WHERE value IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL
"""


def _round_trip(spark, sf_dir, family):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    frame, cols = M.feature_frame(V.network_series(spark, sf_dir), ["pollutant"], "ts", "value", 2)
    asm = VectorAssembler(inputCols=cols, outputCol="features")
    fitted = PipelineModel(stages=[asm, M.make(family).fit(asm.transform(frame))])
    saved = M.register(spark, fitted, cols, scratch(spark, "model"), {"pollutant": "all", "model": family}).first()
    keep = ["pollutant", "ts"]
    again = M.load(saved["path"]).transform(M.project(frame, saved["features"], keep)).select(*keep, F.col("prediction").alias("again"))
    first = fitted.transform(frame).select(*keep, F.col("prediction").alias("first"))
    return first.join(again, keep).select(*keep, (F.col("first") == F.col("again")).alias("same"))


@query("model_round_trip", _SQL_ROUND_TRIP)
def model_round_trip(spark, sf_dir):
    """S17 + P23: a fitted model saved with its feature list, loaded, and applied to the projected frame."""
    return _round_trip(spark, sf_dir, "Linear")


@query("plugin_round_trip", _SQL_ROUND_TRIP)
def plugin_round_trip(spark, sf_dir):
    """F3 + S17: the same for a family that is not Spark ML's own (``linear.ElasticNet``)."""
    return _round_trip(spark, sf_dir, "ElasticNet")


@query("feature_projection", f"""
SELECT sensor_id, pollutant, ts, lag(value, 3) OVER w AS lag_3, lag(value, 1) OVER w AS lag_1
FROM ({V.SQL_SERIES_LONG}) s WINDOW w AS (PARTITION BY sensor_id, pollutant ORDER BY ts)
""")
def feature_projection(spark, sf_dir):
    """Only the saved features, in their order, whatever else the frame holds."""
    from airlattice.operators.series import lags
    frame = lags(V.series_long(spark, sf_dir), K, "ts", "value", 6)
    return M.project(frame, ["lag_3", "lag_1"], [*K, "ts"])


_NEAR = _sql_nearest(V.SQL_SENSORS, "sensor_id", "WHERE status = 'ACTIVE'")


def _near(spark, sf_dir):
    """Points with the coordinates asked for and their nearest active sensor."""
    p = V.points(spark, sf_dir)
    nn = nearest(p, serve.active(V.sensors(spark, sf_dir)), "point_id", "sensor_id").drop("dist_km")
    return p.select("point_id", F.col("lat").alias("asked_lat"), F.col("lon").alias("asked_lon")) \
        .join(nn.filter("sensor_id IS NOT NULL"), "point_id")


@query("coordinate_forecast", f"""
WITH nn AS ({_NEAR}), f AS ({QS.SQL_FORECAST_LONG})
SELECT nn.point_id, p.lat AS asked_lat, p.lon AS asked_lon, nn.sensor_id, f.pollutant, f.ts,
       CASE WHEN f.value >= 0 THEN f.value END AS value
FROM nn JOIN ({V.SQL_POINTS}) p ON p.point_id = nn.point_id JOIN f ON f.sensor_id = nn.sensor_id WHERE f.step > 1
""")
def coordinate_forecast(spark, sf_dir):
    """The nearest sensor's forecast, with the coordinates that were asked for."""
    f = QS.forecast_long(spark, sf_dir).filter("step > 1").select(*K, "ts", FC.non_negative("value").alias("value"))
    return _near(spark, sf_dir).join(f, "sensor_id").select("point_id", "asked_lat", "asked_lon", *K, "ts", "value")


@query("coordinate_pollutants", f"""
WITH nn AS ({_NEAR}),
s AS (SELECT sensor_id, pollutant FROM ({V.SQL_SERIES_LONG}) x GROUP BY 1, 2 HAVING count(value) > 0),
n AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in QS.POLLUTANTS.items())}) t(pollutant, name))
SELECT nn.point_id, p.lat AS asked_lat, p.lon AS asked_lon, nn.sensor_id, s.pollutant, n.name
FROM nn JOIN ({V.SQL_POINTS}) p ON p.point_id = nn.point_id JOIN s ON s.sensor_id = nn.sensor_id JOIN n ON n.pollutant = s.pollutant
""")
def coordinate_pollutants(spark, sf_dir):
    """The pollutants that the nearest sensor measures."""
    found = serve.available_pollutants(V.series_long(spark, sf_dir), ["sensor_id"], spark)
    return _near(spark, sf_dir).join(found, "sensor_id").select("point_id", "asked_lat", "asked_lon", *K, "name")


@query("city_forecast_nested", f"""
WITH f AS (SELECT * FROM ({QS.SQL_FORECAST_LONG}) x WHERE step > 1),
s AS (SELECT * FROM ({V.SQL_SENSORS}) x WHERE status = 'ACTIVE'), c AS ({V.SQL_CITIES})
SELECT c.city_key, c.city, s.sensor_id, f.pollutant, f.ts, CASE WHEN f.value >= 0 THEN f.value END AS value,
       row_number() OVER (PARTITION BY s.sensor_id ORDER BY f.pollutant, f.ts) AS place
FROM c JOIN s ON c.city_key = s.city_key LEFT JOIN f ON s.sensor_id = f.sensor_id
""")
def city_forecast_nested(spark, sf_dir):
    """City -> sensors -> forecast as one nested row per city, unnested again for comparison."""
    f = QS.forecast_long(spark, sf_dir).filter("step > 1").select(*K, "ts", FC.non_negative("value").alias("value"))
    nested = serve.city_view(V.cities(spark, sf_dir).select("city_key", "city"), serve.active(V.sensors(spark, sf_dir)), f)
    one = nested.select("city_key", "city", F.explode("sensors").alias("s"))
    return one.select("city_key", "city", "s.sensor_id", F.posexplode_outer("s.forecast").alias("i", "x")).select(
        "city_key", "city", "sensor_id", "x.pollutant", "x.ts", "x.value",
        F.coalesce(F.col("i") + 1, F.lit(1)).cast("long").alias("place"))


@query("fresh_or_stored_rows", f"""
WITH f AS (SELECT * FROM ({QS.SQL_FORECAST_LONG}) x WHERE step > 1),
fa AS (SELECT sensor_id, pollutant, min(ts) AS first_ts FROM f GROUP BY 1, 2),
sl AS (SELECT * FROM ({V.SQL_SERIES_LONG}) s WHERE ts < TIMESTAMP '{QS.STORED_CUT}'),
sf AS (SELECT sensor_id, pollutant, ts + step * INTERVAL 1 HOUR AS ts, value - 2.0 * step AS value
       FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC) AS rn FROM sl) t
             WHERE rn = 1) l, range(2, 26) r(step)),
fresh AS (SELECT * FROM fa WHERE first_ts = TIMESTAMP '{QS.NEXT_HOUR}')
SELECT f.sensor_id, f.pollutant, 'fresh' AS source, f.ts, f.value FROM f JOIN fresh ON fresh.sensor_id = f.sensor_id AND fresh.pollutant = f.pollutant
UNION ALL
SELECT sf.sensor_id, sf.pollutant, 'stored', sf.ts, sf.value FROM sf
WHERE NOT EXISTS (SELECT 1 FROM fresh WHERE fresh.sensor_id = sf.sensor_id AND fresh.pollutant = sf.pollutant)
""")
def fresh_or_stored_rows(spark, sf_dir):
    """The whole lists that are served, row by row."""
    return QS.served(spark, sf_dir).select(*K, "source", F.explode("data").alias("x")).select(*K, "source", "x.ts", "x.value")
