"""Catalogue and geographic queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.functions import geo
from airlattice.functions.aqi import aqi, sub_index_sql
from airlattice.functions.stats import exact_avg, sql_exact_avg
from airlattice.operators import serve
from airlattice.operators.nearest import nearest
from airlattice.plans import views as V
from airlattice.plans.registry import query


def sql_hav(a_lat, a_lon, b_lat, b_lon) -> str:
    return (f"(CAST(12742.0176 AS DOUBLE) * asin(sqrt(pow(sin((radians({b_lat}) - radians({a_lat})) * 0.5), 2)"
            f" + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin((radians({b_lon}) - radians({a_lon})) * 0.5), 2))))")


@query("active_filter", f"SELECT * FROM ({V.SQL_SENSORS}) s WHERE status = 'ACTIVE'")
def active_filter(spark, sf_dir):
    return serve.active(V.sensors(spark, sf_dir))


ENABLED_SETTING = " mk, rs ,bg,, "


@query("country_filter", f"SELECT * FROM ({V.SQL_CITIES}) c WHERE country_code IN ('BG', 'MK', 'RS')")
def country_filter(spark, sf_dir):
    codes = serve.enabled_codes(ENABLED_SETTING)
    landed = V.cities(spark, sf_dir)
    return serve.refresh_catalogue(landed, None, F.col("country_code").isin(codes)).orderBy("city")


@query("ci_lookup", f"""
SELECT * FROM ({V.SQL_CITIES}) c WHERE lower(city) = lower('nAtIoN_7') ORDER BY city_key LIMIT 1
""")
def ci_lookup(spark, sf_dir):
    return serve.lookup(V.cities(spark, sf_dir), ["city_key"], city="nAtIoN_7")


@query("catalogue_sort", f"SELECT * FROM ({V.SQL_SENSORS}) s ORDER BY city_key, sensor_id")
def catalogue_sort(spark, sf_dir):
    return V.sensors(spark, sf_dir).orderBy("city_key", "sensor_id")


@query("position_parse", f"""
SELECT sensor_id, CAST(lat AS VARCHAR) || ',' || CAST(lon AS VARCHAR) AS position,
       lat AS p_lat, lon AS p_lon, CAST(NULL AS DOUBLE) AS bad
FROM ({V.SQL_SENSORS}) s
""")
def position_parse(spark, sf_dir):
    s = V.sensors(spark, sf_dir).select(
        "sensor_id", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("position"))
    lat, lon = geo.position("position")
    bad, _ = geo.position(F.lit("n/a,x"))
    return s.select("sensor_id", "position", lat.alias("p_lat"), lon.alias("p_lon"), bad.alias("bad"))


@query("centroid", f"""
SELECT city_key, {sql_exact_avg('lat', 2)} AS c_lat, {sql_exact_avg('lon', 2)} AS c_lon, count(*) AS n_sensors
FROM ({V.SQL_SENSORS}) s WHERE status = 'ACTIVE' GROUP BY city_key
""")
def centroid(spark, sf_dir):
    s = serve.active(V.sensors(spark, sf_dir))
    return s.groupBy("city_key").agg(exact_avg("lat", 2).alias("c_lat"), exact_avg("lon", 2).alias("c_lon"),
                                     F.count("*").alias("n_sensors"))


# Border points: the eight compass neighbours of the city point, listed out of order.
_OFFSETS = [(0, 1), (-1, -1), (1, 0), (0, -1), (1, 1), (-1, 0), (1, -1), (-1, 1)]


def _sql_sum(axis: str, idx: int) -> str:
    # Left-to-right double sum in array order, as the array aggregate does.
    return " + ".join(f"CAST(CAST(c.{axis} AS DECIMAL(10,2)) + ({o[idx]}) * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE)" for o in _OFFSETS)


@query("border_sort", f"""
WITH c AS ({V.SQL_CITIES}),
c2 AS (SELECT c.*, ({_sql_sum('lat', 0)}) / 8 AS clat, ({_sql_sum('lon', 1)}) / 8 AS clon FROM c),
o AS (SELECT * FROM (VALUES {", ".join(f"({a}, {b})" for a, b in _OFFSETS)}) t(dlat, dlon)),
p AS (SELECT city_key, clat, clon,
             CAST(CAST(c2.lat AS DECIMAL(10,2)) + dlat * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS latitude,
             CAST(CAST(c2.lon AS DECIMAL(10,2)) + dlon * CAST(0.01 AS DECIMAL(3,2)) AS DOUBLE) AS longitude FROM c2, o)
SELECT city_key, CAST(row_number() OVER (PARTITION BY city_key ORDER BY atan2(longitude - clon, latitude - clat)) AS INTEGER) AS pos,
       latitude, longitude FROM p
""")
def border_sort(spark, sf_dir):
    c = V.cities(spark, sf_dir)
    pts = F.array(*[F.struct(
        (F.col("lat").cast("decimal(10,2)") + F.lit(a) * F.lit(0.01).cast("decimal(3,2)")).cast("double").alias("latitude"),
        (F.col("lon").cast("decimal(10,2)") + F.lit(b) * F.lit(0.01).cast("decimal(3,2)")).cast("double").alias("longitude"))
        for a, b in _OFFSETS])
    b = c.select("city_key", pts.alias("border"))
    clat, clon = geo.centroid("border")
    b = b.select("city_key", geo.sort_border("border", clat, clon).alias("border"))
    e = b.select("city_key", F.posexplode("border").alias("pos", "pt"))
    return e.select("city_key", (F.col("pos") + 1).cast("int").alias("pos"),
                    F.col("pt.latitude").alias("latitude"), F.col("pt.longitude").alias("longitude"))


@query("haversine", f"""
SELECT s.sensor_id, s.city_key, round({sql_hav('s.lat', 's.lon', 'c.lat', 'c.lon')}, 6) AS dist_km
FROM ({V.SQL_SENSORS}) s JOIN ({V.SQL_CITIES}) c ON s.city_key = c.city_key
""")
def haversine(spark, sf_dir):
    s = V.sensors(spark, sf_dir)
    c = V.cities(spark, sf_dir).select("city_key", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    j = s.join(c, "city_key")  # AQE broadcasts the cities while they are small
    return j.select("sensor_id", "city_key", F.round(geo.haversine("lat", "lon", "c_lat", "c_lon"), 6).alias("dist_km"))


def _sql_nearest(places_sql: str, place_key: str, extra_filter: str = "") -> str:
    return f"""
WITH p AS ({V.SQL_POINTS}), q AS (SELECT * FROM ({places_sql}) x {extra_filter}),
d AS (SELECT p.point_id, q.{place_key}, {sql_hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} AS dist FROM p CROSS JOIN q),
b AS (SELECT point_id, {place_key}, dist FROM (
        SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY round(dist, 9), {place_key}) AS rn
        FROM d WHERE dist <= 2.0) t WHERE rn = 1)
SELECT p.point_id, b.{place_key}, round(b.dist, 6) AS dist_km FROM p LEFT JOIN b ON p.point_id = b.point_id
"""


@query("nearest_city", _sql_nearest(V.SQL_CITIES, "city_key"))
def nearest_city(spark, sf_dir):
    r = nearest(V.points(spark, sf_dir), V.cities(spark, sf_dir), "point_id", "city_key")
    return r.withColumn("dist_km", F.round("dist_km", 6))


@query("nearest_sensor", _sql_nearest(V.SQL_SENSORS, "sensor_id", "WHERE status = 'ACTIVE'"))
def nearest_sensor(spark, sf_dir):
    r = nearest(V.points(spark, sf_dir), serve.active(V.sensors(spark, sf_dir)), "point_id", "sensor_id")
    return r.withColumn("dist_km", F.round("dist_km", 6))


HIST_START, HIST_END = 1704672000, 1705276800  # 2024-01-08 00:00 .. 2024-01-15 00:00 UTC


@query("coordinate_history", f"""
WITH nn AS ({_sql_nearest(V.SQL_SENSORS, "sensor_id", "WHERE status = 'ACTIVE'")}),
hw AS ({V.SQL_HOURLY_WIDE}),
s AS ({V.SQL_SENSORS})
SELECT nn.point_id, nn.sensor_id, s.lat, s.lon, hw.ts,
       greatest({", ".join(sub_index_sql(p, 'hw.' + p) for p in V.WIDE_POLLUTANTS)}) AS aqi
FROM nn JOIN s ON nn.sensor_id = s.sensor_id JOIN hw ON hw.sensor_id = nn.sensor_id
WHERE epoch(hw.ts) BETWEEN {HIST_START} AND {HIST_END}
""")
def coordinate_history(spark, sf_dir):
    sensors = serve.active(V.sensors(spark, sf_dir))
    nn = nearest(V.points(spark, sf_dir), sensors, "point_id", "sensor_id", keep=["lat", "lon"])
    nn = nn.filter(F.col("sensor_id").isNotNull()).drop("dist_km")
    # only the sensors that are some point's nearest, only the hours asked for
    hist = serve.history(V.hourly_wide(spark, sf_dir, HIST_START, HIST_END, nn), HIST_START, HIST_END)
    hist = hist.select("sensor_id", "ts", aqi().alias("aqi"))
    return nn.join(hist, "sensor_id").select("point_id", "sensor_id", "lat", "lon", "ts", "aqi")
