"""Time feature queries (H3-H11, M2) over the hourly series timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.constants import COUNTRY_ZONES, SEASON_CODES, SEASONS
from airlattice.functions import timefeat as T
from airlattice.operators.joins import broadcast_constant
from airlattice.plans import views as V
from airlattice.plans.registry import query

SQL_PARTS = {
    "month": "CAST(month(ts) AS INTEGER)",
    "day": "CAST(day(ts) AS INTEGER)",
    "hour": "CAST(hour(ts) AS INTEGER)",
    "week_of_year": "CAST(weekofyear(ts) AS INTEGER)",
    "day_of_week": "CAST(isodow(ts) - 1 AS INTEGER)",
    "day_of_year": "CAST(dayofyear(ts) AS INTEGER)",
    "quarter": "CAST(quarter(ts) AS INTEGER)",
    "days_in_month": "CAST(day(last_day(ts)) AS INTEGER)",
}
_MD = "(month(ts) * 100 + day(ts))"
SQL_SEASON = "CASE " + " ".join(
    f"WHEN {_MD} BETWEEN {m0 * 100 + d0} AND {m1 * 100 + d1} THEN '{n}'" for n, (m0, d0), (m1, d1) in SEASONS) + " END"
SQL_SEASON_CODE = "CASE " + " ".join(f"WHEN ({SQL_SEASON}) = '{n}' THEN {c}" for n, c in SEASON_CODES.items()) + " END"
SQL_SESSION = "CAST(greatest(ceil(hour(ts) / 4) - 1, 0) AS INTEGER)"


def _sql_cyc(v: str, m: int) -> str:
    a = f"(2.0::DOUBLE * pi() * CAST({v} AS DOUBLE)) / CAST({m} AS DOUBLE)"
    return f"round(cos({a}), 9) + 0.0::DOUBLE", f"round(sin({a}), 9) + 0.0::DOUBLE"


_HOURS = f"SELECT sensor_id, ts FROM ({V.SQL_HOURLY_WIDE}) hw"


@query("time_parts", f"SELECT sensor_id, ts, {', '.join(f'{e} AS {n}' for n, e in SQL_PARTS.items())} FROM ({_HOURS}) h")
def time_parts(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir).select("sensor_id", "ts")
    return hw.withColumns(T.time_parts("ts"))


def _cyc_sql_cols() -> str:
    parts = dict(SQL_PARTS)
    parts["season"] = SQL_SEASON_CODE
    parts["session"] = SQL_SESSION
    out = []
    for n, e in parts.items():
        c, s = _sql_cyc(e, T.PART_MAX[n])
        out += [f"{c} AS {n}_cos", f"{s} AS {n}_sin"]
    return ", ".join(out)


@query("cyclic_features", f"SELECT sensor_id, ts, {_cyc_sql_cols()} FROM ({_HOURS}) h")
def cyclic_features(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir).select("sensor_id", "ts")
    out = T.time_features(hw, "ts")
    return out.select("sensor_id", "ts", *[c for c in out.columns if c.endswith("_cos") or c.endswith("_sin")])


SQL_FLAGS = {
    "is_month_start": "day(ts) = 1",
    "is_month_end": "CAST(ts AS DATE) = last_day(ts)",
    "is_quarter_start": "day(ts) = 1 AND month(ts) IN (1, 4, 7, 10)",
    "is_quarter_end": "CAST(ts AS DATE) = last_day(ts) AND month(ts) IN (3, 6, 9, 12)",
    "is_year_start": "month(ts) = 1 AND day(ts) = 1",
    "is_year_end": "month(ts) = 12 AND day(ts) = 31",
    "is_leap_year": "(year(ts) % 4 = 0 AND year(ts) % 100 <> 0) OR year(ts) % 400 = 0",
    "is_weekend": "CASE WHEN isodow(ts) IN (6, 7) THEN 0 ELSE 1 END",
}


@query("calendar_flags", f"SELECT sensor_id, ts, {', '.join(f'({e}) AS {n}' for n, e in SQL_FLAGS.items())} "
       f"FROM (SELECT sensor_id, ts FROM ({V.SQL_HOURLY_WIDE}) x UNION ALL "
       f"SELECT -1, CAST(d AS TIMESTAMP) FROM (VALUES (DATE '2024-01-01'), (DATE '2024-02-29'), (DATE '2024-03-31'), "
       f"(DATE '2023-12-31'), (DATE '2100-02-28')) v(d)) h")
def calendar_flags(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir).select("sensor_id", "ts")
    edge = spark.createDataFrame([("2024-01-01",), ("2024-02-29",), ("2024-03-31",), ("2023-12-31",),
                                  ("2100-02-28",)], "d string") \
        .select(F.lit(-1).cast("bigint").alias("sensor_id"), F.to_timestamp("d").alias("ts"))
    return hw.unionByName(edge).withColumns(T.calendar_flags("ts"))


@query("season_session", f"SELECT sensor_id, ts, {SQL_SEASON} AS season, {SQL_SEASON_CODE} AS season_code, "
       f"{SQL_SESSION} AS session FROM ({_HOURS}) h")
def season_session(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir).select("sensor_id", "ts")
    return hw.withColumns({"season": T.season("ts"), "season_code": T.season_code("ts"),
                           "session": T.session_code("ts")})


@query("categorical_codes", """
SELECT event_id, event_type, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INTEGER) AS type_code,
       CAST(dense_rank() OVER (ORDER BY json_extract_string(props, '$.k')) - 1 AS INTEGER) AS k_code
FROM events
""")
def categorical_codes(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select(
        "event_id", "event_type", F.col("event_type").alias("type_code"),
        F.get_json_object("props", "$.k").alias("k_code"))
    return T.codes(ev, ["type_code", "k_code"])


@query("hour_rounding", """
SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, date_trunc('hour', ts) AS current_hour,
       date_trunc('hour', ts) + INTERVAL 1 HOUR AS next_hour,
       date_trunc('hour', ts + INTERVAL 30 MINUTE) AS closest_hour
FROM events
""")
def hour_rounding(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ev.withColumns({f"{h}_hour": T.hour_round("ts", h) for h in ("current", "next", "closest")})


_ZONES_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{z}')" for c, z in COUNTRY_ZONES.items()) + ") z(country_code, zone)"


@query("local_time", f"""
WITH hw AS ({_HOURS}), s AS ({V.SQL_SENSORS}), c AS ({V.SQL_CITIES}), z AS ({_ZONES_SQL})
SELECT hw.sensor_id, hw.ts, c.country_code, z.zone, timezone(z.zone, hw.ts AT TIME ZONE 'UTC') AS local_ts
FROM hw JOIN s ON hw.sensor_id = s.sensor_id JOIN c ON s.city_key = c.city_key
JOIN z ON z.country_code = c.country_code
""")
def local_time(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir).select("sensor_id", "ts")
    s = V.sensors(spark, sf_dir).select("sensor_id", "city_key")
    c = V.cities(spark, sf_dir).select("city_key", "country_code")
    zones = spark.createDataFrame(list(COUNTRY_ZONES.items()), "country_code string, zone string")
    # catalogue-sized sides: the city table (25 rows) and the zone table (15 rows) are constants
    geo = s.join(broadcast_constant(c), "city_key").join(broadcast_constant(zones), "country_code")
    j = hw.join(geo, "sensor_id")
    return j.select("sensor_id", "ts", "country_code", "zone", T.local_time(j, "ts", "zone").alias("local_ts"))
