"""Ingest and clean queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlattice.functions.aqi import aqi, sub_index, sub_index_sql
from airlattice.functions.stats import sql_exact_avg
from airlattice.operators import clean
from airlattice.plans import views as V
from airlattice.plans.registry import ORACLE, query
from airlattice.sources import landing, records

POLS = V.MEASURED  # pm2_5, pm10, no2, o3, so2
WIDE = V.WIDE_POLLUTANTS  # co + measured

_AQI_SQL = "greatest(" + ", ".join(sub_index_sql(p, p) for p in WIDE) + ")"


def _r6(cols):
    return {c: F.round(F.col(c), 6) for c in cols}


def _sql_r6(cols):
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ------------------------------------------------------------------ flagship (A1 A2 H2)
def aqi_hourly_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    hw = V.hourly_wide(spark, sf_dir)
    filled = clean.fill_mean(hw, ["sensor_id"], POLS, scale=6)
    return filled.withColumn("aqi", aqi())


AQI_HOURLY_SQL = f"""
WITH hw AS ({V.SQL_HOURLY_WIDE}),
m AS (SELECT sensor_id, {", ".join(f"{sql_exact_avg(p, 6)} AS m_{p}" for p in POLS)} FROM hw GROUP BY sensor_id),
f AS (
  SELECT hw.sensor_id, ts, co, {", ".join(f"coalesce({p}, m_{p}) AS {p}" for p in POLS)}
  FROM hw JOIN m ON hw.sensor_id = m.sensor_id)
SELECT sensor_id, ts, co, no2, o3, pm2_5, pm10, so2, {_AQI_SQL} AS aqi FROM f
"""

query("aqi_hourly", AQI_HOURLY_SQL)(aqi_hourly_df)


# ------------------------------------------------------------------ H2
@query("index_each", f"""
WITH r AS (SELECT event_id, user_id AS sensor_id, {V._case_pollutant()} AS pollutant, value FROM events)
SELECT event_id, sensor_id, pollutant, value,
  CASE pollutant {" ".join(f"WHEN '{p}' THEN {sub_index_sql(p, 'value')}" for p in POLS)} END AS idx,
  {sub_index_sql('co', '(value / 10.0)')} AS co_idx
FROM r
""")
def index_each(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    r = ev.select("event_id", F.col("user_id").alias("sensor_id"),
                  V._pollutant_col().alias("pollutant"), "value")
    idx = None
    for p in POLS:
        cond = F.col("pollutant") == p
        idx = F.when(cond, sub_index(p, "value")) if idx is None else idx.when(cond, sub_index(p, "value"))
    return r.select("event_id", "sensor_id", "pollutant", "value", idx.alias("idx"),
                    sub_index("co", F.col("value") / F.lit(10.0)).alias("co_idx"))


# ------------------------------------------------------------------ P1 P2
def _upstream(spark, sf_dir) -> DataFrame:
    """Upstream-named weather-style rows built from events."""
    ev = V.table(spark, sf_dir, "events")
    return ev.select(
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("dt"),
        F.col("user_id").alias("sensorId"),
        F.col("value").alias("temperature"),
        (F.col("value") / 2).alias("dewPoint"),
        F.col("props").alias("summary"),
        F.col("event_type").alias("icon"),
        F.col("event_id").alias("co2"),
        F.col("event_type").alias("precipType"),
        (F.col("value") * 3).alias("windSpeed"),
        F.col("event_type").alias("weatherCode"),
    )


@query("rename_drop", """
SELECT CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS time, user_id AS sensorId, value AS temp,
  value / 2 AS dew_point, value * 3 AS wind_speed
FROM events
""")
def rename_drop(spark, sf_dir):
    return clean.drop_unneeded(clean.rename(_upstream(spark, sf_dir)))


# ------------------------------------------------------------------ P4
@query("coerce_numeric", """
SELECT event_id,
  TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value_num,
  TRY_CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS DOUBLE) AS k_num,
  TRY_CAST(props AS DOUBLE) AS props_num,
  TRY_CAST(event_type AS DOUBLE) AS type_num
FROM events
""")
def coerce_numeric(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    raw = ev.select("event_id",
                    F.col("value").cast("string").alias("value_num"),
                    F.regexp_extract("props", r'"k": ([0-9]+)', 1).alias("k_num"),
                    F.col("props").alias("props_num"),
                    F.col("event_type").alias("type_num"))
    return clean.coerce(raw, ["value_num", "k_num", "props_num", "type_num"])


# ------------------------------------------------------------------ P5 H16
@query("epoch_to_ts", """
WITH e AS (SELECT event_id, CAST(floor(epoch(CAST(ts AS TIMESTAMP))) AS BIGINT) AS epoch FROM events)
SELECT event_id, epoch, make_timestamp(epoch * 1000000) AS ts_sec,
  make_timestamp(epoch * 1000000) + INTERVAL 1 HOUR AS next_ts,
  CAST(epoch - epoch % 3600 AS BIGINT) AS hour_epoch,
  CAST(NULL AS TIMESTAMP) AS bad_ts
FROM e
""")
def epoch_to_ts(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    e = ev.select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("epoch"))
    return e.select(
        "event_id", "epoch",
        clean.to_ts("epoch").alias("ts_sec"),
        (clean.to_ts("epoch") + F.expr("INTERVAL 1 HOUR")).alias("next_ts"),
        F.unix_seconds(F.date_trunc("hour", clean.to_ts("epoch"))).alias("hour_epoch"),
        clean.to_ts(F.lit("not-a-time")).alias("bad_ts"),
    )


# ------------------------------------------------------------------ P3 S4
@query("flatten_props", """
SELECT event_id AS id,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS props_k,
  value AS main_value,
  CASE WHEN event_id % 2 = 0 THEN user_id END AS tags,
  CASE WHEN event_id % 2 = 1 THEN user_id END AS tags_0,
  CASE WHEN event_id % 2 = 1 THEN event_id END AS tags_1,
  value AS pair_0_v,
  value * 2 AS pair_1_v
FROM events
""")
def flatten_props(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    nested = ev.select(
        F.col("event_id").alias("id"),
        F.from_json("props", "k INT").alias("props"),
        F.struct(F.col("value").alias("value"), F.col("event_type").alias("secret")).alias("main"),
        F.when(F.col("event_id") % 2 == 0, F.array("user_id"))
         .otherwise(F.array("user_id", "event_id")).alias("tags"),
        F.array(F.struct(F.col("value").alias("v"), F.col("event_type").alias("secret")),
                F.struct((F.col("value") * 2).alias("v"), F.col("event_type").alias("secret"))).alias("pair"),
    )
    return landing.flatten(nested, exclude=("secret",))


@query("flatten_records", ORACLE["flatten_props"])
def flatten_records(spark, sf_dir):
    """P3 over JSON text of differing keys, in one scan."""
    ev = V.table(spark, sf_dir, "events")
    payload = F.to_json(F.struct(
        F.from_json("props", "k INT").alias("props"),
        F.struct("value", F.col("event_type").alias("secret")).alias("main"),
        F.when(F.col("event_id") % 2 == 0, F.array("user_id")).otherwise(F.array("user_id", "event_id")).alias("tags"),
        F.array(F.struct(F.col("value").alias("v"), F.col("event_type").alias("secret")),
                F.struct((F.col("value") * 2).alias("v"), F.col("event_type").alias("secret"))).alias("pair")))
    wanted = {"props_k": "int", "main_value": "double", "tags": "bigint", "tags_0": "bigint", "tags_1": "bigint",
              "pair_0_v": "double", "pair_1_v": "double"}
    landed = ev.select(F.col("event_id").alias("id"), payload.alias("payload"))
    return records.flatten_records(landed, "payload", wanted, ["id"], exclude=["secret"])


# ------------------------------------------------------------------ S5
@query("payload_merge", f"""
WITH hw AS ({V.SQL_HOURLY_WIDE})
SELECT sensor_id, CAST(epoch(ts) AS BIGINT) AS time, {_AQI_SQL} AS aqi, co, no2, o3, pm2_5, pm10, so2 FROM hw
""")
def payload_merge(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir)
    # A landed payload per (sensor, day): list[] of {dt, main{aqi}, components{...}}.
    payload = (hw.groupBy("sensor_id", F.to_date("ts").alias("day"))
                 .agg(F.collect_list(F.struct(
                     F.unix_seconds("ts").alias("dt"),
                     F.struct(aqi().alias("aqi")).alias("main"),
                     F.struct(*WIDE).alias("components"))).alias("list")))
    return landing.land_pollution(payload, keys=["sensor_id"])


# ------------------------------------------------------------------ P13 P14
@query("null_filters", f"""
WITH hw AS ({V.SQL_HOURLY_WIDE})
SELECT sensor_id, ts, no2, o3, pm2_5, pm10, so2 FROM hw WHERE no2 IS NOT NULL OR o3 IS NOT NULL
""")
def null_filters(spark, sf_dir):
    hw = clean.drop_null_columns(V.hourly_wide(spark, sf_dir), keep=["sensor_id", "ts"])
    return clean.drop_null_rows(hw, ["no2", "o3"], how="all")


# ------------------------------------------------------------------ A2
@query("fill_mean", f"""
WITH hw AS ({V.SQL_HOURLY_WIDE}),
m AS (SELECT sensor_id, {", ".join(f"{sql_exact_avg(p, 6)} AS m_{p}" for p in POLS)} FROM hw GROUP BY sensor_id)
SELECT hw.sensor_id, ts, {", ".join(f"coalesce({p}, m_{p}) AS {p}" for p in POLS)}
FROM hw JOIN m ON hw.sensor_id = m.sensor_id
""")
def fill_mean(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir).drop("co")
    return clean.fill_mean(hw, ["sensor_id"], POLS, scale=6)


# ------------------------------------------------------------------ A3
_SEGMENT_NULLS = "CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END"


@query("fill_mode", f"""
WITH c AS (SELECT c_custkey, c_nationkey, {_SEGMENT_NULLS} AS segment FROM customer),
cnt AS (SELECT c_nationkey, segment, count(*) AS n FROM c WHERE segment IS NOT NULL GROUP BY 1, 2),
md AS (SELECT c_nationkey, segment AS m FROM (
   SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, segment) AS rn FROM cnt) t WHERE rn = 1)
SELECT c.c_custkey, c.c_nationkey, coalesce(c.segment, md.m) AS segment
FROM c LEFT JOIN md ON c.c_nationkey = md.c_nationkey
""")
def fill_mode(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", F.expr(_SEGMENT_NULLS).alias("segment"))
    return clean.fill_mode(c, ["c_nationkey"], ["segment"])


# ------------------------------------------------------------------ P15
def _coarse(p):
    return f"floor({p} / 100) * 100"


@query("zero_variance_mask", f"""
WITH hw AS (SELECT sensor_id, ts, {", ".join(f"CAST({_coarse(p)} AS DOUBLE) AS {p}" for p in POLS)}
            FROM ({V.SQL_HOURLY_WIDE}) x),
sd AS (SELECT sensor_id, {", ".join(f"stddev_samp({p}) AS sd_{p}" for p in POLS)} FROM hw GROUP BY sensor_id)
SELECT hw.sensor_id, ts, {", ".join(f"CASE WHEN sd_{p} = 0 THEN NULL ELSE {p} END AS {p}" for p in POLS)}
FROM hw JOIN sd ON hw.sensor_id = sd.sensor_id
""")
def zero_variance_mask(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir).select(
        "sensor_id", "ts", *[F.expr(_coarse(p)).cast("double").alias(p) for p in POLS])
    return clean.mask_constant(hw, ["sensor_id"], POLS)


# ------------------------------------------------------------------ W3
@query("dedup_keep_last", f"""
WITH r AS (SELECT event_id, user_id AS sensor_id, CAST(ts AS TIMESTAMP) AS ts, date_trunc('hour', ts) AS hour,
                  {V._case_pollutant()} AS pollutant, value FROM events)
SELECT sensor_id, hour, pollutant, value, ts, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, hour, pollutant ORDER BY ts DESC, event_id DESC) AS rn FROM r) t
WHERE rn = 1
""")
def dedup_keep_last(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events")
    r = ev.select("event_id", F.col("user_id").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"),
                  F.date_trunc("hour", "ts").alias("hour"), V._pollutant_col().alias("pollutant"), "value")
    return clean.dedup_keep_last(r, ["sensor_id", "hour", "pollutant"], ["ts", "event_id"])


# ------------------------------------------------------------------ W7
@query("dedup_identical", f"""
WITH hw AS ({V.SQL_HOURLY_WIDE}),
ix AS (SELECT sensor_id, ts, {", ".join(f"{sub_index_sql(p, p)} AS i_{p}" for p in POLS)} FROM hw)
SELECT sensor_id, ts, {", ".join(f"i_{p}" for p in POLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, {", ".join(f"i_{p}" for p in POLS)} ORDER BY ts DESC) AS rn
  FROM ix) t WHERE rn = 1
""")
def dedup_identical(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir)
    ix = hw.select("sensor_id", "ts", *[sub_index(p, p).alias(f"i_{p}") for p in POLS])
    return clean.collapse_identical(ix, ["sensor_id"], [f"i_{p}" for p in POLS], "ts")


# ------------------------------------------------------------------ J2 U4 U5 S6 S7
OLD_CUT = "TIMESTAMP '2024-01-20 00:00:00'"
NEW_FROM = "TIMESTAMP '2024-01-15 00:00:00'"


def _old_new(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    old = ev.filter(F.col("ts") < F.expr(OLD_CUT)).select("event_id", "user_id", "ts", "value", "props")
    new = ev.filter(F.col("ts") >= F.expr(NEW_FROM)).select("user_id", "ts", "event_type", "value", "event_id")
    return old, new


@query("new_rows_anti", f"""
WITH o AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, value, props FROM events WHERE ts < {OLD_CUT}),
n AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, event_type, value, event_id FROM events WHERE ts >= {NEW_FROM})
SELECT user_id, ts, value, event_id FROM n
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.user_id IS NOT DISTINCT FROM n.user_id AND o.ts IS NOT DISTINCT FROM n.ts)
""")
def new_rows_anti(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return clean.new_rows(new, old, ["user_id", "ts"])


# ------------------------------------------------------------------ U1 U3
@query("union_sparse", f"""
SELECT user_id AS sensor_id, CAST(ts AS TIMESTAMP) AS ts, value AS pm2_5, NULL::DOUBLE AS no2, NULL::DOUBLE AS o3, NULL::VARCHAR AS note
FROM events WHERE event_type = 'click'
UNION ALL
SELECT user_id, CAST(ts AS TIMESTAMP), NULL, value, NULL, NULL FROM events WHERE event_type = 'purchase'
UNION ALL
SELECT user_id, CAST(ts AS TIMESTAMP), NULL, NULL, value, props FROM events WHERE event_type NOT IN ('click', 'purchase')
""")
def union_sparse(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("sensor_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", "props")
    a = ev.filter("event_type = 'click'").select("sensor_id", "ts", F.col("value").alias("pm2_5"))
    b = ev.filter("event_type = 'purchase'").select("sensor_id", "ts", F.col("value").alias("no2"))
    c = ev.filter("event_type NOT IN ('click', 'purchase')").select("sensor_id", "ts", F.col("value").alias("o3"),
                                                   F.col("props").alias("note"))
    return clean.union_sparse(a, b, c)


# ------------------------------------------------------------------ S9 U2
@query("snapshot_union", f"""
WITH l AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, value, 0 AS src FROM events WHERE ts < {OLD_CUT}),
s AS (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts, value + 1 AS value, 1 AS src FROM events WHERE ts >= {NEW_FROM}),
u AS (SELECT * FROM l UNION ALL SELECT * FROM s)
SELECT user_id, ts, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY src DESC) AS rn FROM u) t WHERE rn = 1
""")
def snapshot_union(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    local = ev.filter(F.col("ts") < F.expr(OLD_CUT))
    stored = ev.filter(F.col("ts") >= F.expr(NEW_FROM)).withColumn("value", F.col("value") + 1)
    return clean.merge_snapshots(local, stored, ["user_id", "ts"])


# ------------------------------------------------------------------ M1
STORED_UNTIL = "TIMESTAMP '2024-01-15 00:00:00'"


def _raw_processed(spark, sf_dir):
    hw = V.hourly_wide(spark, sf_dir)
    # every reading arrives twice: a first copy one unit off, then the one that counts
    raw = hw.select(F.col("sensor_id").alias("sensorId"), F.unix_seconds("ts").alias("time"),
                    *POLS, "co", F.lit("01d").alias("weatherIcon"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ingested"))
    raw = raw.withColumns({p: F.col(p) + (1 - F.col("ingested")) for p in POLS})
    processed = (hw.filter(F.col("ts") < F.expr(STORED_UNTIL))
                   .select(F.col("sensor_id").alias("sensorId"), F.unix_seconds("ts").alias("time"), *POLS)
                   .withColumn("aqi", aqi({p: p for p in POLS})))
    return raw, processed


_M1_SQL = f"""
WITH hw AS ({V.SQL_HOURLY_WIDE}),
raw AS (SELECT sensor_id AS sensorId, CAST(epoch(ts) AS BIGINT) AS time, {", ".join(POLS)} FROM hw),
processed AS (SELECT sensor_id AS sensorId, CAST(epoch(ts) AS BIGINT) AS time, {", ".join(POLS)} FROM hw
              WHERE ts < {STORED_UNTIL}),
nw AS (SELECT * FROM raw r WHERE NOT EXISTS (
         SELECT 1 FROM processed p WHERE p.sensorId = r.sensorId AND p.time = r.time)),
u AS (SELECT * FROM processed UNION ALL SELECT * FROM nw),
u2 AS (SELECT * FROM u WHERE {" OR ".join(f"{p} IS NOT NULL" for p in POLS)}),
m AS (SELECT sensorId, {", ".join(f"{sql_exact_avg(p, 6)} AS m_{p}" for p in POLS)} FROM u2 GROUP BY sensorId),
f AS (SELECT u2.sensorId, time, {", ".join(f"coalesce({p}, m_{p}) AS {p}" for p in POLS)}
      FROM u2 JOIN m ON u2.sensorId = m.sensorId),
sd AS (SELECT sensorId, {", ".join(f"stddev_samp({p}) AS sd_{p}" for p in POLS)} FROM f GROUP BY sensorId),
g AS (SELECT f.sensorId, time, {", ".join(f"CASE WHEN sd_{p} = 0 THEN NULL ELSE {p} END AS {p}" for p in POLS)}
      FROM f JOIN sd ON f.sensorId = sd.sensorId)
SELECT sensorId, time, {", ".join(POLS)}, {"greatest(" + ", ".join(sub_index_sql(p, p) for p in POLS) + ")"} AS aqi
FROM g WHERE NOT EXISTS (SELECT 1 FROM processed p WHERE p.sensorId = g.sensorId AND p.time = g.time)
"""


@query("clean_pipeline", _M1_SQL)
def clean_pipeline(spark, sf_dir):
    raw, processed = _raw_processed(spark, sf_dir)
    out = clean.process(raw, processed, ["sensorId"], "time", "pollution", "ingested", scale=6)
    return out.select("sensorId", "time", *POLS, "aqi")
