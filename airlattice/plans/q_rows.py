"""Queries without an SQL oracle (iterative, model-based, file or stream driven).

Each reads the driver tables (or data Spark derives from them); scratch files go to a
fresh folder under the session's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from airlattice.constants import FORECAST_LAGS, FORECAST_STEPS, TRAIN_LAGS
from airlattice.operators import model as M
from airlattice.operators import series as S
from airlattice.operators.frame import pooled_frame
from airlattice.plans import views as V
from airlattice.plans.registry import query
from airlattice.session import ensure_checkpoint_dir
from airlattice.sources import files, store
from airlattice.streaming import ingest as R


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# The families whose whole search (50 draws x 5 folds) one node finishes in minutes.
TRAIN_FAMILIES = ["Linear", "DecisionTree"]
POLLUTANT_VALUES = V.MEASURED
K = ["sensor_id", "pollutant"]


def _network(spark, sf_dir):
    """The network's series as sensor -1: the sensors' own are about 13 hours, shorter than the lags."""
    return V.network_series(spark, sf_dir).select(F.lit(-1).cast("long").alias("sensor_id"), "pollutant", "ts", "value")


def _history(spark, sf_dir):
    """The sensors' series and the network's; rows without all their lags fall out of a frame."""
    return V.series_long(spark, sf_dir).select(*K, "ts", "value").unionByName(_network(spark, sf_dir))


def _training(spark, sf_dir, lags):
    return M.feature_frame(_history(spark, sf_dir), K, "ts", "value", lags, {"pollutant": POLLUTANT_VALUES})


@query("train_best")
def train_best(spark, sf_dir):
    """Split, scale and select the features of 24 lags, tune each family (50 seeded draws of its grid, each fitted
    over 5 time-block folds), score the holdout, pick the smallest MAE, refit the winner."""
    rows, cols = _training(spark, sf_dir, TRAIN_LAGS)
    frame = pooled_frame(rows, K, "ts", cols)
    return M.train_best(frame.rows, frame.features, K, "ts", TRAIN_FAMILIES).errors


@query("recursive_forecast")
def recursive_forecast(spark, sf_dir):
    """25 recursive hourly steps for every series at once with a linear model of 25 lags
    fitted on all of them; series shorter than that get null steps; first step dropped."""
    frame, cols = _training(spark, sf_dir, FORECAST_LAGS)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    lr = LinearRegression(featuresCol="features", labelCol="label", regParam=0.01, solver="normal")
    fitted = lr.fit(VectorAssembler(inputCols=cols, outputCol="features").transform(frame))
    history = _history(spark, sf_dir)
    return M.recursive_forecast(spark, history, fitted, K, "ts", "value", FORECAST_LAGS, {"pollutant": POLLUTANT_VALUES})


# Fixed coefficients over the full feature set, so that SQL can follow the recursion.
FIXED = {"lag_1": 0.55, "lag_2": 0.1, "lag_24": 0.25, "hour_cos": 1.5, "hour_sin": -0.75, "dow_cos": 0.25, "dow_sin": 0.5}
_LAGGED = " + ".join(f"{c!r} * h[{FORECAST_LAGS + 1 - int(f[4:])}]" for f, c in FIXED.items() if f.startswith("lag_"))
_CLOCK = " + ".join(f"{FIXED[f'{n}_{g}']!r} * {g}(2.0 * pi() * ({part}) / {m})" for n, part, m in (
    ("hour", "hour(t)", 24.0), ("dow", "isodow(t) - 1", 7.0)) for g in ("cos", "sin"))


@query("recursive_linear", f"""
WITH RECURSIVE n AS ({V.SQL_SERIES_LONG} UNION ALL SELECT -1, pollutant, ts, value FROM ({V.SQL_NETWORK_SERIES}) w),
q AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC) AS back FROM n),
b AS (SELECT sensor_id, pollutant, max(ts) AS t0, list(value ORDER BY ts) AS v FROM q WHERE back <= {FORECAST_LAGS} GROUP BY ALL),
r AS (
  SELECT sensor_id, pollutant, t0, 0 AS step,
         CASE WHEN len(v) = {FORECAST_LAGS} THEN v ELSE list_transform(range({FORECAST_LAGS}), lambda i: CAST(NULL AS DOUBLE)) END AS h, CAST(NULL AS DOUBLE) AS p FROM b
  UNION ALL
  SELECT sensor_id, pollutant, t0, step + 1, list_append(h[2:], p1), p1
  FROM (SELECT *, 2.5 + {_LAGGED} + {_CLOCK} AS p1 FROM (SELECT *, t0 + (step + 1) * INTERVAL 1 HOUR AS t FROM r WHERE step < {FORECAST_STEPS}) x) y)
SELECT sensor_id, pollutant, step, t0 + step * INTERVAL 1 HOUR AS ts, round(CASE WHEN p >= 0 THEN p END, 6) AS value FROM r WHERE step > 1
""")
def recursive_linear(spark, sf_dir):
    """M13 with 25 lags and given coefficients: every sensor's series (most are shorter than the lags and
    get null steps) and, as sensor -1, the network's."""
    long = _history(spark, sf_dir)
    out = M.recursive_forecast(spark, long, M.Coefficients(2.5, FIXED), K, "ts", "value", FORECAST_LAGS)
    return out.withColumn("value", F.round("value", 6)).withColumn("step", F.col("step").cast("int"))


@query("backfill_files")
def backfill_files(spark, sf_dir):
    """S8 + S6: hourly readings dropped as CSV files per collection and city (a folder per
    city, not per sensor) are read back in one scan, the collection from the path, and
    appended by key; the replay appends nothing."""
    root = scratch(spark, "dropped")
    hw = V.hourly_wide(spark, sf_dir)
    city = V.sensors(spark, sf_dir).select("sensor_id", F.col("city_key").alias("city"))
    dropped = hw.join(city, "sensor_id", "left").select(
        F.lit("pollution").alias("collection"), F.coalesce("city", F.lit(-1)).alias("city"),
        F.col("sensor_id").cast("string").alias("sensor"), F.unix_seconds("ts").alias("time"),
        "co", "no2", "o3", "pm2_5", "pm10", "so2")
    dropped.repartition("city").write.partitionBy("collection", "city").option("header", "true").csv(root)
    schema = "sensor string, time long, co double, no2 double, o3 double, pm2_5 double, pm10 double, so2 double"
    back = files.backfill(spark, root, schema, {"collection": files.PATH_KEYS["collection"]})
    target = scratch(spark, "store")
    store.append_new(spark, back, target, ["sensor", "collection", "time"], ["collection"])
    store.append_new(spark, back, target, ["sensor", "collection", "time"], ["collection"])  # replay: no-op
    return spark.read.parquet(target)


def _land_events(spark, sf_dir, root):
    """Land events as one parquet file set per day (the stream's input files)."""
    ev = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(root)
    return ev.schema.add("day", "date")


@query("stream_ingest")
def stream_ingest(spark, sf_dir):
    """File-source stream -> per-batch anti join on (user_id, ts) -> append to a store by
    day, of which a batch reads only its own days."""
    land = scratch(spark, "landing")
    schema = _land_events(spark, sf_dir, land)
    stream = R.read_landing(spark, land, schema, max_files=8)
    target = scratch(spark, "readings")
    q = R.ingest(spark, stream, target, ["user_id", "ts", "day"], scratch(spark, "ckpt"), ["day"], order="event_id")
    q.awaitTermination()
    return spark.read.parquet(target).select("event_id", "user_id", "event_type", "ts", "value", "props")


@query("stream_dedup")
def stream_dedup(spark, sf_dir):
    """R2: duplicates of (user_id, event_type, ts) dropped within the watermark; the landed
    input holds every event twice. Files land in no time order and are read in several
    batches, so the delay covers the whole input: a shorter one loses the rows that come
    later than it (bounded state is what a watermark trades them for)."""
    land = scratch(spark, "landing")
    schema = _land_events(spark, sf_dir, land)
    _land_events(spark, sf_dir, land)  # every event lands twice
    stream = R.read_landing(spark, land, schema, max_files=24).select("event_id", "user_id", "event_type", "ts", "value")
    out = scratch(spark, "dedup")
    q = R.sink_parquet(R.dedup(stream, ["user_id", "event_type"], "ts", "366 days"), out, scratch(spark, "ckpt"))
    q.awaitTermination()
    return spark.read.parquet(out)


@query("stream_keep_last")
def stream_keep_last(spark, sf_dir):
    """R2 + W3: the last event of each (user, type, hour). The events land in two parts, the second after the stream has
    ended once, so it goes on from its checkpoint; files come in no time order and the delay covers the input."""
    land, out, state = (scratch(spark, n) for n in ("landing", "changes", "ckpt"))
    ev = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    keys, order = ["user_id", "event_type", "hour"], ["event_id"]
    for part in range(2):
        ev.where(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).withColumn("day", F.to_date("ts")).repartition("day") \
            .write.mode("append").partitionBy("day").parquet(land)
        stream = R.read_landing(spark, land, ev.schema.add("day", "date"), max_files=24)
        hourly = stream.select("event_id", "user_id", "event_type", "ts", "value", F.date_trunc("hour", "ts").alias("hour"))
        R.sink_changes(R.keep_last(hourly, keys[:2], "hour", order, "366 days"), out, state).awaitTermination()
    return R.read_last(spark, out, keys, order)


@query("stream_aqi")
def stream_aqi(spark, sf_dir):
    """AQI on a stream of hourly wide readings."""
    land = scratch(spark, "landing")
    hw = V.hourly_wide(spark, sf_dir)
    hw.write.parquet(land)
    stream = R.read_landing(spark, land, hw.schema)
    out = scratch(spark, "aqi")
    q = R.sink_parquet(R.with_aqi(stream), out, scratch(spark, "ckpt"))
    q.awaitTermination()
    return spark.read.parquet(out)


@query("direct_forecast")
def direct_forecast(spark, sf_dir):
    """One model per horizon (24) of 25 lags, fitted on the sensors' series and the network's, applied to each
    series' last row; a series no longer than the lags has none."""
    history = _history(spark, sf_dir)
    return M.direct_forecast(history, K, "ts", "value", FORECAST_LAGS)


@query("direct_sums", f"""
WITH n AS ({V.SQL_SERIES_LONG} UNION ALL SELECT -1, pollutant, ts, value FROM ({V.SQL_NETWORK_SERIES}) w),
l AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, {FORECAST_LAGS}) OVER w AS l25, {", ".join(f"lead(value, {h}) OVER w AS y{h}" for h in range(1, FORECAST_STEPS))}
      FROM n WHERE value IS NOT NULL WINDOW w AS (PARTITION BY sensor_id, pollutant ORDER BY ts)),
u AS (SELECT l1, l25, unnest(range(1, {FORECAST_STEPS})) AS step, unnest([{", ".join(f"y{h}" for h in range(1, FORECAST_STEPS))}]) AS y FROM l WHERE l25 IS NOT NULL)
SELECT CAST(step AS INTEGER) AS step, CAST(count(*) AS BIGINT) AS n, round(sum(l1), 2) AS s1, round(sum(l1 * l25), 2) AS s1_25, round(sum(l25 * l25), 2) AS s25,
       round(sum(y), 2) AS sy, round(sum(l1 * y), 2) AS s1_y, round(sum(l25 * y), 2) AS s25_y
FROM u WHERE y IS NOT NULL GROUP BY step
""")
def direct_sums(spark, sf_dir):
    """Some of the cross-products of every horizon, as the direct forecast takes them from one pass."""
    from airlattice.operators import direct
    steps = FORECAST_STEPS - 1
    history = _history(spark, sf_dir)
    gram, cross = direct.sums(direct.frame(history, K, "ts", "value", FORECAST_LAGS, steps), FORECAST_LAGS, steps)
    a, b = 1, FORECAST_LAGS          # the first and the last lag; 0 is the constant
    found = [(h + 1, int(round(g[0, 0])), *map(float, (g[0, a], g[a, b], g[b, b], c[0], c[a], c[b]))) for h, (g, c) in enumerate(zip(gram, cross))]
    names = ["s1", "s1_25", "s25", "sy", "s1_y", "s25_y"]
    out = spark.createDataFrame(found, "step int, n long, " + ", ".join(f"{c} double" for c in names)).where("n > 0")
    return out.withColumns({c: F.round(c, 2) for c in names})


# Oracles for the file / stream round trips whose end state SQL can state.
from airlattice.functions.aqi import sub_index_sql  # noqa: E402
from airlattice.plans.registry import ORACLE  # noqa: E402

ORACLE["stream_ingest"] = """
SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, value, props
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) = 1
"""
ORACLE["stream_dedup"] = """
SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, value
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) = 1
"""
ORACLE["stream_keep_last"] = """
SELECT event_id, user_id, event_type, CAST(ts AS TIMESTAMP) AS ts, value, date_trunc('hour', CAST(ts AS TIMESTAMP)) AS hour
FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY event_id DESC) = 1
"""
ORACLE["stream_aqi"] = (
    f"SELECT *, greatest({', '.join(sub_index_sql(p, p) for p in V.WIDE_POLLUTANTS)}) AS aqi "
    f"FROM ({V.SQL_HOURLY_WIDE}) hw")
ORACLE["backfill_files"] = (
    "SELECT CAST(sensor_id AS VARCHAR) AS sensor, CAST(epoch(ts) AS BIGINT) AS time, co, no2, o3, pm2_5, pm10, so2, "
    f"'pollution' AS collection FROM ({V.SQL_HOURLY_WIDE}) hw")
