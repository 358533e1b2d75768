"""Queries of the recursive forecast with weather and stored scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.constants import FORECAST_LAGS, FORECAST_STEPS
from airlattice.operators import recursion as R
from airlattice.operators import series as S
from airlattice.operators import trees as T
from airlattice.plans import views as V
from airlattice.plans.q_series import AS_OF
from airlattice.plans.q_trees import SQL_HISTORY, history
from airlattice.plans.registry import query
from airlattice.session import cut_lineage

K = ["sensor_id", "pollutant"]
EXO = ["temp", "wind"]

_WEATHER = """CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS DOUBLE) / count(*) AS temp, CAST(count(*) AS DOUBLE) AS wind"""
SQL_WEATHER = f"""
SELECT user_id AS sensor_id, date_trunc('hour', ts) AS ts, {_WEATHER} FROM events GROUP BY 1, 2
UNION ALL SELECT -1, date_trunc('hour', ts), {_WEATHER} FROM events GROUP BY 2"""


def weather(spark, sf_dir):
    """Hourly weather of every sensor and, as sensor -1, of the network; one scan."""
    ev = V.table(spark, sf_dir, "events").select(
        F.explode(F.array(F.col("user_id").cast("long"), F.lit(-1).cast("long"))).alias("sensor_id"), F.date_trunc("hour", "ts").alias("ts"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    return ev.groupBy("sensor_id", "ts").agg((F.sum("k").cast("double") / F.count(F.lit(1))).alias("temp"), F.count(F.lit(1)).cast("double").alias("wind"))


def _stored(spark, sf_dir, series, wx):
    """Scaler statistics of the hours up to as_of, as they would be stored with a model; one written table."""
    j = S.cutoff(series, "ts", AS_OF).join(wx.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR")), ["sensor_id", "ts"], "left")
    return cut_lineage(S.scale_stats(j, K, ["value", *EXO], "min_max"))


# Fixed weights of selected features, so that SQL can follow the recursion.
WEIGHTS = {"lag_1": 22.0, "lag_2": -4.0, "lag_24": 9.5, "lag_25": 3.0, "temp": 6.5, "wind": -2.25, "hour_cos": 4.0, "hour_sin": -1.5, "dow_cos": 2.0}
START = -7.0
_TERMS = {**{f"lag_{k}": f"(h[{FORECAST_LAGS + 1 - k}] - va) / vb" for k in range(1, FORECAST_LAGS + 1)}, "temp": "(temp - ta) / tb", "wind": "(wind - wa) / wb",
          "hour_cos": "cos(2.0 * pi() * hour(t) / 24.0)", "hour_sin": "sin(2.0 * pi() * hour(t) / 24.0)", "dow_cos": "cos(2.0 * pi() * (isodow(t) - 1) / 7.0)"}
_MODEL = " + ".join([repr(START), *[f"{w!r} * ({_TERMS[c]})" for c, w in WEIGHTS.items()]])


@query("recursive_weather", f"""
WITH RECURSIVE n AS (SELECT * FROM ({SQL_HISTORY}) h WHERE ts <= TIMESTAMP '{AS_OF}'), wx AS ({SQL_WEATHER}),
st AS (SELECT n.sensor_id, n.pollutant, min(value) AS va, max(value) - min(value) AS vb, min(temp) AS ta, max(temp) - min(temp) AS tb,
              min(wind) AS wa, max(wind) - min(wind) AS wb
       FROM n LEFT JOIN wx ON wx.sensor_id = n.sensor_id AND wx.ts + INTERVAL 1 HOUR = n.ts GROUP BY ALL),
sc AS (SELECT sensor_id, pollutant, va, CASE WHEN vb = 0 THEN 1.0 ELSE vb END AS vb, ta, CASE WHEN tb = 0 THEN 1.0 ELSE tb END AS tb,
              wa, CASE WHEN wb = 0 THEN 1.0 ELSE wb END AS wb FROM st),
q AS (SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY ts DESC) AS back FROM n),
b AS (SELECT sensor_id, pollutant, date_trunc('hour', TIMESTAMP '{AS_OF}') AS t0, list(value ORDER BY ts) AS v FROM q WHERE back <= {FORECAST_LAGS} GROUP BY ALL),
r AS (
  SELECT b.sensor_id, b.pollutant, t0, 0 AS step, list_concat(list_transform(range({FORECAST_LAGS} - len(v)), lambda i: CAST(NULL AS DOUBLE)), v) AS h,
         CAST(0.0 AS DOUBLE) AS p FROM b
  UNION ALL
  SELECT sensor_id, pollutant, t0, step + 1, list_append(h[2:], coalesce(ok, p)), ok
  FROM (SELECT *, CASE WHEN p1 >= 0 THEN p1 END AS ok FROM (
    SELECT y.*, {_MODEL} AS p1 FROM (
      SELECT r.*, t0 + (step + 1) * INTERVAL 1 HOUR AS t, temp, wind FROM r
      LEFT JOIN wx ON wx.sensor_id = r.sensor_id AND wx.ts = t0 + step * INTERVAL 1 HOUR WHERE step < {FORECAST_STEPS}) y
    LEFT JOIN sc ON sc.sensor_id = y.sensor_id AND sc.pollutant = y.pollutant) z) x)
SELECT sensor_id, pollutant, CAST(step AS INTEGER) AS step, t0 + step * INTERVAL 1 HOUR AS ts, round(p, 6) AS value FROM r WHERE step > 1
""")
def recursive_weather(spark, sf_dir):
    """25 steps with 25 lags, the weather of the hour before and stored scaling, by a linear model of selected features.
    Negative steps are null and keep their placeholder in the lags."""
    series, wx = history(spark, sf_dir), cut_lineage(weather(spark, sf_dir))
    st = R.state(series, wx, _stored(spark, sf_dir, series, wx), K, "ts", "value", FORECAST_LAGS, EXO, ["sensor_id"], AS_OF)
    return R.recursive(st, K, "ts", FORECAST_LAGS, R.linear(WEIGHTS, START, FORECAST_LAGS, EXO)).withColumn("value", F.round("value", 6))


@query("recursive_trees")
def recursive_trees(spark, sf_dir):
    """M13 with tree models: each series' own boosted model, trained on its hours up to as_of with the same features and
    scaling, forecasts 25 steps; a series without a model (too short for the lags) has null steps."""
    series, wx = history(spark, sf_dir), cut_lineage(weather(spark, sf_dir))
    stats = _stored(spark, sf_dir, series, wx)
    features = R.names(FORECAST_LAGS, EXO)
    known = R.rows(S.cutoff(series, "ts", AS_OF), wx, stats, K, "ts", "value", FORECAST_LAGS, EXO, ["sensor_id"]).dropna(subset=features + ["value"])
    models = T.fit(known, K, ["ts"], features, "value", {"XGBoost": T.Growth(trees=3, depth=3, rate=0.5, l2=1.0)})
    st = R.state(series, wx, stats, K, "ts", "value", FORECAST_LAGS, EXO, ["sensor_id"], AS_OF)
    return R.recursive(st, K, "ts", FORECAST_LAGS, R.trees(), models)
