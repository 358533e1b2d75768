"""Evaluation queries.

Holdout view (fixed): lineitem rows are holdout predictions of a series
(sensor = l_suppkey, pollutant = l_linestatus) by a model (= l_returnflag): actual =
l_extendedprice (0 where l_tax = 0 and l_discount = 0.10), predicted =
l_quantity * p_retailprice * (1 - l_discount) (+inf where l_discount = 0 and
l_tax = 0.08).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.constants import POLLUTANTS
from airlattice.operators import evaluate as E
from airlattice.plans import views as V
from airlattice.plans.registry import query

K = ["sensor_id", "pollutant"]

SQL_HOLDOUT = """
SELECT l_suppkey AS sensor_id, l_linestatus AS pollutant, l_returnflag AS model, l_shipdate AS ts,
  CASE WHEN l_tax = 0 AND l_discount = 0.1 THEN 0.0::DOUBLE ELSE l_extendedprice END AS actual,
  CASE WHEN l_discount = 0 AND l_tax = 0.08 THEN 'inf'::DOUBLE ELSE l_quantity * p_retailprice * (1 - l_discount) END AS predicted
FROM lineitem JOIN part ON l_partkey = p_partkey
"""


def holdout(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    p = V.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_suppkey").alias("sensor_id"), F.col("l_linestatus").alias("pollutant"),
        F.col("l_returnflag").alias("model"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.when((F.col("l_tax") == 0) & (F.col("l_discount") == 0.1), F.lit(0.0))
         .otherwise(F.col("l_extendedprice")).alias("actual"),
        F.when((F.col("l_discount") == 0) & (F.col("l_tax") == 0.08), F.lit(float("inf")))
         .otherwise(F.col("l_quantity") * F.col("p_retailprice") * (1 - F.col("l_discount"))).alias("predicted"))


def rounded_errors(spark, sf_dir):
    e = E.metrics(holdout(spark, sf_dir), K + ["model"])
    return e.select(*K, "model", F.round("mae", 6).alias("mae"), F.round("mape", 6).alias("mape"),
                    F.round("mse", 2).alias("mse"), F.round("rmse", 6).alias("rmse"))


SQL_ERRORS = f"""
h AS ({SQL_HOLDOUT}),
v AS (SELECT * FROM h WHERE actual IS NOT NULL AND predicted IS NOT NULL AND isfinite(actual) AND isfinite(predicted)),
e0 AS (SELECT sensor_id, pollutant, model, avg(abs(actual - predicted)) AS mae,
  CASE WHEN max(CASE WHEN actual = 0 THEN 1 ELSE 0 END) = 1 THEN NULL
       ELSE avg(abs((actual - predicted) / CASE WHEN actual <> 0 THEN actual END)) * 100 END AS mape,
  avg((actual - predicted) * (actual - predicted)) AS mse
  FROM v GROUP BY sensor_id, pollutant, model),
e AS (SELECT sensor_id, pollutant, model, round(mae, 6) AS mae, round(mape, 6) AS mape, round(mse, 2) AS mse,
             round(sqrt(mse), 6) AS rmse FROM e0)
"""

SQL_BEST = """
b AS (SELECT sensor_id, pollutant, model FROM (
  SELECT *, row_number() OVER (PARTITION BY sensor_id, pollutant ORDER BY mae, model) AS rn
  FROM e WHERE mae IS NOT NULL) t WHERE rn = 1)
"""


@query("valid_pairs", f"""
WITH h AS ({SQL_HOLDOUT})
SELECT * FROM h WHERE actual IS NOT NULL AND predicted IS NOT NULL AND isfinite(actual) AND isfinite(predicted)
""")
def valid_pairs(spark, sf_dir):
    return E.valid(holdout(spark, sf_dir))


@query("error_metrics", f"WITH {SQL_ERRORS} SELECT * FROM e")
def error_metrics(spark, sf_dir):
    return rounded_errors(spark, sf_dir)


@query("best_model", f"WITH {SQL_ERRORS}, {SQL_BEST} SELECT * FROM b")
def best_model(spark, sf_dir):
    return E.best(rounded_errors(spark, sf_dir), K)


@query("best_model_series", f"""
WITH {SQL_ERRORS}, {SQL_BEST}
SELECT h.sensor_id, h.pollutant, h.model, h.ts, h.actual, h.predicted FROM h
JOIN b ON h.sensor_id = b.sensor_id AND h.pollutant = b.pollutant AND h.model = b.model
""")
def best_model_series(spark, sf_dir):
    return E.best_series_rows(holdout(spark, sf_dir), K, digits=6)


@query("error_leaderboard", f"""
WITH {SQL_ERRORS},
l AS (SELECT sensor_id, pollutant, model, metric, value FROM e
      UNPIVOT (value FOR metric IN (mae, mape, mse, rmse))),
l2 AS (SELECT * FROM l WHERE value IS NOT NULL AND NOT isnan(value))
SELECT sensor_id, pollutant, metric, model, value,
  CAST(row_number() OVER (PARTITION BY sensor_id, pollutant, metric ORDER BY value DESC, model) AS INTEGER) AS rank,
  max(value) OVER (PARTITION BY sensor_id, pollutant, metric) + 10
    - max(value) OVER (PARTITION BY sensor_id, pollutant, metric) % 10 AS axis_limit,
  round(value, 1) AS label
FROM l2
""")
def error_leaderboard(spark, sf_dir):
    return E.leaderboard(rounded_errors(spark, sf_dir), K)


@query("evaluation_report", f"""
WITH {SQL_ERRORS}, {SQL_BEST}
SELECT e.sensor_id, e.pollutant, e.model, e.mae, CASE WHEN isnan(e.mape) THEN NULL ELSE e.mape END AS mape, e.mse, e.rmse
FROM e JOIN b ON e.sensor_id = b.sensor_id AND e.pollutant = b.pollutant AND e.model = b.model
""")
def evaluation_report(spark, sf_dir):
    rep = E.best_error_rows(rounded_errors(spark, sf_dir), K)
    return rep.withColumn("mape", E.nan_to_null("mape")).select(*K, "model", "mae", "mape", "mse", "rmse")


# Registry view: orders are trained models (sensor = o_custkey, pollutant by priority).
PRIORITY_POLLUTANT = {"1-URGENT": "pm2_5", "2-HIGH": "pm10", "3-MEDIUM": "no2", "4-NOT SPECIFIED": "o3",
                      "5-LOW": "so2"}
WORK_AS_OF = 986083200  # 2001-04-01 00:00:00 UTC
_PRIO_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PRIORITY_POLLUTANT.items()) + " END"


@query("retrain_worklist", f"""
WITH s AS (SELECT sensor_id FROM ({V.SQL_SENSORS}) x WHERE status = 'ACTIVE'),
p AS (SELECT * FROM (VALUES {", ".join(f"('{p}')" for p in POLLUTANTS)}) t(pollutant)),
w AS (SELECT s.sensor_id, p.pollutant FROM s, p),
r AS (SELECT o_custkey AS sensor_id, {_PRIO_SQL} AS pollutant, max(o_orderdate) AS t FROM orders GROUP BY 1, 2),
d AS (SELECT DISTINCT sensor_id, pollutant FROM ({V.SQL_SERIES_LONG}) x)
SELECT w.sensor_id, w.pollutant, r.t AS trained_at,
  CASE WHEN r.t IS NOT NULL AND {WORK_AS_OF} - epoch(r.t) < 7889400 THEN 'fresh'
       WHEN d.sensor_id IS NULL THEN 'no_data' ELSE 'train' END AS status
FROM w LEFT JOIN r ON w.sensor_id = r.sensor_id AND w.pollutant = r.pollutant
LEFT JOIN d ON w.sensor_id = d.sensor_id AND w.pollutant = d.pollutant
""")
def retrain_worklist(spark, sf_dir):
    units = V.sensors(spark, sf_dir).filter("status = 'ACTIVE'").select("sensor_id")
    o = V.table(spark, sf_dir, "orders")
    prio = None
    for k, v in PRIORITY_POLLUTANT.items():
        prio = F.when(F.col("o_orderpriority") == k, v) if prio is None else prio.when(F.col("o_orderpriority") == k, v)
    registry = o.select(F.col("o_custkey").alias("sensor_id"), prio.alias("pollutant"),
                        F.col("o_orderdate").cast("timestamp").alias("trained_at"))
    data = V.series_long(spark, sf_dir)
    return E.worklist(units, list(POLLUTANTS), registry, data, ["sensor_id"], WORK_AS_OF)


@query("run_tally", """
WITH o AS (SELECT o_orderpriority AS job, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'skipped'
                  WHEN 'P' THEN 'failed' END AS outcome FROM orders),
a AS (SELECT job, count(*) AS total, count(*) FILTER (WHERE outcome = 'done') AS done,
             count(*) FILTER (WHERE outcome = 'failed') AS failed,
             count(*) FILTER (WHERE outcome = 'skipped') AS skipped FROM o GROUP BY job)
SELECT *, CASE WHEN failed = 0 THEN 'info' WHEN failed = total THEN 'error' ELSE 'warning' END AS severity,
  job || ': ' || CAST(total AS VARCHAR) || ' ' || CASE WHEN total = 1 THEN 'sensor' ELSE 'sensors' END || ' -- '
  || CAST(done AS VARCHAR) || ' done, ' || CAST(failed AS VARCHAR) || ' failed'
  || CASE WHEN skipped > 0 THEN ', ' || CAST(skipped AS VARCHAR) || ' skipped' ELSE '' END
  || CASE WHEN failed = total THEN ' (every sensor failed)' ELSE '' END AS summary
FROM a
""")
def run_tally(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("job"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "skipped")
         .when(F.col("o_orderstatus") == "P", "failed").alias("outcome"))
    return E.tally(o, ["job"], unit="sensor")
