"""Store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from airlattice.plans import views as V
from airlattice.plans.registry import query
from airlattice.sources import store

_NEW_SQL = f"""
n AS (
  SELECT c_custkey AS sensor_id, c_nationkey AS city_key, 'INACTIVE' AS status,
         CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lon
  FROM customer WHERE c_acctbal > 9000
  UNION ALL
  SELECT s_suppkey + 1000000, s_nationkey, 'ACTIVE', p.lat, p.lon
  FROM supplier JOIN ({V.SQL_POINTS}) p ON p.point_id = s_suppkey)
"""


def _stored_new(spark, sf_dir):
    stored = V.sensors(spark, sf_dir)
    c = V.table(spark, sf_dir, "customer").filter("c_acctbal > 9000")
    upd = c.select(F.col("c_custkey").alias("sensor_id"), F.col("c_nationkey").alias("city_key"),
                   F.lit("INACTIVE").alias("status"), F.lit(None).cast("double").alias("lat"),
                   F.lit(None).cast("double").alias("lon"))
    s = V.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    p = V.points(spark, sf_dir)
    ins = s.join(p, s.s_suppkey == p.point_id).select(
        (F.col("s_suppkey") + 1000000).alias("sensor_id"), F.col("s_nationkey").alias("city_key"),
        F.lit("ACTIVE").alias("status"), "lat", "lon")
    return stored, upd.unionByName(ins)


@query("upsert_replace", f"""
WITH s AS ({V.SQL_SENSORS}), {_NEW_SQL}
SELECT * FROM n
UNION ALL
SELECT * FROM s WHERE sensor_id NOT IN (SELECT sensor_id FROM n)
""")
def upsert_replace(spark, sf_dir):
    stored, new = _stored_new(spark, sf_dir)
    return store.upsert(stored, new, ["sensor_id"], mode="replace")


@query("upsert_merge", f"""
WITH s AS ({V.SQL_SENSORS}), {_NEW_SQL}
SELECT coalesce(n.sensor_id, s.sensor_id) AS sensor_id, coalesce(n.city_key, s.city_key) AS city_key,
       coalesce(n.status, s.status) AS status, coalesce(n.lat, s.lat) AS lat, coalesce(n.lon, s.lon) AS lon
FROM s FULL OUTER JOIN n ON s.sensor_id = n.sensor_id
""")
def upsert_merge(spark, sf_dir):
    stored, new = _stored_new(spark, sf_dir)
    return store.upsert(stored, new, ["sensor_id"], mode="merge")


@query("lookup_filter", f"""
SELECT sensor_id, city_key, status, lon FROM ({V.SQL_SENSORS}) s WHERE status = 'ACTIVE' AND city_key = 7
""")
def lookup_filter(spark, sf_dir):
    return store.find(V.sensors(spark, sf_dir), {"status": "ACTIVE", "city_key": 7}, exclude=("lat",))


@query("delete_keys", f"""
SELECT * FROM ({V.SQL_SENSORS}) s WHERE status <> 'INACTIVE'
""")
def delete_keys(spark, sf_dir):
    sensors = V.sensors(spark, sf_dir)
    doomed = sensors.filter("status = 'INACTIVE'")
    return store.delete(sensors, doomed, ["sensor_id"])
