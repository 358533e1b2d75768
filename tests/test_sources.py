import json
import os
import tempfile

from pyspark.sql import functions as F

from airlattice.operators import forecast as FC
from airlattice.sources import catalogue, landing, store
from airlattice.streaming import ingest as R


def test_catalogue_scan_and_missing(spark):
    d = tempfile.mkdtemp(prefix="cat-")
    doc = [{"sensorId": "1000", "position": "41.99249998,21.4236110", "status": "ACTIVE", "type": "1"}]
    with open(os.path.join(d, "sensors.json"), "w") as f:
        json.dump(doc, f)
    s = catalogue.read_catalogue(spark, os.path.join(d, "sensors.json"), "sensors")
    assert s.first().sensorId == "1000"
    assert catalogue.read_catalogue(spark, os.path.join(d, "none.json"), "cities").count() == 0


def test_land_weather(spark):
    payload = spark.sql("""SELECT 1 AS sensorId, array(
        named_struct('dt', 1767225600L, 'temp', 1.5, 'weather', array(named_struct('icon', '01d'))),
        named_struct('dt', 1767229200L, 'temp', 2.5, 'weather', array(named_struct('icon', '02d')))) AS hourly""")
    out = landing.land_weather(payload, ["sensorId"])
    assert out.columns == ["sensorId", "time", "temp"] and out.count() == 2


def test_append_new_is_idempotent(spark):
    d = tempfile.mkdtemp(prefix="store-") + "/s"
    df = spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0)], "sensor long, time long, v double")
    store.append_new(spark, df, d, ["sensor", "time"])
    store.append_new(spark, df, d, ["sensor", "time"])
    assert spark.read.parquet(d).count() == 2


def test_publish_replaces_by_key(spark):
    d = tempfile.mkdtemp(prefix="pub-") + "/p"
    a = spark.createDataFrame([("c", 1, 1.0), ("c", 2, 2.0)], "city string, sensor long, v double")
    b = spark.createDataFrame([("c", 2, 20.0)], "city string, sensor long, v double")
    FC.publish(spark, a, d, ["city", "sensor"])
    out = {r.sensor: r.v for r in FC.publish(spark, b, d, ["city", "sensor"]).collect()}
    assert out == {1: 1.0, 2: 20.0}


def test_stream_ingest_replay_appends_nothing(spark):
    base = tempfile.mkdtemp(prefix="stream-")
    rows = spark.createDataFrame([(1, 100, 1.0), (1, 100, 1.0), (2, 200, 2.0)], "user_id long, t long, v double") \
        .withColumn("ts", F.timestamp_seconds("t"))
    rows.write.parquet(base + "/landing")
    for run in range(2):
        q = R.ingest(spark, R.read_landing(spark, base + "/landing", rows.schema), base + "/store",
                     ["user_id", "ts"], base + f"/ckpt{run}")
        q.awaitTermination()
    assert spark.read.parquet(base + "/store").count() == 2
