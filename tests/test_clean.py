from pyspark.sql import functions as F

from airlattice.functions.timefeat import hour_round
from airlattice.operators import clean
from airlattice.sources import landing


def test_flatten_nested_records(spark):
    df = spark.createDataFrame([(1, (2,))], "a int, b struct<c:int>")
    assert landing.flatten(df).columns == ["a", "b_c"]
    df = spark.sql("SELECT array(named_struct('x', 1)) AS a")
    assert landing.flatten(df).columns == ["a_x"]
    df = spark.sql("SELECT array(1, 2) AS a")
    out = landing.flatten(df)
    assert out.columns == ["a_0", "a_1"] and tuple(out.first()) == (1, 2)
    df = spark.sql("SELECT 1 AS a, 2 AS secret")
    assert landing.flatten(df, exclude=("secret",)).columns == ["a"]


def test_rename_and_drop(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 5.0)], "dt long, temperature double, CO double, "
                               "PM25 double, unknown double")
    assert clean.rename(df).columns == ["time", "temp", "co", "pm2_5", "unknown"]
    df = spark.createDataFrame([(1, "i", "rain", 1.0, 2.0, 3.0)], "time long, `weather.icon` string, "
                               "precipType string, co2 double, temp double, pm2_5 double")
    assert clean.drop_unneeded(df).columns == ["time", "temp", "pm2_5"]


def test_new_rows_anti_join(spark):
    new = spark.createDataFrame([(1, 10, 1), (2, 20, 2), (3, 30, 3)], "time long, v long, w long")
    old = spark.createDataFrame([(1, 10), (2, 20)], "time long, v long")
    out = clean.new_rows(new, old, ["time"])
    assert out.columns == ["time", "v"] and [tuple(r) for r in out.collect()] == [(3, 30)]


def test_new_rows_null_keys_match(spark):
    new = spark.createDataFrame([(None, 1), (5, 2)], "time long, v long")
    old = spark.createDataFrame([(None, 9)], "time long, v long")
    assert [r.time for r in clean.new_rows(new, old, ["time"]).collect()] == [5]


def test_dedup_keep_last(spark):
    df = spark.createDataFrame([(3, 30.0, 0), (1, 10.0, 1), (2, 20.0, 2), (2, 25.0, 3)],
                               "time long, v double, seq long")
    out = clean.dedup_keep_last(df, ["time"], "seq").orderBy("time")
    assert [(r.time, r.v) for r in out.collect()] == [(1, 10.0), (2, 25.0), (3, 30.0)]


def test_drop_null_columns_and_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, 1.0, None), (3, None, None)], "t long, a double, b double")
    out = clean.drop_null_columns(df, keep=["t"])
    assert out.columns == ["t", "a"]
    assert clean.drop_null_rows(out, ["a"]).count() == 1


def test_hour_rounding(spark):
    df = spark.createDataFrame([("2024-01-01 10:20:00",), ("2024-01-01 10:29:00",), ("2024-01-01 10:30:00",),
                                ("2024-01-01 10:45:00",), ("2024-01-01 23:30:00",)], "s string")
    out = df.select(hour_round(F.to_timestamp("s"), "closest").alias("h")).collect()
    assert [str(r.h) for r in out] == ["2024-01-01 10:00:00", "2024-01-01 10:00:00", "2024-01-01 11:00:00",
                                       "2024-01-01 11:00:00", "2024-01-02 00:00:00"]


def test_fill_mean_and_mask_constant(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 5.0), (1, 2, None, 5.0), (1, 3, 3.0, 5.0), (2, 1, None, 1.0)],
                               "s long, t long, a double, b double")
    out = clean.mask_constant(clean.fill_mean(df, ["s"], ["a"]), ["s"], ["b"]).orderBy("s", "t").collect()
    assert [r.a for r in out] == [1.0, 2.0, 3.0, None]
    assert [r.b for r in out] == [None, None, None, 1.0]  # std 0 in series 1; one row (std null) kept


def test_merge_snapshots_second_wins(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "time long, v double")
    b = spark.createDataFrame([(2, 20.0), (3, 30.0)], "time long, v double")
    out = clean.merge_snapshots(a, b, ["time"]).orderBy("time").collect()
    assert [(r.time, r.v) for r in out] == [(1, 1.0), (2, 20.0), (3, 30.0)]


def test_process_outcomes(spark):
    raw = spark.createDataFrame([(1, 100, 5.0), (1, 200, 6.0), (2, 100, 7.0)], "sensorId long, time long, pm2_5 double")
    processed = spark.createDataFrame([(2, 100, 7.0, 29)], "sensorId long, time long, pm2_5 double, aqi int")
    new = clean.process(raw.withColumn("ingested", F.lit(1)), processed, ["sensorId"], "time", "pollution", "ingested")
    assert sorted((r.sensorId, r.time) for r in new.collect()) == [(1, 100), (1, 200)]
    out = {r.sensorId: r.outcome for r in clean.outcomes(raw, new, ["sensorId"], "process").collect()}
    assert out == {1: "done", 2: "skipped"}
