"""Corner cases the given tables do not hold: repeated keys, null keys, long lists, the date line."""
import datetime as dt
import math
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from airlattice import session
from airlattice.functions.geo import haversine
from airlattice.operators import clean, impute, serve
from airlattice.operators import model as M
from airlattice.operators.nearest import nearest
from airlattice.operators.sweep import p_value
from airlattice.sources import files, landing, store
from airlattice.streaming import ingest as R


def test_lists_of_any_length_are_flattened_whole(spark):
    df = spark.sql("""SELECT array(1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12) AS a,
        array(named_struct('x', array(1, 2)), named_struct('x', array(3, 4, 5)), named_struct('x', array(6))) AS b""")
    out = landing.flatten(df)
    row = out.first().asDict()
    assert [row[f"a_{i}"] for i in range(12)] == list(range(1, 13))
    assert [row[c] for c in ("b_0_x_0", "b_0_x_1", "b_1_x_0", "b_1_x_1", "b_1_x_2", "b_2_x")] == [1, 2, 3, 4, 5, 6]
    assert landing.flatten(df.limit(0)).columns == []


def test_weather_lists_of_six(spark):
    payload = spark.sql("""SELECT 1 AS sensorId, array(named_struct('dt', 1L,
        'wind', array(1, 2, 3, 4, 5, 6))) AS hourly""")
    row = landing.land_weather(payload, ["sensorId"]).first().asDict()
    assert sum(v is not None for k, v in row.items() if k.startswith("wind")) == 6


@pytest.mark.parametrize("values", [[1.0, 9.0], [9.0, 1.0]])
def test_last_ingested_copy_counts_whatever_the_read_order(spark, values):
    rows = [(1, 100, v, 5) for v in values] + [(1, 200, 4.0, 1), (1, 200, 3.0, 2)]
    raw = spark.createDataFrame(rows, "s long, time long, pm2_5 double, n int").coalesce(1)
    out = {r["time"]: r["pm2_5"] for r in clean.process(raw, None, ["s"], "time", "weather", "n").collect()}
    assert out == {100: 9.0, 200: 3.0}       # equal order: the larger value; else the later copy


def test_replay_with_null_keys_and_copies_appends_nothing(spark):
    path = tempfile.mkdtemp() + "/store"
    new = spark.createDataFrame([(1, None, 1.0, 1), (1, None, 2.0, 2), (1, 5, 3.0, 1)], "s long, time long, v double, n int")
    for _ in range(3):
        store.append_new(spark, new, path, ["s", "time"], order="n")
    assert sorted((r.time or 0, r.v) for r in spark.read.parquet(path).collect()) == [(0, 2.0), (5, 3.0)]


def test_append_reads_only_the_partitions_of_the_batch(spark):
    path = tempfile.mkdtemp() + "/store"
    rows = [(1, d, f"2024-01-{d:02d}") for d in range(1, 11)]
    store.append_new(spark, spark.createDataFrame(rows, "s long, t long, day string"), path, ["s", "t", "day"], ["day"])
    batch = spark.createDataFrame([(1, 3, "2024-01-03"), (2, 3, "2024-01-03"), (2, 99, "2024-02-01")], "s long, t long, day string")
    known = store.same_partitions(spark.read.parquet(path), batch, ["day"])
    assert {str(r.day) for r in known.collect()} == {"2024-01-03"}
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "2024-01-03" in plan.split("PartitionFilters: [")[1].split("]")[0]
    store.append_new(spark, batch, path, ["s", "t", "day"], ["day"])
    assert spark.read.parquet(path).count() == 12


@pytest.mark.parametrize("mode", ["replace", "merge"])
def test_upsert_takes_the_newest_of_repeated_keys(spark, mode):
    stored = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k long, v string, n int")
    new = spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "x", 1), (None, "y", 1), (None, "z", 2)], "k long, v string, n int")
    out = store.upsert(stored, new, ["k"], mode, order="n").collect()
    assert sorted((r.k or 0, r.v) for r in out) == [(0, "z"), (1, "a"), (2, "new"), (3, "x")]


def test_delete_matches_null_keys(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k long, v string")
    doomed = spark.createDataFrame([(None,), (2,), (2,)], "k long")
    assert [r.v for r in store.delete(df, doomed, ["k"]).collect()] == ["a"]


def test_text_target_takes_the_mode_of_its_neighbours(spark):
    rows = [(i, float(i // 10 * 100 + i % 10), "low" if i < 10 else "high") for i in range(20)]
    rows[4], rows[15] = (4, 4.0, None), (15, 105.0, None)
    df = spark.createDataFrame(rows, "id long, x double, t string")
    out = impute.knn(df, "id", "t", ["x"], 3, how="mode")
    assert out.schema["t"].dataType.typeName() == "string"
    assert {r.id: r.t for r in out.filter("id IN (4, 15)").collect()} == {4: "low", 15: "high"}
    with pytest.raises(ValueError):
        impute.knn(df, "id", "t", ["x"], 3, how="mean")


def test_nearest_across_the_date_line_and_at_the_poles(spark):
    rng = random.Random(4)
    spots = [(i, lat, lon) for i, (lat, lon) in enumerate(
        [(0.0, 179.995), (0.0, -179.995), (10.0, 180.0), (10.0, -180.0), (89.999, 10.0), (89.999, -170.0), (-89.9995, 0.0),
         (-89.9995, 120.0), (65.0, 179.99), (65.0, -179.99)] + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)])]
    points = [(1000 + i, max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), lon + rng.uniform(-0.02, 0.02)) for i, lat, lon in spots]
    points += [(2000, 0.0, -179.996), (2001, 89.9999, 100.0), (2002, 0.0, 359.99 - 180.0)]
    p = spark.createDataFrame(points, "p long, lat double, lon double")
    q = spark.createDataFrame(spots, "q long, lat double, lon double")
    got = {r.p: r.q for r in nearest(p, q, "p", "q", radius_km=2.0).collect()}

    def km(a, b):
        x, y = math.radians(a[1]), math.radians(b[1])
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))
    for point in points:
        near = sorted((round(km(point, s), 9), s[0]) for s in spots if km(point, s) <= 2.0)
        assert got[point[0]] == (near[0][1] if near else None), point
    assert got[2000] is not None and got[2001] is not None


def test_reading_files_keep_the_last_row_of_a_reading(spark):
    path = tempfile.mkdtemp()
    for n, (name, v) in enumerate([("b.csv", 1), ("a.csv", 2)]):
        with open(f"{path}/{name}", "w") as f:
            f.write(f"s,time,v\n7,100,{v}\n7,100,{v + 10}\n7,200,{v}\n")
        os.utime(f"{path}/{name}", (1_700_000_000 + n * 60,) * 2)
    out = files.read_readings(spark, path, "s long, time long, v long", keys=["s"])
    assert sorted((r.time, r.v) for r in out.collect()) == [(100, 12), (200, 2)]


def test_streaming_ingest_keeps_the_last_copy(spark):
    root = tempfile.mkdtemp()
    schema = "s long, t long, day string, v long, n long"
    spark.createDataFrame([(1, 1, "d1", 10, 1), (1, 1, "d1", 20, 2), (1, 2, "d1", 5, 1)], schema).write.parquet(f"{root}/in")
    q = R.ingest(spark, R.read_landing(spark, f"{root}/in", schema), f"{root}/out", ["s", "t", "day"], f"{root}/ckpt", ["day"], order="n")
    q.awaitTermination()
    assert sorted((r.t, r.v) for r in spark.read.parquet(f"{root}/out").collect()) == [(1, 20), (2, 5)]


def test_stream_dedup_over_several_batches(spark):
    """Rows far out of time order, a file per batch: a delay that covers the input keeps each once;
    a short one loses the late ones."""
    kept = {}
    for delay in ("30 days", "2 hours"):
        root = tempfile.mkdtemp()
        for i, day in enumerate([9, 1, 5, 9, 3, 1]):
            ts = dt.datetime(2024, 1, day)
            spark.createDataFrame([(1, ts, day)], "s long, ts timestamp, v long").coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = R.read_landing(spark, f"{root}/in", "s long, ts timestamp, v long", max_files=1)
        R.sink_parquet(R.dedup(stream, ["s"], "ts", delay), f"{root}/out", f"{root}/ckpt").awaitTermination()
        kept[delay] = sorted(r.v for r in spark.read.parquet(f"{root}/out").collect())
    assert kept["30 days"] == [1, 3, 5, 9]
    assert set(kept["2 hours"]) < {1, 3, 5, 9}


def test_stream_keeps_the_last_over_batches_and_a_restart(spark):
    """A file per batch, out of order, the stream started again from its checkpoint; equal to the batch operator."""
    root = tempfile.mkdtemp()
    rnd = random.Random(3)
    rows = [(rnd.randrange(3), dt.datetime(2024, 1, 1 + rnd.randrange(3)), rnd.randrange(9), rnd.random()) for _ in range(60)]
    schema = "s long, ts timestamp, n long, v double"
    for start in (0, 30):
        for i in range(start, start + 30, 6):
            spark.createDataFrame(rows[i:i + 6], schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = R.read_landing(spark, f"{root}/in", schema, max_files=1)
        R.sink_changes(R.keep_last(stream, ["s"], "ts", ["n"], "30 days"), f"{root}/out", f"{root}/ckpt").awaitTermination()
    want = clean.dedup_keep_last(spark.createDataFrame(rows, schema), ["s", "ts"], ["n", "v"])
    got = R.read_last(spark, f"{root}/out", ["s", "ts"], ["n"])
    assert sorted(map(tuple, got.select("s", "ts", "n", "v").collect())) == sorted(map(tuple, want.select("s", "ts", "n", "v").collect()))


def test_stream_gives_each_key_once_behind_the_watermark(spark):
    root = tempfile.mkdtemp()
    schema = "s long, ts timestamp, n long"
    for i, (day, n) in enumerate([(1, 1), (1, 3), (1, 2), (9, 1), (20, 1), (1, 99)]):
        spark.createDataFrame([(7, dt.datetime(2024, 1, day), n)], schema).coalesce(1).write.parquet(f"{root}/in/b={i}")
    stream = R.read_landing(spark, f"{root}/in/*", schema, max_files=1)
    R.sink_parquet(R.keep_last(stream, ["s"], "ts", ["n"], "2 days"), f"{root}/out", f"{root}/ckpt").awaitTermination()
    got = sorted((r.ts.day, r.n) for r in spark.read.parquet(f"{root}/out").collect())
    # 20 is still open and the copy that came after its day had gone is late
    assert got == [(1, 3), (9, 1)]


def _fitted(spark, history, lags, family="Linear"):
    from pyspark.ml.feature import VectorAssembler
    frame, cols = M.feature_frame(history, ["s"], "ts", "v", lags)
    return M.make(family).fit(VectorAssembler(inputCols=cols, outputCol="features").transform(frame))


@pytest.mark.parametrize("family", ["Linear", "DecisionTree"])
def test_short_series_stay_with_null_steps(spark, family):
    rows = [("long", i, float(20 + i % 24)) for i in range(80)] + [("short", i, 5.0) for i in range(2)]
    history = spark.createDataFrame(rows, "s string, h long, v double") \
        .select("s", F.timestamp_seconds(F.col("h") * 3600 + 1_704_067_200).alias("ts"), "v")
    model = _fitted(spark, history, 25 if family == "Linear" else 3, family)
    lags = 25 if family == "Linear" else 3
    out = M.recursive_forecast(spark, history, model, ["s"], "ts", "v", lags).collect()
    assert {s: sum(r.s == s for r in out) for s in ("long", "short")} == {"long": 24, "short": 24}
    assert all((r.value is None) == (r.s == "short") for r in out)


def test_forecast_starts_at_as_of(spark):
    rows = [("a", i, float(i % 24)) for i in range(60)] + [("stale", i, float(i % 24)) for i in range(30)]
    history = spark.createDataFrame(rows, "s string, h long, v double") \
        .select("s", F.timestamp_seconds(F.col("h") * 3600 + 1_704_067_200).alias("ts"), "v")
    out = M.recursive_forecast(spark, history, _fitted(spark, history, 3), ["s"], "ts", "v", 3, as_of="2024-01-03 05:20:00").collect()
    assert {min(r.ts for r in out if r.s == s) for s in ("a", "stale")} == {dt.datetime(2024, 1, 3, 7)}


def test_history_bounds_reach_the_scan(spark):
    path = tempfile.mkdtemp() + "/r"
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("ts"), "id").write.parquet(path)
    out = serve.history(spark.read.parquet(path), 3600 * 10, 3600 * 20)
    assert out.count() == 11
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in out._jdf.queryExecution().executedPlan().toString()


def test_incomplete_beta_against_integration(spark):
    """A p-value is the regularised incomplete beta of (dof / 2, 1 / 2) at dof / (dof + t^2)."""
    cases = {(a, x): math.sqrt(2 * a * (1 - x) / x) for a in (0.5, 2.0, 15.0) for x in (0.05, 0.3, 0.8, 0.99)}
    df = spark.createDataFrame([(a, x, 2 * a, t) for (a, x), t in cases.items()], "a double, x double, dof double, t double")
    n, b = 200_000, 0.5
    for r in df.select("a", "x", F.expr(p_value("t", "dof")).alias("p")).collect():
        # substitution t = x u^2 takes the singularity at 0 away
        total = sum(2 * r.x * u * (r.x * u * u) ** (r.a - 1) * (1 - r.x * u * u) ** (b - 1) for u in ((i + 0.5) / n for i in range(n))) / n
        want = total / math.exp(math.lgamma(r.a) + math.lgamma(b) - math.lgamma(r.a + b))
        assert r.p == pytest.approx(want, abs=2e-5)


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
