import math

import pytest

from airlattice.operators import evaluate as E
from airlattice.operators import serve
from airlattice.sources import store


def test_valid_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (float("inf"), 3.0), (4.0, float("nan"))],
                               "actual double, predicted double")
    assert [tuple(r) for r in E.valid(df).collect()] == [(1.0, 1.0), (2.0, 2.0)]


def test_metrics(spark):
    df = spark.createDataFrame([("m", 100.0, 110.0), ("m", 200.0, 180.0), ("z", 0.0, 5.0)],
                               "model string, actual double, predicted double")
    r = {x.model: x for x in E.metrics(df, ["model"]).collect()}
    assert r["m"].mape == pytest.approx(10.0)
    assert r["m"].mae == pytest.approx(15.0) and r["m"].rmse == pytest.approx(math.sqrt(250.0))
    assert r["z"].mape is None


def test_best_model_first_wins_ties(spark):
    df = spark.createDataFrame([("k", "b", 1.0, 2), ("k", "a", 1.0, 1), ("k", "c", 3.0, 0)],
                               "key string, model string, mae double, ord int")
    assert E.best(df, ["key"], order="ord").first().model == "a"


@pytest.mark.parametrize("outcomes,severity", [
    (["done", "done"], "info"), (["done", "skipped"], "info"),
    (["done", "failed"], "warning"), (["failed", "failed"], "error")])
def test_tally(spark, outcomes, severity):
    df = spark.createDataFrame([("job", o) for o in outcomes], "job string, outcome string")
    r = E.tally(df, ["job"], unit="city", plural="cities").first()
    assert r.severity == severity and r.summary.startswith("job: 2 cities -- ")


def test_enabled_codes():
    assert serve.enabled_codes("mk, rs ,bg") == ["BG", "MK", "RS"]
    assert len(serve.enabled_codes(None)) == 15


def test_upsert_replace_and_merge(spark):
    stored = spark.createDataFrame([("1", "ACTIVE", "x")], "sensorId string, status string, note string")
    new = spark.createDataFrame([("1", "INACTIVE", None), ("2", "ACTIVE", "n")], "sensorId string, status string, note string")
    rep = {r.sensorId: r for r in store.upsert(stored, new, ["sensorId"], "replace").collect()}
    assert rep["1"].status == "INACTIVE" and rep["1"].note is None and len(rep) == 2
    mer = {r.sensorId: r for r in store.upsert(stored, new, ["sensorId"], "merge").collect()}
    assert mer["1"].status == "INACTIVE" and mer["1"].note == "x"


def test_find_and_delete(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, v int")
    assert store.find(df, {"k": "a"}, exclude=("k",)).columns == ["v"]
    assert store.find(df, {"k": "a"}, one=True, order=["v"]).first().v == 1
    doomed = spark.createDataFrame([("a",)], "k string")
    assert store.delete(df, doomed, ["k"]).count() == 1


def test_history_window(spark):
    df = spark.createDataFrame([(1704067200,), (1704063600 - 1,), (1704070801,)], "t long") \
        .selectExpr("timestamp_seconds(t) AS ts")
    out = serve.history(df, 1704067200 - 3600, 1704067200 + 3600)
    assert out.count() == 1
    with pytest.raises(ValueError):
        serve.history(df, 10, 5)
    with pytest.raises(ValueError):
        serve.history(df, 0, 604801)
