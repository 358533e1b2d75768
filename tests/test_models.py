import math
import random

import numpy as np
from pyspark.sql import functions as F

from airlattice.operators import model as M
from airlattice.operators import select as SEL
from airlattice.operators.sweep import p_value


def test_t_pvalue(spark):
    p = spark.createDataFrame([(2.0, 10.0), (0.0, 5.0)], "t double, dof double").select(F.expr(p_value("t", "dof")).alias("p"))
    two, zero = [r.p for r in p.collect()]
    assert abs(two - 0.0733880347707) < 1e-9
    assert abs(zero - 1.0) < 1e-12


def test_backward_elimination_keeps_signal(spark):
    rng = np.random.default_rng(1)
    n = 300
    signal, noise = rng.normal(size=n), rng.normal(size=n)
    y = 2 * signal + 0.01 * rng.normal(size=n)
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(signal, noise, y)],
                               "k int, signal double, noise double, y double")
    r = SEL.select_features(df, ["k"], ["signal", "noise"], "y").first()
    assert r.selected == ["signal"]


def _sine(spark, n=400):
    rnd = random.Random(0)
    rows = [(1, "pm2_5", i, 20 + 5 * math.sin(2 * math.pi * i / 24) + rnd.gauss(0, 0.2)) for i in range(n)]
    return spark.createDataFrame(rows, "sensor_id int, pollutant string, i int, value double") \
        .withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("i") * 3600)).drop("i")


def test_recursive_forecast_sine(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    series = _sine(spark)
    frame, cols = M.feature_frame(series, ["sensor_id", "pollutant"], "ts", "value", 3)
    fitted = LinearRegression(featuresCol="features", labelCol="label").fit(
        VectorAssembler(inputCols=cols, outputCol="features").transform(frame))
    out = M.recursive_forecast(spark, series, fitted, ["sensor_id", "pollutant"], "ts", "value", 3).orderBy("ts").collect()
    assert len(out) == 24
    gaps = {(b.ts - a.ts).total_seconds() for a, b in zip(out, out[1:])}
    assert gaps == {3600.0} and all(r.value > 0 for r in out)


def test_train_best_marks_a_best_model(spark):
    series = _sine(spark, 200)
    frame, cols = M.feature_frame(series, ["sensor_id", "pollutant"], "ts", "value", 3)
    res = M.train_best(frame, cols, ["sensor_id", "pollutant"], "ts", ["Linear", "DecisionTree"], draws=1, folds=2)
    rows = res.errors.collect()
    assert len(rows) == 2 and sum(r.is_best for r in rows) == 1
    assert res.best in ("Linear", "DecisionTree")


def test_direct_forecast_matches_least_squares(spark):
    import pandas as pd
    series = _sine(spark, 120)
    out = M.direct_forecast(series, ["sensor_id", "pollutant"], "ts", "value", 2, steps=3).orderBy("step").collect()
    assert [r.step for r in out] == [1, 2, 3]
    pdf = series.orderBy("ts").toPandas()
    v = pdf["value"].to_numpy()
    ts = pd.to_datetime(pdf["ts"])
    hour, dow = ts.dt.hour.to_numpy(), ts.dt.dayofweek.to_numpy()
    X = np.column_stack([np.ones(len(v)), np.roll(v, 1), np.roll(v, 2),
                         np.cos(2 * np.pi * hour / 24), np.sin(2 * np.pi * hour / 24),
                         np.cos(2 * np.pi * dow / 7), np.sin(2 * np.pi * dow / 7)])
    for h in (1, 2, 3):
        rows = np.arange(2, len(v) - h)
        beta = np.linalg.lstsq(X[rows], v[rows + h], rcond=None)[0]
        assert abs(out[h - 1].value - X[-1] @ beta) < 1e-6


def test_direct_sums_equal_those_of_every_horizon(spark):
    """Series of many lengths, some shorter than the lags or the horizon, null values, partitions."""
    from airlattice.operators import direct
    rng = np.random.default_rng(2)
    rows = [(s, i, None if (s + i) % 13 == 0 else float(np.round(rng.normal() + s, 4))) for s, n in enumerate([1, 3, 5, 6, 9, 40]) for i in range(n)]
    series = spark.createDataFrame(rows, "s int, i int, v double").withColumn("ts", F.timestamp_seconds(F.col("i") * 3600)).repartition(4)
    gram, cross = direct.sums(direct.frame(series, ["s"], "ts", "v", 3, 5), 3, 5)
    want_g, want_c = np.zeros((5, 8, 8)), np.zeros((5, 8))
    for s in range(6):
        own = [(i, v) for k, i, v in rows if k == s and v is not None]
        for at in range(3, len(own)):
            hour, day = own[at][0] % 24, (own[at][0] // 24 + 3) % 7
            x = np.array([1.0, *[own[at - k][1] for k in (1, 2, 3)], *[f(2 * math.pi * p / m) for p, m in ((hour, 24), (day, 7)) for f in (math.cos, math.sin)]])
            for h in range(1, 6):
                if at + h < len(own):
                    want_g[h - 1] += np.outer(x, x)
                    want_c[h - 1] += x * own[at + h][1]
    assert np.allclose(gram, want_g, atol=1e-9) and np.allclose(cross, want_c, atol=1e-9)
    assert direct.direct_forecast(series.limit(0), ["s"], "ts", "v", 3, 5).count() == 0


def test_register_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    series = _sine(spark, 100)
    frame, cols = M.feature_frame(series, ["sensor_id", "pollutant"], "ts", "value", 2)
    asm = VectorAssembler(inputCols=cols, outputCol="features")
    pm = PipelineModel(stages=[asm, LinearRegression(featuresCol="features", labelCol="label").fit(asm.transform(frame))])
    reg = M.register(spark, pm, cols, str(tmp_path / "m"), {"sensor": 1, "pollutant": "pm2_5", "model": "Linear"})
    row = reg.first()
    assert row.features == cols and row.sensor == "1"
    again = M.load(row.path)
    assert again.transform(frame).count() == frame.count()


def test_trees_of_all_depths_are_scored_from_one(spark, monkeypatch):
    """Scores of every draw equal those of cross-validation, with a tree per fold and leaf size."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor
    from pyspark.ml.tuning import CrossValidator

    from airlattice.operators import trees

    monkeypatch.setitem(M.GRIDS, "DecisionTree", {"maxDepth": [1, 3, 6], "minInstancesPerNode": [1, 20]})
    frame, cols = M.feature_frame(_sine(spark, 160), ["sensor_id", "pollutant"], "ts", "value", 3)
    df = VectorAssembler(inputCols=cols, outputCol="features").transform(frame).persist()
    est = M.make("DecisionTree")
    draws = M.grid("DecisionTree", est)
    cv = CrossValidator(estimator=est, estimatorParamMaps=draws, numFolds=2, foldCol="_fold",
                        evaluator=RegressionEvaluator(metricName="r2", labelCol="label"))
    want = cv.fit(trees.folds(df, ["sensor_id", "pollutant"], "ts", 2)).avgMetrics
    fits, fit = [], DecisionTreeRegressor._fit
    monkeypatch.setattr(DecisionTreeRegressor, "_fit", lambda self, data: fits.append(1) or fit(self, data))
    data = trees.folds(df, ["sensor_id", "pollutant"], "ts", 2)
    assert np.allclose(M.tree_scores(est, draws, data, 2), want, rtol=0, atol=1e-12)
    assert len(fits) == 4
    fits.clear()
    _, params = M.random_search("DecisionTree", df, ["sensor_id", "pollutant"], "ts", cols, n=6, folds=2)
    assert len(fits) == 5 and want[draws.index(next(d for d in draws if {p.name: v for p, v in d.items()} == {p.name: v for p, v in params.items()}))] == max(want)


def test_every_draw_is_fitted_on_every_fold(spark, monkeypatch):
    """The training of the best family grows a tree for each draw and fold, also for draws that differ in depth only."""
    from pyspark.ml.regression import DecisionTreeRegressor
    monkeypatch.setitem(M.GRIDS, "DecisionTree", {"maxDepth": [1, 2, 3], "minInstancesPerNode": [1, 20]})
    frame, cols = M.feature_frame(_sine(spark, 120), ["sensor_id", "pollutant"], "ts", "value", 2)
    fits, fit = [], DecisionTreeRegressor._fit
    monkeypatch.setattr(DecisionTreeRegressor, "_fit", lambda self, data: fits.append((self.getMaxDepth(), self.getMinInstancesPerNode())) or fit(self, data))
    res = M.train_best(frame, cols, ["sensor_id", "pollutant"], "ts", ["DecisionTree"], draws=6, folds=2)
    best = {p.name: v for p, v in res.models["DecisionTree"][1].items()}
    want = [(d, m) for d in (1, 2, 3) for m in (1, 20)] * 2 + [(best["maxDepth"], best["minInstancesPerNode"])] * 2   # fitted at the end, and on every row
    assert sorted(fits) == sorted(want)


def test_pooled_frame_splits_scales_and_selects(spark):
    from airlattice.operators.frame import pooled_frame
    rng = np.random.default_rng(8)
    n = 300
    a, b, noise = rng.normal(50, 9, n), rng.normal(50, 9, n), rng.normal(50, 9, n)
    y = a - 0.5 * b + 0.1 * rng.normal(size=n)
    y[240:] += 1000.0       # of the holdout, so no statistic sees it
    rows = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(zip(a, noise, b, y))], "k int, i int, lag_1 double, lag_2 double, lag_3 double, label double")
    got = pooled_frame(rows.withColumn("ts", F.timestamp_seconds(F.col("i") * 3600)), ["k"], "ts", ["lag_1", "lag_2", "lag_3"])
    assert got.features == ["lag_1", "lag_3"]
    pdf = got.rows.orderBy("ts").toPandas()
    train = pdf["is_train"].to_numpy()
    assert train.sum() == 225 and train[:225].all() and "lag_2" not in pdf.columns
    low, mid, high = np.percentile(y[:225], [25, 50, 75])
    assert np.allclose(pdf["lag_1"], (a - mid) / (high - low)) and np.allclose(pdf["lag_3"], (b - mid) / (high - low))
    assert np.allclose(pdf["label"], y)
    flat = rows.withColumns({"label": F.lit(3.0), "ts": F.timestamp_seconds(F.col("i") * 3600)})
    assert pooled_frame(flat, ["k"], "ts", ["lag_1", "lag_2"]).features == ["lag_1", "lag_2"]
