import tempfile

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from airlattice.operators import linear as L
from airlattice.operators import trees as T

X = ["a", "b", "c"]
DRAWS = [(0.0, 0.0), (0.5, 0.0), (0.1, 0.5), (0.3, 1.0), (50.0, 1.0)]


def _rows(n=90, seed=0, flat=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [10.0, 0.0, 3.0]
    if flat:
        x[:, 2] = 3.0
    y = 4.0 + x @ [2.0, -0.5, 1.0] + rng.normal(size=n)
    return x, y


def _frame(spark, series):
    data = [(k, i, *map(float, x), float(y)) for k, (xs, ys) in series.items() for i, (x, y) in enumerate(zip(xs, ys))]
    return spark.createDataFrame(data, "k long, t int, a double, b double, c double, y double")


def _search(df, draws=DRAWS, k=5):
    marked = T.folds(df, ["k"], "t", k)
    return L.search(L.fold_sums(marked, ["k"], "_fold", X, "y"), ["k"], X, "y", draws)


def test_draws_equal_direct_fits_on_the_rows(spark):
    x, y = _rows()
    got = {r.draw: r for r in _search(_frame(spark, {1: (x, y)})).collect()}
    assert set(got) == set(range(len(DRAWS))) and sum(r.is_best for r in got.values()) == 1
    marked = T.folds(_frame(spark, {1: (x, y)}), ["k"], "t", 5)
    data = VectorAssembler(inputCols=X, outputCol="features").transform(marked).withColumn("label", F.col("y")).cache()
    meter = RegressionEvaluator(metricName="r2")
    for d, (reg, alpha) in enumerate(DRAWS):
        lr = LinearRegression(regParam=reg, elasticNetParam=alpha, solver="normal", tol=1e-10, maxIter=1000)
        r2 = [meter.evaluate(lr.fit(data.where(f"_fold <> {f}")).transform(data.where(f"_fold = {f}"))) for f in range(5)]
        assert got[d].r2 == pytest.approx(np.mean(r2), abs=1e-6)
    best = max(got.values(), key=lambda r: r.r2)
    assert best.is_best and len(best.coefficients) == 3
    assert all(r.coefficients is None for r in got.values() if not r.is_best)
    data.unpersist()


def test_unpenalised_draw_is_least_squares(spark):
    x, y = _rows(seed=2)
    row = _search(_frame(spark, {1: (x, y)}), [(0.0, 0.0)]).first()
    beta = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)[0]
    assert np.allclose([row.intercept, *row.coefficients], beta, atol=1e-8)


def test_series_do_not_mix_and_keys_stay_exact(spark):
    big = 2 ** 53 + 1
    a, b = _rows(seed=3), _rows(seed=4, n=40)
    both = _search(_frame(spark, {big: a, None: b})).collect()
    alone = {k: {r.draw: r.r2 for r in _search(_frame(spark, {k: s})).collect()} for k, s in ((big, a), (None, b))}
    assert {r.k for r in both} == {big, None}
    assert all(r.r2 == pytest.approx(alone[r.k][r.draw], abs=1e-9) for r in both)


def test_flat_feature_flat_label_short_series_and_nulls(spark):
    x, y = _rows(flat=True)
    rows = {r.draw: r for r in _search(_frame(spark, {1: (x, y)})).collect()}
    assert next(r for r in rows.values() if r.is_best).coefficients[2] == 0.0
    level = {r.draw: r for r in _search(_frame(spark, {1: (x, np.full(len(y), 7.0))})).collect()}
    assert all(r.r2 is None for r in level.values()) and level[0].is_best and level[0].intercept == pytest.approx(7.0)
    short = _search(_frame(spark, {1: (x[:1], y[:1])})).collect()
    assert len(short) == len(DRAWS) and all(r.r2 is None for r in short)
    holes = _frame(spark, {1: (x, y)}).withColumn("a", F.when(F.col("t") != 5, F.col("a")))
    assert L.fold_sums(T.folds(holes, ["k"], "t", 5), ["k"], "_fold", X, "y").agg(F.sum("n")).first()[0] == len(y) - 1
    assert _search(_frame(spark, {1: (x, y)}).limit(0)).count() == 0


def test_predict_uses_the_best_model_of_the_series(spark):
    x, y = _rows(seed=6)
    df = _frame(spark, {1: (x, y)})
    models = _search(df, [(0.0, 0.0)])
    out = L.predict(df.unionByName(df.withColumn("k", F.lit(9).cast("long"))), models, ["k"], X).collect()
    assert all((r.prediction is None) == (r.k == 9) for r in out)
    assert np.mean([(r.prediction - r.y) ** 2 for r in out if r.k == 1]) < 1.5


def test_estimator_is_saved_and_loaded(spark):
    from pyspark.ml import Pipeline, PipelineModel
    x, y = _rows(seed=5)
    df = _frame(spark, {1: (x, y)}).withColumn("label", F.col("y"))
    asm = VectorAssembler(inputCols=X, outputCol="features")
    fitted = Pipeline(stages=[asm, L.ElasticNet(regParam=0.1, elasticNetParam=0.5)]).fit(df)
    path = tempfile.mkdtemp() + "/m"
    fitted.write().overwrite().save(path)
    a, b = fitted.transform(df), PipelineModel.load(path).transform(df)
    assert [r.prediction for r in a.orderBy("t").collect()] == [r.prediction for r in b.orderBy("t").collect()]
    spark_ml = LinearRegression(regParam=0.1, elasticNetParam=0.5, solver="normal", tol=1e-10, maxIter=1000).fit(asm.transform(df))
    assert np.allclose(fitted.stages[1].getOrDefault("coefficients"), spark_ml.coefficients.toArray(), atol=1e-5)


def test_a_family_is_registered_searched_and_chosen(spark):
    from airlattice.operators import model as M

    class Mine(L.ElasticNet):
        pass
    M.register_family("Mine", Mine, {"regParam": [0.0, 100.0], "elasticNetParam": [0.0]})
    try:
        with pytest.raises(ValueError):
            M.register_family("Mine", Mine, {"regParam": [0.0]})
        with pytest.raises(ValueError):
            M.register_family("Other", Mine, {"maxDepth": [1]})
        x, y = _rows(seed=7, n=120)
        df = _frame(spark, {1: (x, y)}).withColumns({"label": F.col("y"), "ts": F.timestamp_seconds(F.col("t") * 3600)})
        res = M.train_best(df, X, ["k"], "ts", ["Mine", "ElasticNet", "Linear"], draws=2, folds=3)
        errors = {r.model: r for r in res.errors.collect()}
        assert set(errors) == {"Mine", "ElasticNet", "Linear"} and sum(r.is_best for r in errors.values()) == 1
        assert all(r.mae < 1.2 for r in errors.values())
        assert {p.name: v for p, v in res.models["Mine"][1].items()} == {"regParam": 0.0, "elasticNetParam": 0.0}
        M.register_family("Strong", L.ElasticNet, {"regParam": [1e6], "elasticNetParam": [1.0]})
        heavy = M.train_best(df, X, ["k"], "ts", ["Strong"], draws=1, folds=3)
        assert heavy.models["_best_raw"].getOrDefault("coefficients") == [0.0, 0.0, 0.0]     # the refit is tuned too
    finally:
        for name in ("Mine", "Strong"):
            M.FAMILIES.pop(name, None), M.GRIDS.pop(name, None)
