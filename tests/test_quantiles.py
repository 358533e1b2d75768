import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.operators import quantiles as Q
from airlattice.operators import series as S

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def _check(spark, data, **sizes):
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double")
    got = {r.k: r for r in Q.quantiles(df, ["k"], "v", PROBS, **sizes).collect()}
    known = {k: [v for v in vs if v is not None and not np.isnan(v)] for k, vs in data.items()}
    assert set(got) == {k for k, vs in known.items() if vs}
    for k, r in got.items():
        assert r.n == len(known[k])
        assert r.q == pytest.approx(list(np.quantile(known[k], PROBS)), rel=1e-12, abs=1e-300)


@pytest.mark.parametrize("sizes", [{}, {"bins": 4, "bound": 3}])
def test_equal_to_sorting(spark, sizes):
    rng = np.random.default_rng(3)
    _check(spark, {
        "hot": rng.normal(size=700).tolist(), "ties": rng.integers(0, 4, 300).astype(float).tolist(), "one": [5.0], "two": [1.0, 2.0],
        "copies": [7.0] * 100, "far": [0.0] * 20 + rng.normal(size=60).tolist() + [1e300, -1e300],
        None: [1.0, 2.0, 4.0, None, float("nan")], "none": [None, float("nan")], "tiny": [5e-324, 0.0, 1e-323, 1.5e-323, 2e-323],
        "wide": [1.7e308, -1.7e308, 0.0, 1.0, 2.0]}, **sizes)


def test_statistics_scale_as_the_window_does(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i % 3, i, float(v), 1.0 if i % 5 else None) for i, v in enumerate(rng.normal(size=200))], "k int, i int, v double, w double")
    a = S.apply_scale(df, Q.robust_stats(df, ["k"], ["v", "w"], bins=4, bound=5), ["k"], ["v", "w"]).orderBy("i").collect()
    b = S.scale(df, ["k"], ["v", "w"], "robust").orderBy("i").collect()
    assert all(x.v == pytest.approx(y.v) and x.w == y.w for x, y in zip(a, b))
    assert Q.quantiles(df.limit(0), ["k"], "v", PROBS).count() == 0


def test_a_task_sorts_bounded_parts_only(spark):
    """200,000 distinct values of one series: after one round the intervals left hold few rows."""
    df = spark.range(200_000).select(F.lit("a").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    want = np.quantile(df.toPandas()["v"], [0.25, 0.5, 0.75])
    assert Q.quantiles(df, ["k"], "v", [0.25, 0.5, 0.75], bound=1000).first().q == pytest.approx(list(want))
