import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.functions import timefeat as T
from airlattice.operators import series as S


def test_season(spark):
    df = spark.createDataFrame([(d,) for d in ["2024-01-15", "2024-04-15", "2024-07-15", "2024-10-15",
                                               "2024-12-25"]], "d string")
    out = [r.s for r in df.select(T.season(F.to_timestamp("d")).alias("s")).collect()]
    assert out == ["winter", "spring", "summer", "autumn", "winter"]


def test_cyclic(spark):
    df = spark.createDataFrame([(0,), (6,)], "h int")
    c, s = T.cyclic("h", 24, 9)
    out = df.select(c.alias("c"), s.alias("s")).collect()
    assert [(r.c, r.s) for r in out] == [(1.0, 0.0), (0.0, 1.0)]


def test_codes(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "i int, c string")
    assert [r.c for r in T.codes(df, ["c"]).orderBy("i").collect()] == [0, 1, 0]


def test_session_and_weekend(spark):
    df = spark.createDataFrame([("2024-01-06 00:00:00",), ("2024-01-08 05:00:00",), ("2024-01-08 23:00:00",)], "s string")
    ts = F.to_timestamp("s")
    out = df.select(T.session_code(ts).alias("x"), T.calendar_flags(ts)["is_weekend"].alias("w")).collect()
    assert [(r.x, r.w) for r in out] == [(0, 0), (1, 1), (5, 1)]


def test_min_max_scale(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 5.0), (1, 10.0)], "k int, v double")
    assert sorted(r.v for r in S.scale(df, ["k"], ["v"], "min_max").collect()) == [0.0, 0.5, 1.0]


def test_robust_scale_interpolates(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 10.0]
    df = spark.createDataFrame([(1, v) for v in vals], "k int, v double")
    got = sorted(r.v for r in S.scale(df, ["k"], ["v"], "robust").collect())
    med, iqr = np.percentile(vals, 50), np.percentile(vals, 75) - np.percentile(vals, 25)
    assert np.allclose(got, sorted((np.array(vals) - med) / iqr))


def test_lead_align(spark):
    df = spark.createDataFrame([(1, 1, 1, 4), (1, 2, 2, 5), (1, 3, 3, 6)], "k int, t int, a int, b int")
    out = S.lead_align(df, ["k"], "t", ["a", "b"]).orderBy("t").collect()
    assert [(r.a, r.b) for r in out] == [(2, 5), (3, 6)]


def _yw_pacf(x, nlags):
    x = np.asarray(x, float) - np.mean(x)
    n = len(x)
    r = np.array([np.sum(x[k:] * x[:n - k]) / (n - k) for k in range(nlags + 1)])
    out = [1.0]
    for k in range(1, nlags + 1):
        R = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        out.append(np.linalg.solve(R, r[1:k + 1])[-1])
    return np.array(out)


def test_pacf_matches_yule_walker(spark):
    rng = np.random.default_rng(7)
    n = 400
    x = [20 + 5 * math.sin(2 * math.pi * i / 24) + rng.normal() for i in range(n)]
    rows = [(1, i, float(round(v, 6))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k int, t int, v double")
    ac = S.autocov(df, ["k"], "t", "v", 24)
    got = np.array(S.pacf(ac, ["k"], 24).first()["pacf"])
    assert np.allclose(got, _yw_pacf([r[2] for r in rows], 24), atol=1e-9)


def test_lag_selection_small_series_uses_half_length(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 3, 2, 5, 4, 6, 5, 8])],
                               "k int, t int, v double")
    ac = S.autocov(df, ["k"], "t", "v", 24)
    assert len(S.pacf(ac, ["k"], 24).first()["pacf"]) == 8 // 2 - 1 + 1


def test_pacf_of_flat_short_and_missing(spark):
    ac = spark.createDataFrame([("flat", 40, [0.0, 0.0, 0.0]), ("short", 3, [1.0, 0.5, 0.2]), ("hole", 40, [1.0, None, 0.2]),
                                ("exact", 40, [1.0, 1.0, 1.0]), ("plain", 40, [2.0, 1.0, 0.8])], "k string, n int, acov array<double>")
    got = {r.k: list(r.pacf) for r in S.pacf(ac, ["k"], 2).collect()}
    assert got["flat"][0] == 1.0 and np.isnan(got["flat"][1:]).all() and len(got["flat"]) == 3
    assert got["short"] == [1.0]
    assert got["hole"][0] == 1.0 and np.isnan(got["hole"][1:]).all()
    assert got["exact"][:2] == [1.0, 1.0] and np.isnan(got["exact"][2])     # nothing is left to explain
    assert got["plain"] == pytest.approx([1.0, 0.5, (0.8 - 0.5) / (2.0 - 0.5)])
