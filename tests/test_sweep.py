import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.operators import select as SEL
from airlattice.operators import sweep as W
from airlattice.operators.series import gram_sums

X = ["a", "b", "c", "d"]


def _frame(spark, series):
    data = [(k, *map(float, x), float(y)) for k, (xs, ys) in series.items() for x, y in zip(xs, ys)]
    return spark.createDataFrame(data, "k long, a double, b double, c double, d double, y double")


def _fit(x, y):
    """Coefficients, t and degrees of freedom by an inverse over the rows."""
    full = np.column_stack([np.ones(len(y)), x])
    inv = np.linalg.inv(full.T @ full)
    beta = inv @ full.T @ y
    dof = len(y) - full.shape[1]
    rss = ((y - full @ beta) ** 2).sum()
    return beta[1:], (beta / np.sqrt(np.diag(inv) * rss / dof))[1:], dof


def _p(t, dof, steps=200_000):
    """The tail of Student's density by Simpson's rule over an angle: t = sqrt(dof) tan(angle)."""
    u = np.linspace(math.atan(abs(t) / math.sqrt(dof)), math.pi / 2, steps + 1)
    f = np.cos(u) ** (dof - 1)
    area = (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum()) * (u[1] - u[0]) / 3
    return 2 * area * math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)


def _series(n, seed, weights=(2.0, 0.0, 0.3, 0.0)):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, 4)) + [50.0, 0.0, -3.0, 1.0]
    return x, 5.0 + x @ np.array(weights) + rng.normal(size=n)


def test_p_values_equal_the_integral_of_the_density(spark):
    cases = [(t, d) for t in (0.0, 1e-3, 0.5, 1.0, 2.0, 5.0, 20.0) for d in (1, 2, 3, 10, 31, 200, 5000)]
    df = spark.createDataFrame([(float(t), float(d)) for t, d in cases], "t double, dof double")
    for r in df.select("t", "dof", F.expr(W.p_value("t", "dof")).alias("p")).collect():
        assert r.p == pytest.approx(_p(r.t, r.dof), rel=1e-7, abs=1e-12)


def test_statistics_equal_an_inverse_over_the_rows(spark):
    data = {k: _series(n, k) for k, n in ((1, 60), (2, 400), (3, 9))}
    got = W.statistics(gram_sums(_frame(spark, data), ["k"], X, "y"), ["k"], X, "y").collect()
    assert len(got) == 12
    for r in got:
        beta, t, dof = _fit(*data[r.k])
        i = X.index(r.feature)
        assert (r.coefficient, r.t) == (pytest.approx(beta[i], rel=1e-6, abs=1e-9), pytest.approx(t[i], rel=1e-6, abs=1e-7))
        assert r.p == pytest.approx(_p(t[i], dof), rel=1e-5, abs=1e-10)


def test_selection_equals_refits_on_the_rows(spark):
    data = {k: _series(n, k, w) for k, n, w in ((1, 80, (2.0, 0.0, 0.3, 0.0)), (2, 300, (0.0, 0.0, 0.0, 0.0)),
                                               (3, 12, (0.1, 0.2, 0.3, 0.4)), (2 ** 53 + 1, 150, (1.0, 1.0, 1.0, 1.0)))}
    got = {r.k: r for r in SEL.select_features(_frame(spark, data), ["k"], X, "y").collect()}
    assert set(got) == set(data)
    for k, (x, y) in data.items():
        keep = list(range(4))
        while keep:
            _, t, dof = _fit(x[:, keep], y)
            weakest = int(np.argmin(np.abs(t)))
            if _p(t[weakest], dof) <= 0.05:
                break
            keep.pop(weakest)
        assert got[k].selected == [X[i] for i in keep]
        if keep:
            assert got[k].p_values == pytest.approx([_p(v, dof) for v in t], rel=1e-5, abs=1e-10)


def test_constant_repeated_and_short(spark):
    x, y = _series(50, 1)
    flat, twice = x.copy(), x.copy()
    flat[:, 1], twice[:, 3] = 7.0, x[:, 0]
    exact = x[:, 0] * 3.0 + 1.0
    data = {1: (flat, y), 2: (twice, y), 3: (x[:3], y[:3]), 4: (x[:1], y[:1]), 5: (x, exact)}
    df = _frame(spark, data)
    stats = {(r.k, r.feature): r for r in W.statistics(gram_sums(df, ["k"], X, "y"), ["k"], X, "y").collect()}
    assert stats[1, "b"].t is None and stats[1, "b"].p is None and stats[2, "d"].coefficient is None
    assert stats[1, "a"].p < 1e-6 and stats[3, "a"].p is None
    got = {r.k: r for r in SEL.select_features(df, ["k"], X, "y").collect()}
    assert "b" not in got[1].selected and "d" not in got[2].selected and "a" in got[2].selected
    assert got[4].selected == [] and "a" in got[5].selected
    assert SEL.select_features(df.limit(0), ["k"], X, "y").count() == 0
