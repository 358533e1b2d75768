"""The folded recursion against a plain loop over the steps."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.operators import recursion as R
from airlattice.operators import series as S
from airlattice.operators import trees as T

LAGS, START = 3, datetime(2024, 1, 1)
AS_OF = START + timedelta(hours=59)


def tables(spark):
    rng = np.random.default_rng(4)
    rows = [(s, START + timedelta(hours=i), float(np.round(20 + 8 * math.sin(i / 4 + s) + rng.normal(), 4))) for s in (1, 2) for i in range(70)]
    rows += [(3, START + timedelta(hours=i), 5.0) for i in range(2)]                       # shorter than the lags
    wx = [(s, START + timedelta(hours=i), float(i % 11), float(s)) for s in (1, 2, 3) for i in range(85) if not (s == 2 and 60 < i < 64)]
    wx.append((1, START + timedelta(hours=62), 0.5, 9.0))                                  # an hour twice: the smaller counts
    return (rows, spark.createDataFrame(rows, "s int, ts timestamp, v double"),
            wx, spark.createDataFrame(wx, "s int, ts timestamp, temp double, wind double"))


def loop(rows, wx, stats, s, model, steps=25):
    """One series, step by step; ``model`` takes the feature list and gives a number or None."""
    hist = [v for k, t, v in rows if k == s and t <= AS_OF][-LAGS:]
    hist = [None] * (LAGS - len(hist)) + hist
    held = {}
    for k, t, *x in sorted(wx, reverse=True):
        if k == s:
            held[t] = x
    out = []
    for step in range(1, steps + 1):
        t = AS_OF + timedelta(hours=step)
        scaled = lambda v, c: None if v is None else (v - stats[f"_a_{c}"]) / (stats[f"_b_{c}"] or 1.0)
        x = [scaled(hist[-k], "v") for k in range(1, LAGS + 1)]
        x += [scaled(v, c) for v, c in zip(held.get(t - timedelta(hours=1), [None, None]), ("temp", "wind"))]
        x += [f(2 * math.pi * p / m) for p, m in ((t.hour, 24.0), (t.weekday(), 7.0)) for f in (math.cos, math.sin)]
        p = model(x)
        p = p if p is not None and p >= 0 else None
        hist = [*hist[1:], p if p is not None else (0.0 if step == 1 else out[-1])]
        out.append(p)
    return out[1:]


def run(spark, model, models=None):
    rows, series, wx, weather = tables(spark)
    stats = S.scale_stats(S.cutoff(series, "ts", AS_OF).join(weather, ["s", "ts"], "left"), ["s"], ["v", "temp", "wind"], "min_max")
    st = R.state(series, weather, stats, ["s"], "ts", "v", LAGS, ["temp", "wind"], ["s"], AS_OF)
    got = {}
    for r in R.recursive(st, ["s"], "ts", LAGS, model, models(series, weather, stats) if models else None).orderBy("s", "ts").collect():
        assert r["ts"] == AS_OF + timedelta(hours=r["step"])
        got.setdefault(r["s"], []).append(r["value"])
    return got, rows, wx, {r["s"]: r.asDict() for r in stats.collect()}


def test_linear_model_with_failed_steps(spark):
    weights = {"lag_1": -30.0, "lag_3": 12.0, "temp": 9.0, "hour_cos": 6.0}
    got, rows, wx, stats = run(spark, R.linear(weights, 8.0, LAGS, ["temp", "wind"]))
    names = R.names(LAGS, ["temp", "wind"])

    def model(x):
        used = [(w, x[names.index(c)]) for c, w in weights.items()]
        return None if any(v is None for _, v in used) else 8.0 + sum(w * v for w, v in used)
    failed = 0
    for s in (1, 2, 3):
        want = loop(rows, wx, stats[s], s, model)
        assert [g is None for g in got[s]] == [w is None for w in want]
        assert all(w is None or abs(g - w) < 1e-9 for g, w in zip(got[s], want))
        failed += sum(w is None for w in want)
        assert len(want) == 24
    assert 0 < failed < 3 * 24
    with pytest.raises(ValueError):
        R.linear({"pressure": 1.0}, 0.0, LAGS, ["temp"])


def test_tree_model_equals_the_loop(spark):
    kept = {}

    def models(series, weather, stats):
        names = R.names(LAGS, ["temp", "wind"])
        known = R.rows(S.cutoff(series, "ts", AS_OF), weather, stats, ["s"], "ts", "v", LAGS, ["temp", "wind"], ["s"]).dropna(subset=[*names, "v"])
        m = T.fit(known, ["s"], ["ts"], names, "v", {"XGBoost": T.Growth(trees=2, depth=3, rate=0.5, l2=1.0)}, bins=16).cache()
        kept.update({r["s"]: r for r in m.collect()})
        return m
    got, rows, wx, stats = run(spark, R.trees(16), models)

    def model(row):
        def predict(x):
            b = [-1 if v is None else 0 if w == 0 else min(15, max(0, math.floor((v - lo) / w))) for v, lo, w in zip(x, row["lo"], row["width"])]
            total = row["base"]
            for t in row["trees"]:
                n = 1
                while n <= len(t["f"]) and t["f"][n - 1] is not None:
                    n = 2 * n + (b[t["f"][n - 1]] > t["b"][n - 1])
                total += t["v"][n - 1] if n <= len(t["v"]) and t["v"][n - 1] is not None else 0.0
            return total
        return predict
    for s in (1, 2):
        want = loop(rows, wx, stats[s], s, model(kept[s]))
        assert all(abs(g - w) < 1e-9 for g, w in zip(got[s], want)) and len(set(want)) > 1
    assert got[3] == [None] * 24
