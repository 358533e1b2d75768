"""Trees of all series at once against a plain numpy tree per series."""

import numpy as np
from pyspark.sql import functions as F

from airlattice.operators import trees as T

BINS = 16


def data(spark, n=90, f=3, series=2, seed=1, missing=False):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(series):
        x = rng.normal(size=(n, f))
        y = np.round(3 * (x[:, 0] > 0.2) + x[:, 1] * (x[:, 0] < 0) + 0.1 * rng.normal(size=n), 6)
        for i in range(n):
            v = [float(a) for a in x[i]]
            if missing and i % 7 == 0:
                v[0] = None if i % 2 else float("nan")
            rows.append((s, i, *v, float(y[i])))
    return rows, spark.createDataFrame(rows, "s int, i int, " + ", ".join(f"x{k} double" for k in range(f)) + ", y double")


def bins_of(x):
    bad = np.isnan(x)
    lo, hi = np.nanmin(x, 0), np.nanmax(x, 0)
    width = (hi - lo) / float(BINS)
    with np.errstate(invalid="ignore", divide="ignore"):
        b = np.clip(np.floor((x - lo) / width), 0, BINS - 1)
    b = np.where(width == 0, 0, b)
    return np.where(bad, -1, b).astype(int)


def plain_tree(b, g, depth, l2, min_leaf):
    """{place: (feature, bin)} and {place: rows}, by trying every split of every node."""
    node, splits = np.ones(len(b), int), {}
    for level in range(depth):
        for at in range(1 << level, 2 << level):
            own = np.flatnonzero(node == at)
            best = None
            for f in range(b.shape[1]):
                for cut in sorted(set(b[own, f]))[:-1]:
                    left = b[own, f] <= cut
                    if min(left.sum(), (~left).sum()) < min_leaf:
                        continue
                    score = lambda part: (float(g[own][part].sum()) * T.UNIT) ** 2 / (float(part.sum()) + l2)
                    gain = score(left) + score(~left) - score(np.ones(len(own), bool))
                    if gain > 1e-9 and (best is None or gain > best[0]):
                        best = (gain, f, cut)
            if best:
                splits[at] = best[1:]
                node[own] = 2 * at + (b[own, best[1]] > best[2])
    return splits, node


def boosted(b, y, g):
    """Predictions on the training rows of a plain boosted model, in label units."""
    units = np.round(y / T.UNIT).astype(np.int64)
    p = np.full(len(y), float(np.round(units.sum() / len(units))))
    for _ in range(g.trees):
        grad = units - np.round(p).astype(np.int64)
        _, node = plain_tree(b, grad, g.depth, g.l2, g.min_leaf)
        for at in np.unique(node):
            own = node == at
            p[own] += g.rate * float(grad[own].sum()) * T.UNIT / (own.sum() + g.l2) / T.UNIT
    return p * T.UNIT


def test_boosters_equal_plain_trees(spark):
    rows, df = data(spark, missing=True)
    families = {"LightGBM": T.Growth(trees=2, depth=3, rate=0.3, min_leaf=5), "XGBoost": T.Growth(trees=2, depth=2, rate=0.5, l2=1.0)}
    models = T.fit(df, ["s"], ["i"], ["x0", "x1", "x2"], "y", families, bins=BINS)
    got = {(r["s"], r["model"], r["i"]): r["prediction"] for r in T.predict(df, models, ["s"], ["x0", "x1", "x2"], BINS).collect()}
    assert len(got) == 2 * len(rows)
    for s in (0, 1):
        part = [r for r in rows if r[0] == s]
        x = np.array([[np.nan if v is None else v for v in r[2:5]] for r in part])
        y = np.array([r[5] for r in part])
        for name, g in families.items():
            want = boosted(bins_of(x), y, g)
            assert np.allclose([got[s, name, r[1]] for r in part], want, atol=2e-6)


def test_splits_equal_a_plain_tree(spark):
    rows, df = data(spark, n=120, series=1)
    g = T.Growth(trees=1, depth=4, rate=1.0, min_leaf=3)
    tree = T.fit(df, ["s"], ["i"], ["x0", "x1", "x2"], "y", {"m": g}, bins=BINS).first()["trees"][0]
    b, y = bins_of(np.array([r[2:5] for r in rows])), np.array([r[5] for r in rows])
    units = np.round(y / T.UNIT).astype(np.int64)
    splits, node = plain_tree(b, units - int(np.round(units.sum() / len(units))), 4, 0.0, 3)
    assert {n + 1: (f, c) for n, (f, c) in enumerate(zip(tree["f"], tree["b"])) if f is not None} == splits
    assert {n + 1 for n, v in enumerate(tree["v"]) if v is not None} == set(node.tolist())


def test_forest_learns_and_repeats(spark):
    rows, df = data(spark, n=200)
    families = {"RandomForest": T.Growth(trees=15, depth=5, forest=True, min_leaf=2, columns=0.7)}
    runs = []
    for part in (df, df.repartition(5)):
        models = T.fit(part, ["s"], ["i"], ["x0", "x1", "x2"], "y", families, bins=BINS)
        runs.append({(r["s"], r["i"]): (r["prediction"], r["y"]) for r in T.predict(df, models, ["s"], ["x0", "x1", "x2"], BINS).collect()})
    assert runs[0] == runs[1]                  # order and partitions do not matter
    p, y = np.array(list(runs[0].values())).T
    assert 1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum() > 0.8
    trees = models.first()["trees"]
    assert len(trees) == 15 and len({str(t["f"]) for t in trees}) > 5


def test_limits(spark):
    _, df = data(spark, n=150)
    families = {"few": T.Growth(trees=1, depth=5, leaves=4), "gain": T.Growth(trees=1, depth=5, min_gain=1e9),
                "half": T.Growth(trees=1, depth=3, rows=0.5, columns=0.5), "none": T.Growth(trees=1, depth=3, min_leaf=100)}
    found = {(r["s"], r["model"]): r["trees"][0] for r in T.fit(df, ["s"], ["i"], ["x0", "x1", "x2"], "y", families, bins=BINS).collect()}

    def leaves(t):
        return sum(v is not None for v in t["v"])
    for s in (0, 1):
        assert leaves(found[s, "few"]) == 4 and leaves(found[s, "none"]) == 1
        assert leaves(found[s, "gain"]) == 1 and leaves(found[s, "half"]) > 1


def test_awkward_series(spark):
    rows = [(1, i, 1.0, None, 2.0) for i in range(5)] + [(2, 0, 1.0, 2.0, 7.0)] + [(3, i, float(i), 1.0, None) for i in range(4)] + \
        [(4, i, float(i % 2), float("nan"), float(i % 2)) for i in range(30)]
    df = spark.createDataFrame(rows, "s int, i int, a double, b double, y double")
    families = {"f": T.Growth(trees=2, depth=2, forest=True), "g": T.Growth(trees=2, depth=2)}
    models = T.fit(df, ["s"], ["i"], ["a", "b"], "y", families)
    got = {(r["s"], r["i"], r["model"]): r["prediction"] for r in T.predict(df, models, ["s"], ["a", "b"]).collect()}
    assert got[1, 0, "g"] == 2.0 and got[2, 0, "g"] == 7.0
    assert {k: v for k, v in got.items() if k[0] == 3} == {(3, i, None): None for i in range(4)}
    assert [got[4, i, "g"] for i in (0, 1)] == [0.0, 1.0]
    empty = T.fit(df.limit(0), ["s"], ["i"], ["a", "b"], "y", families)
    assert empty.count() == 0


def test_search_picks_the_better_draw(spark):
    _, df = data(spark, n=150)
    draws = {"XGBoost": [T.Growth(trees=2, depth=3, rate=0.7), T.Growth(trees=1, depth=1, rate=0.01)],
             "RandomForest": [T.Growth(trees=5, depth=1, forest=True, min_leaf=70), T.Growth(trees=5, depth=4, forest=True)]}
    found = {(r["s"], r["family"], r["draw"]): r for r in T.search(df, ["s"], "i", ["x0", "x1", "x2"], "y", draws, 3).collect()}
    assert len(found) == 8
    for s in (0, 1):
        assert found[s, "XGBoost", 0]["is_best"] and found[s, "RandomForest", 1]["is_best"]
        assert found[s, "XGBoost", 0]["r2"] > found[s, "XGBoost", 1]["r2"]


def test_search_scores_equal_single_fits(spark):
    _, df = data(spark, n=61, series=1)
    g = T.Growth(trees=2, depth=2, rate=0.5)
    got = T.search(df, ["s"], "i", ["x0", "x1", "x2"], "y", {"m": [g]}, 3, bins=BINS).first()["r2"]
    marked = T.folds(df, ["s"], "i", 3)
    assert [r["n"] for r in marked.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).orderBy("_fold").collect()] == [21, 20, 20]
    each = []
    pdf = marked.orderBy("i").toPandas()
    x, fold = bins_of(pdf[["x0", "x1", "x2"]].to_numpy()), pdf["_fold"].to_numpy()
    for k in range(3):
        # bins come from all rows, as in the search; a row of the held fold has no weight
        units = np.round(pdf["y"].to_numpy() / T.UNIT).astype(np.int64)
        use = fold != k
        pred = np.full(len(pdf), float(np.round(units[use].sum() / use.sum())))
        for _ in range(g.trees):
            grad = units - np.round(pred).astype(np.int64)
            splits, node = plain_tree(x[use], grad[use], g.depth, g.l2, g.min_leaf)
            place = np.ones(len(pdf), int)
            for _ in range(g.depth):
                place = np.array([2 * n + (x[i, splits[n][0]] > splits[n][1]) if n in splits else n for i, n in enumerate(place)])
            value = {at: g.rate * grad[use][node == at].sum() / (node == at).sum() for at in set(node.tolist())}
            pred = pred + np.array([value[n] for n in place])
        p = pdf.assign(prediction=pred * T.UNIT)[fold == k]
        each.append(1 - ((p.y - p.prediction) ** 2).sum() / ((p.y - p.y.mean()) ** 2).sum())
    assert abs(got - np.mean(each)) < 1e-9


def test_train_marks_one_best_model_per_series(spark):
    _, df = data(spark, n=120)
    df = df.withColumn("is_train", F.col("i") < 90)
    families = {"RandomForest": T.Growth(trees=5, depth=4, forest=True), "LightGBM": T.Growth(trees=4, depth=3, rate=0.5, min_leaf=5, leaves=6),
                "XGBoost": T.Growth(trees=4, depth=3, rate=0.5, l2=1.0)}
    errors, best = T.train(df, ["s"], "i", ["x0", "x1", "x2"], "y", families)
    rows = errors.collect()
    assert len(rows) == 6 and sum(r["is_best"] for r in rows) == 2
    for s in (0, 1):
        own = [r for r in rows if r["s"] == s]
        assert min(own, key=lambda r: r["mae"])["is_best"]
    assert {(r["s"], r["model"]) for r in best.collect()} == {(r["s"], r["model"]) for r in rows if r["is_best"]}
