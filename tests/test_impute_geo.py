import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.functions import distance as D
from airlattice.functions.geo import haversine
from airlattice.operators import impute
from airlattice.operators.nearest import nearest


def _towns(spark, depth):
    """Two groups of wells, three by the river and four on the ridge, with a measured depth."""
    north = [0.4, 0.7, 0.9, 31.0, 33.5, 30.2, 34.1]
    level = [12.0, 11.5, 12.6, 240.0, 255.0, 238.0, 251.0]
    return spark.createDataFrame([(10 * i, north[i], level[i], depth[i]) for i in range(7)],
                                 "id long, north double, level double, depth double")


def test_a_gap_takes_the_mean_of_its_nearest(spark):
    df = _towns(spark, [4.0, 7.0, None, 60.0, 66.0, 72.0, None])
    out = {r.id: r.depth for r in impute.knn(df, "id", "depth", ["north", "level"], 2).collect()}
    assert out[20] == pytest.approx(5.5)                   # both river wells
    assert out[60] == pytest.approx((66.0 + 60.0) / 2)     # the two ridge wells next to it


def test_a_gap_among_gaps_stays(spark):
    df = _towns(spark, [None, None, None, 60.0, 66.0, 72.0, 70.0])
    out = {r.id: r.depth for r in impute.knn(df, "id", "depth", ["north", "level"], 2).collect()}
    assert [out[i] for i in (0, 10, 20)] == [None, None, None]


def test_too_few_rows_and_bad_arguments(spark):
    two = _towns(spark, [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]).limit(2)
    assert impute.knn(two, "id", "depth", ["north"], 1).filter("depth IS NULL").count() == 1
    df = _towns(spark, [4.0, None, 5.0, 60.0, 66.0, 72.0, 70.0])
    for wrong in ({"k": 0}, {"k": -3}, {"k": 8}, {"k": 2, "how": "largest"}, {"k": 2, "metric": "cosine"},
                  {"k": 2, "categorical_metric": "edit"}):
        with pytest.raises(ValueError):
            impute.knn(df, "id", "depth", ["north", "level"], **wrong)


@pytest.mark.parametrize("categorical_metric", ["jaccard", "hamming", "euclidean", "weighted-hamming"])
def test_mixed_attributes_match_brute_force(spark, monkeypatch, categorical_metric):
    monkeypatch.setattr(impute, "BLOCK", 16)      # several blocks per partition
    rng = np.random.default_rng(8)
    n, k = 160, 3
    x = rng.normal(size=(n, 2))
    cats = [(str(rng.choice(list("abc"))), str(rng.choice(["u", "v", "w", "z"]))) for _ in range(n)]
    cats[7] = (None, "u")
    target = [None if i % 4 == 0 else float(i) for i in range(n)]
    df = spark.createDataFrame([(i, *map(float, x[i]), *cats[i], target[i]) for i in range(n)],
                               "id long, x double, y double, c string, d string, t double")
    got = {r.id: r.f for r in impute.knn(df, "id", "t", ["x", "y"], k, out="f", categorical=["c", "d"],
                                         categorical_metric=categorical_metric).collect()}
    mode = [max(sorted({c[j] for c in cats if c[j]}), key=lambda v, j=j: sum(c[j] == v for c in cats)) for j in range(2)]
    full = [tuple(c[j] or mode[j] for j in range(2)) for c in cats]
    z = (x - x.mean(0)) / (x.max(0) - x.min(0))
    share = [{v: sum(f[j] == v for f in full) / n for v in {f[j] for f in full}} for j in range(2)]

    def distance(i, j):
        differ = sum(p != q for p, q in zip(full[i], full[j]))
        if categorical_metric == "jaccard":
            cat = 2 * differ / (2 + differ)
        elif categorical_metric == "hamming":
            cat = differ / 2
        elif categorical_metric == "euclidean":
            cat = math.sqrt(2 * differ)
        else:
            cat = 2 / sum(1 / (share[m][full[i][m]] if full[i][m] == full[j][m] else 1.0) for m in range(2))
        return (math.dist(z[i], z[j]) * 2 + cat * 2) / 4
    for i in range(n):
        if target[i] is None:
            near = sorted((distance(i, j), j) for j in range(n) if j != i)[:k]
            known = [target[j] for _, j in near if target[j] is not None]
            want = sum(known) / len(known) if len(known) > k - 0.5 * k else None
            assert got[i] == (pytest.approx(want) if want is not None else None), i


def test_dense_clusters_stay_cheap(spark, monkeypatch):
    """3,000 points in a tiny spot and one far away: a query visits few of the partitions."""
    rng = np.random.default_rng(9)
    pts = rng.uniform(0, 1e-3, (3000, 2)).tolist() + [[1000.0, 1000.0]]
    rows = [(i, *map(float, p), None if i % 300 == 0 else 1.0) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, x double, y double, t double")
    seen = []
    cut = impute.cut_lineage
    monkeypatch.setattr(impute, "cut_lineage", lambda d: seen.append(cut(d)) or seen[-1])
    out = impute.knn(df, "id", "t", ["x", "y"], 5)
    assert out.filter("t IS NULL").count() == 0
    # What left the first search: K rows per query from each block it visited.
    found = next(d for d in seen if d.columns == ["id", "_j", "_t", "_dist"])
    queries = df.filter("t IS NULL").count()
    assert found.count() <= 5 * queries * 3


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    n, k = 300, 4
    pts = rng.normal(size=(n, 3))
    pts[:60] = pts[0]  # a hot group of identical rows
    target = [None if i % 5 == 0 else float(rng.integers(0, 5)) for i in range(n)]
    df = spark.createDataFrame([(i, *map(float, pts[i]), target[i]) for i in range(n)],
                               "id long, x double, y double, z double, t double")
    for how in ("mean", "median", "mode"):
        got = {r.id: r.f for r in impute.knn(df, "id", "t", ["x", "y", "z"], k, how=how, out="f").collect()}
        for i in range(n):
            if target[i] is not None:
                continue
            d = sorted((math.dist(pts[i], pts[j]), j) for j in range(n) if j != i)[:k]
            vals = [target[j] for _, j in d]
            ok = [v for v in vals if v is not None]
            if len(vals) - len(ok) >= 0.5 * k:
                exp = None
            elif how == "mean":
                exp = float(np.mean(ok))
            elif how == "median":
                exp = float(np.median(ok))
            else:
                cnt = {v: ok.count(v) for v in ok}
                exp = min(v for v in cnt if cnt[v] == max(cnt.values()))
            assert (got[i] is None and exp is None) or got[i] == pytest.approx(exp), (how, i)


def test_haversine_fixture_distance(spark):
    df = spark.createDataFrame([(42.0016, 21.4302, 41.99249998, 21.4236110)], "a double, b double, c double, d double")
    assert df.select(haversine("a", "b", "c", "d").alias("x")).first().x == pytest.approx(1.14908, abs=1e-5)


def test_nearest_matches_brute_force(spark):
    rnd = random.Random(5)
    places = [(i, 60 + rnd.random() * 0.3, 10 + rnd.random() * 0.6) for i in range(200)]
    points = [(i, 60 + rnd.random() * 0.3, 10 + rnd.random() * 0.6) for i in range(300)]
    P = spark.createDataFrame(points, "point_id long, lat double, lon double")
    Q = spark.createDataFrame(places, "place_id long, lat double, lon double")
    got = {r.point_id: r.place_id for r in nearest(P, Q, "point_id", "place_id", 2.0).collect()}

    def hv(a, b):
        p1, p2 = math.radians(a[0]), math.radians(b[0])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(h))

    for pid, la, lo in points:
        best = min(((hv((la, lo), (qa, qo)), qid) for qid, qa, qo in places))
        assert got[pid] == (best[1] if best[0] <= 2.0 else None)


def test_categorical_distances(spark):
    df = spark.createDataFrame([("a", "x", "a", "y")], "a1 string, a2 string, b1 string, b2 string")
    a, b = ["a1", "a2"], ["b1", "b2"]
    r = df.select(D.categorical(a, b, "hamming").alias("h"), D.categorical(a, b, "jaccard").alias("j"),
                  D.categorical(a, b, "euclidean").alias("e")).first()
    # one of two attributes differs: hamming 1/2; one-hot jaccard 2/3; one-hot euclid sqrt(2)
    assert (r.h, r.j, r.e) == (0.5, pytest.approx(2 / 3), pytest.approx(math.sqrt(2)))


def test_weighted_hamming_matches_definition(spark):
    rows = [("a", "x"), ("a", "y"), ("b", "x"), ("a", "x")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, c1 string, c2 string")
    freqs = {c: impute.relative_frequency(df, c, f"f_{c}") for c in ("c1", "c2")}
    pairs = [(i, j) for i, j in itertools.product(range(4), range(4)) if i != j]
    pdf = spark.createDataFrame([(i, j, *rows[i], *rows[j]) for i, j in pairs],
                                "i long, j long, a_c1 string, a_c2 string, b_c1 string, b_c2 string")
    for c in ("c1", "c2"):
        pdf = pdf.join(freqs[c].withColumnRenamed(c, f"a_{c}"), f"a_{c}")
    got = {(r.i, r.j): r.d for r in pdf.select("i", "j", D.weighted_hamming(
        ["a_c1", "a_c2"], ["b_c1", "b_c2"], ["f_c1", "f_c2"]).alias("d")).collect()}
    for i, j in pairs:
        per = []
        for k in range(2):
            col = [r[k] for r in rows]
            per.append(col.count(rows[i][k]) / 4 if rows[i][k] == rows[j][k] else 1.0)
        assert got[(i, j)] == pytest.approx(2 / sum(1 / v for v in per))


def test_nearest_with_copies(spark):
    places = spark.createDataFrame([(5, 60.0, 10.0), (3, 60.0, 10.0), (7, 60.001, 10.0)] +
                                   [(100 + i, 60.0, 10.0) for i in range(200)],
                                   "place_id long, lat double, lon double")
    points = spark.createDataFrame([(i, 60.0001, 10.0) for i in range(300)] + [(999, 10.0, 10.0),
                                    (1000, None, None)], "point_id long, lat double, lon double")
    got = {r.point_id: r.place_id for r in nearest(points, places, "point_id", "place_id").collect()}
    assert all(got[i] == 3 for i in range(300))
    assert got[999] is None and got[1000] is None and len(got) == 302
