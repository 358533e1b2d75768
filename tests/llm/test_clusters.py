import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from airlattice.llm.clusters import cluster, summary
from airlattice.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<double>, label int, x int, dots string, cluster string, distance string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, "a", "b", "c") for i, v in rows], SCHEMA)


def brute(rows, k, rounds, dim, scale, seed):
    """Whole distances in Python integers."""
    kept = [(i, [math.floor(Fraction(c) * scale) for c in v]) for i, v in rows if v is not None and len(v) == dim
            and all(c is not None and np.isfinite(c) and abs(c) * scale < 2 ** 62 for c in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            part = [v for (_, v), o in zip(kept, own) if o == j]
            if part:
                c[j] = [sum(col) // len(part) for col in zip(*part)]
    found = [(i, *near(v)) for i, v in kept]
    part = {j: sum(d for _, d, o in found if o == j) for j in range(len(c))}
    fits = [d if d < 2 ** 63 else None for d in [*part.values(), sum(part.values())]]
    return sorted(((i, j, d if d < 2 ** 63 else None, fits[j], fits[-1], hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for i, d, j in found), key=str)


def run(spark, rows, **how):
    found, centroids = cluster(table(spark, rows), Scratch(spark), **how)
    return sorted((tuple(r) for r in summary(found, centroids).collect()), key=str)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e9, 1e17])
def test_equals_brute_force(spark, size):
    rng = np.random.default_rng(3)
    rows = [(2 ** 53 + 2 * i + 1, (rng.normal(size=4) * (size if i % 3 else 1.0)).tolist()) for i in range(120)]
    how = dict(k=5, rounds=3, dim=4, scale=8, seed=2)
    assert run(spark, rows, **how) == brute(rows, **how)


def test_awkward_rows(spark):
    good = [1.0, -0.51, 0.0]
    rows = [(1, good), (1, good), (1, [3.0, 3.0, 3.0]), (None, [2.0, 2.0, 2.0]), (2, None), (3, []), (4, [1.0, None, 2.0]), (5, [1.0, float("nan"), 0.0]),
            (6, [float("inf"), 0.0, 0.0]), (7, [1.0, 2.0]), (8, [0.0, 0.0, 0.0]), (9, [-1e-9, 1e300, 0.0]), (10, good)]
    how = dict(k=3, rounds=2, dim=3, scale=64, seed=1)
    found = run(spark, rows, **how)
    assert found == brute(rows, **how)
    assert sorted((r[0] for r in found), key=str) == [1, 1, 1, 10, 8, None]


def test_fewer_vectors_than_centroids_and_none(spark):
    assert [r[1:4] for r in run(spark, [(1, [0.5, 1.0])], k=16, dim=2)] == [(0, 0, 0)]
    assert run(spark, [], k=16, dim=2) == []
    assert run(spark, [(1, None), (None, [1.0])], k=16, dim=2) == []


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    how = dict(k=6, rounds=3, dim=3, scale=64, seed=1)
    again, centroids = cluster(table(spark, rows[::-1]).repartition(7), Scratch(spark), **how)
    assert sorted((tuple(r) for r in summary(again, centroids).collect()), key=str) == run(spark, rows, **how)
