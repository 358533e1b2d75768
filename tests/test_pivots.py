import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlattice.operators import impute
from airlattice.operators.pivots import PivotTree
from airlattice.session import cut_lineage


def _nearest(x, cats, i, k, n_num, n_cat):
    def distance(j):
        num = math.dist(x[i], x[j])
        if not n_cat:
            return num
        d = sum(p != q for p, q in zip(cats[i], cats[j]))
        return (num * n_num + 2.0 * d / (n_cat + d) * n_cat) / (n_num + n_cat)
    return sorted((distance(j), j) for j in range(len(x)) if j != i)[:k]


def _rows(spark, x, cats, asked, base):
    rows = [(base + i, None if i in asked else float(i), [float(v) for v in x[i]], [int(c) for c in cats[i]], [0.5] * len(cats[i]))
            for i in range(len(x))]
    return spark.createDataFrame(rows, "id long, t double, _num array<double>, _cat array<bigint>, _freq array<double>")


@pytest.mark.parametrize("n_cat", [0, 2])
def test_several_levels_equal_brute_force(spark, monkeypatch, n_cat):
    """Clusters, a heap of copies and a point far away, in a tree of several levels; ids above 2^53."""
    monkeypatch.setattr(impute, "PIVOTS", 4)
    monkeypatch.setattr(impute, "BLOCK", 16)
    monkeypatch.setattr(impute, "LEAF", 24)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 0.2, (120, 2)) for c in (0.0, 3.0, 9.0)] + [np.full((60, 2), 3.0), [[500.0, 500.0]]])
    cats = rng.integers(0, 3, (len(x), n_cat))
    asked, base, k = set(range(0, len(x), 12)) | {len(x) - 1}, 2 ** 53 + 1, 4
    df = _rows(spark, x, cats, asked, base)
    trees = []
    monkeypatch.setattr(impute, "PivotTree", lambda *a: trees.append(PivotTree(*a)) or trees[-1])
    found = {}
    for r in impute._neighbours(df, "id", "t", k, impute.Mixed(2, n_cat, "euclidean", "jaccard")).collect():
        found.setdefault(r.id - base, []).append((r._dist, r._j - base))
    assert len(trees[0].levels) >= 2
    assert set(found) == asked
    for i in asked:
        want = _nearest(x, cats, i, k, 2, n_cat)
        assert [j for _, j in sorted(found[i])] == [j for _, j in want], i


def test_visited_share_falls_with_the_rows(spark):
    """Points of a plane: of eight times the rows a query is compared with a smaller share."""
    shares, depth = [], []
    for n in (600, 4800):
        x = np.random.default_rng(2).uniform(0, 1, (n, 2))
        rows = cut_lineage(_rows(spark, x, np.zeros((n, 0), int), set(), 0))
        tree = PivotTree(rows, "id", impute.Mixed(2, 0, "euclidean", "jaccard"), 3, 8, 64, 64, cut_lineage)
        q = rows.where("id % 60 = 0").select("id", "_num", "_cat", "_freq")
        first = cut_lineage(tree.nearest(q.withColumn("_bound", F.lit(None).cast("double"))))
        asked = [r.id for r in q.collect()]
        bound = spark.createDataFrame([(i, float(sorted(np.hypot(*(x - x[i]).T))[3])) for i in asked], "id long, _bound double")
        rest = tree.possible(q.join(bound, "id"), first)
        visits = first.select("_p").unionByName(rest.select("_p")).join(tree.leaves, "_p")
        shares.append(visits.agg(F.sum("_n")).first()[0] / (n * len(asked)))
        depth.append(len(tree.levels))
        assert tree.leaves.agg(F.sum("_n")).first()[0] == n
        assert tree.dealt.groupBy("_p").count().join(tree.leaves, "_p").where("count <> _n").isEmpty()
    assert depth[1] > depth[0]
    assert shares[1] < 0.6 * shares[0], shares


def test_rows_that_no_pivot_tells_apart(spark, monkeypatch):
    """All rows equally far from each other: nodes stay large, the depth ends, results stay whole."""
    monkeypatch.setattr(impute, "PIVOTS", 2)
    monkeypatch.setattr(impute, "BLOCK", 8)
    monkeypatch.setattr(impute, "LEAF", 8)
    n = 60
    cats = np.arange(n)[:, None]
    df = _rows(spark, np.zeros((n, 0)), cats, {0, 30, 59}, 0)
    got = {}
    for r in impute._neighbours(df, "id", "t", 3, impute.Mixed(0, 1, "euclidean", "hamming")).collect():
        got.setdefault(r.id, []).append(r._j)
    assert {i: sorted(v) for i, v in got.items()} == {0: [1, 2, 3], 30: [0, 1, 2], 59: [0, 1, 2]}


def test_a_task_emits_visits_in_bounded_frames():
    """Every row visits every node: the visits leave the task whole, but in frames of bounded size."""
    import pandas as pd

    from airlattice.operators import pivots

    class Captured:
        def mapInPandas(self, task, schema):
            return task

    tree = object.__new__(PivotTree)
    n, nodes, dim = 3000, 64, 8
    rng = np.random.default_rng(3)
    empty = np.zeros((nodes, 0))
    tree.id_col, tree.block, tree.levels, tree.ask_schema = "id", 512, [], ""
    tree.distance = impute.Mixed(dim, 0, "euclidean", "jaccard")
    tree.top, tree.count = (rng.normal(size=(nodes, dim)), empty.astype(np.int64), empty), np.ones(nodes, np.int64)
    tree.inner, tree.outer = np.zeros(nodes), np.ones(nodes)
    rows = pd.DataFrame({"id": np.arange(n) + 2 ** 53 + 1, "_num": list(rng.normal(size=(n, dim))), "_cat": [np.zeros(0, np.int64)] * n,
                         "_freq": [np.zeros(0)] * n, "_bound": [None] * n})
    task = tree._from_top(Captured(), lambda d, bound, n, inner, outer: np.ones_like(d, bool))
    seen, largest = set(), 0
    for frame in task(iter([rows])):
        largest = max(largest, len(frame))
        seen |= set(zip(frame["id"].tolist(), frame["_p"].tolist()))
    assert len(seen) == n * nodes and largest <= pivots.VISITS < n * nodes
