"""A tree of pivots over candidate rows, for exact nearest-row searches in a metric.

The top level has at most ``pivots`` nodes, whose pivots travel with the tasks. A node that
holds more than ``leaf`` rows is split by pivots of its own, level by level, so the number of
leaves grows with the rows while no task ever holds more than one node's pivots and one block
of rows. Lower levels are tables (parent, node, pivot, rows, nearest and farthest member)
that meet the rows of their parent in bounded units. A node whose members all lie
equally far from its pivots does not get smaller; the depth is bounded, and such a leaf is searched
block by block like any other.

Rows have ``id_col``, ``_num``, ``_cat`` and ``_freq``; ``distance(row, rows)`` gives the distances
of one row to many.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.functions.grouped import groups

VECTORS = ("_num", "_cat", "_freq")
VECTOR_SCHEMA = "_num array<double>, _cat array<bigint>, _freq array<double>"
SLACK = 1e-9        # distances are rounded, so bounds are widened by this
VISITS = 4096       # rows of a frame that leaves a task: every visit carries the query's vectors
LEVELS = 6          # node numbers of six levels of 256 stay below 2^53, exact as doubles too


def arrays(pdf: pd.DataFrame) -> tuple:
    return tuple(np.array(pdf[c].tolist()).reshape(len(pdf), -1) for c in VECTORS)


def widen(bound):
    return bound * (1 + SLACK) + SLACK


def between(distance, piv: tuple, x: tuple) -> np.ndarray:
    """(rows, pivots) distances."""
    return np.stack([distance(tuple(a[i] for a in piv), x) for i in range(len(piv[0]))], 1)


def visits(pdf: pd.DataFrame, keep: list[str], nodes: np.ndarray, possible, rows: int):
    """A row (``keep``, _p) per row of ``pdf`` and node it visits, in frames of at most ``VISITS`` rows. ``possible`` tells
    the visits of at most ``rows`` rows at once, so a task's memory does not follow the number of visits."""
    for start in range(0, len(pdf), rows):
        some = pdf.iloc[start:start + rows]
        row, node = np.nonzero(possible(some))
        for at in range(0, len(row), VISITS):
            found = some.iloc[row[at:at + VISITS]][keep].reset_index(drop=True)
            found["_p"] = nodes[node[at:at + VISITS]]
            yield found


class PivotTree:
    """``dealt``: the candidates with their leaf ``_p``; ``leaves``: rows per leaf (_p, _n)."""

    def __init__(self, cands: DataFrame, id_col: str, distance, k: int, pivots: int, block: int, leaf: int, cut):
        self.id_col, self.distance, self.k, self.width, self.block, self.leaf = id_col, distance, k, pivots, block, leaf
        self.cut = cut
        kinds = {f.name: f.dataType.simpleString() for f in cands.schema.fields}
        self.id_kind = kinds[id_col]
        self.cand_schema = ", ".join(f"`{c}` {kinds[c]}" for c in cands.columns)
        self.ask_schema = f"`{id_col}` {self.id_kind}, {VECTOR_SCHEMA}, _bound double, _p long"
        self.levels: list[DataFrame] = []
        self._build(cands)

    def _build(self, cands: DataFrame) -> None:
        n = cands.count()
        width = int(min(self.width, max(1, round(n ** 0.5 / 2))))
        # pivots: the candidates of lowest hash, a bounded number
        self.top = arrays(cands.orderBy(F.xxhash64(F.lit(41), self.id_col), self.id_col).limit(width)
                          .select(*VECTORS).toPandas())
        distance, top = self.distance, self.top     # tasks get these, not the tree, which holds tables

        def assign(frames):
            for pdf in frames:
                d = between(distance, top, arrays(pdf))
                pdf["_p"] = d.argmin(1)
                pdf["_pd"] = d.min(1)
                yield pdf
        level = self.cut(cands.mapInPandas(assign, f"{self.cand_schema}, _p long, _pd double"))
        sizes = self.cut(self._sizes(level))
        known = sizes.toPandas().set_index("_p")           # one row per top pivot
        at = range(len(self.top[0]))
        self.count = np.array([known["_n"].get(i, 0) for i in at])
        self.inner = np.array([known["_r0"].get(i, 0.0) for i in at])
        self.outer = np.array([known["_r1"].get(i, 0.0) for i in at])
        done, done_sizes = [], []
        while len(self.levels) + 1 < LEVELS and self.distance.is_metric:
            large = sizes.where(F.col("_n") > self.leaf).select("_p", "_n")
            if large.isEmpty():
                break
            done.append(level.join(large, "_p", "left_anti").select(*level.columns))
            done_sizes.append(sizes.join(large, "_p", "left_anti").select(*sizes.columns))
            inside = level.join(large, "_p").select(*level.columns, "_n")
            pivots = self._choose(inside)

            def deal(pdf, piv):
                d = between(distance, arrays(piv), arrays(pdf))
                pdf = pdf.drop(columns=["_c", "_r0", "_r1", "_n"])
                pdf["_p"], pdf["_pd"] = piv["_c"].to_numpy()[d.argmin(1)], d.min(1)
                yield pdf
            children = pivots.select("*", F.lit(0.0).alias("_r0"), F.lit(0.0).alias("_r1"), F.lit(0).cast("long").alias("_n"))
            level = self.cut(self._meet(inside.drop("_n", "_pd"), children, deal, f"{self.cand_schema}, _p long, _pd double"))
            sizes = self.cut(self._sizes(level))
            self.levels.append(self.cut(pivots.join(sizes.select(F.col("_p").alias("_c"), "_n", "_r0", "_r1"), "_c")))
        for part in done:
            level = level.unionByName(part)
        for part in done_sizes:
            sizes = sizes.unionByName(part)
        self.dealt, self.leaves = level.drop("_pd"), sizes.select("_p", "_n")

    @staticmethod
    def _sizes(level: DataFrame) -> DataFrame:
        return level.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_pd").alias("_r0"), F.max("_pd").alias("_r1"))

    def _choose(self, inside: DataFrame) -> DataFrame:
        """Pivots of every node of ``inside``: its rows of lowest hash, half the root of its rows, at most ``width``."""
        first = Window.partitionBy("_p").orderBy(F.xxhash64(F.lit(47), F.col("_p"), self.id_col), self.id_col)
        ranked = inside.withColumn("_i", F.row_number().over(first)).where(F.col("_i") <= self.width)
        few = F.least(F.lit(self.width), F.greatest(F.lit(2), F.round(F.sqrt("_n") / 2)))
        child = (F.col("_p") + 1) * self.width + F.col("_i") - 1
        return self.cut(ranked.where(F.col("_i") <= few).select("_p", child.cast("long").alias("_c"), self.id_col, *VECTORS))

    def _meet(self, rows: DataFrame, children: DataFrame, act, schema: str) -> DataFrame:
        """The frames of ``act(rows, children)`` in units of one node's children and about a block of its rows.
        Children carry their pivot's own id: a null among the ids would make doubles of them all."""
        id_col, cols = self.id_col, rows.columns
        load = rows.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / self.block).cast("long").alias("_q"))
        dealt = rows.join(load, "_p").withColumn("_part", F.pmod(F.xxhash64(F.lit(43), id_col), F.col("_q")))
        held = children.join(load, "_p").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q") - 1)))
        unit = F.xxhash64("_p", "_part").alias("_unit")
        both = dealt.select(unit, *cols, F.lit(None).cast("long").alias("_c"), F.lit(None).cast("double").alias("_r0"),
                            F.lit(None).cast("double").alias("_r1"), F.lit(None).cast("long").alias("_n")).unionByName(
            held.select(unit, "_p", id_col, *VECTORS, "_c", "_r0", "_r1", "_n"), allowMissingColumns=True)

        def each(frames):
            for pdf in groups(frames, "_unit"):
                # a hash shared by two nodes must not mix them
                for _, one in pdf.groupby("_p", sort=False):
                    is_child = one["_c"].notna().to_numpy()
                    if is_child.all() or not is_child.any():
                        continue
                    yield from act(one[~is_child].drop(columns="_unit").reset_index(drop=True),
                                   one[is_child].astype({"_c": "int64", "_n": "int64"}).reset_index(drop=True))
        return both.repartition("_unit").sortWithinPartitions("_unit").mapInPandas(each, schema)

    def _descend(self, asked: DataFrame, choose) -> DataFrame:
        """From top nodes to leaves: at each level ``choose`` names the children a row visits."""
        distance, block, out = self.distance, self.block, []
        keep = [self.id_col, *VECTORS, "_bound"]

        def act(pdf, piv):
            x = arrays(piv)
            n, inner, outer = (piv[c].to_numpy() for c in ("_n", "_r0", "_r1"))
            yield from visits(pdf, keep, piv["_c"].to_numpy(), lambda some: choose(
                between(distance, x, arrays(some)), some["_bound"].fillna(np.inf).to_numpy(float), n, inner, outer), block)
        for children in self.levels:
            split = children.select("_p").distinct()
            out.append(asked.join(split, "_p", "left_anti").select(*asked.columns))
            asked = self.cut(self._meet(asked.join(split, "_p", "left_semi"), children, act, self.ask_schema))
        for part in out:
            asked = asked.unionByName(part.select(*asked.columns))
        return asked

    def _from_top(self, queries: DataFrame, choose) -> DataFrame:
        distance, top, block = self.distance, self.top, self.block
        count, inner, outer = self.count, self.inner, self.outer
        keep, nodes = [self.id_col, *VECTORS, "_bound"], np.arange(len(count), dtype=np.int64)

        def start(frames):
            for pdf in frames:
                yield from visits(pdf, keep, nodes, lambda some: choose(
                    between(distance, top, arrays(some)), some["_bound"].fillna(np.inf).to_numpy(float), count, inner, outer), block)
        asked = queries.mapInPandas(start, self.ask_schema)
        return self._descend(asked if not self.levels else self.cut(asked), choose)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """A first visit: in every node the nearest children, until they hold K rows besides the query."""
        k = self.k

        def choose(d, bound, n, inner, outer):
            d = np.where(n > 0, d, np.inf)
            near = np.argsort(d, 1, kind="stable")
            held = np.cumsum(n[near], 1)
            take = np.concatenate([np.zeros((len(d), 1), held.dtype), held[:, :-1]], 1) < k + 1
            can = np.zeros(d.shape, bool)
            np.put_along_axis(can, near, take, 1)
            return can & (n > 0)
        return self._from_top(queries, choose)

    def possible(self, queries: DataFrame, seen: DataFrame) -> DataFrame:
        """All leaves that can hold a row within ``_bound`` of a query, without the visits of ``seen``.

        A member lies between ``_r0`` and ``_r1`` from its pivot, so by the triangle inequality at
        least ``d - _r1`` and ``_r0 - d`` from the query."""
        metric = self.distance.is_metric

        def choose(d, bound, n, inner, outer):
            reach = widen(bound)[:, None]
            can = ((d - outer <= reach) & (inner - d <= reach)) if metric else np.ones_like(d, bool)
            return can & (n > 0)
        return self._from_top(queries, choose).join(seen.select(self.id_col, "_p"), [self.id_col, "_p"], "left_anti")
