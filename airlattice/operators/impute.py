"""Imputation by nearest rows (M5, J11, W6, A3, A8, A14) without a pair product.

Exact K nearest neighbours of every row with a missing target, over numeric, categorical
or mixed attributes. Candidates are dealt to the leaves of a tree of pivots that grows with
their number (``operators/pivots``); a query first searches its nearest leaves until they hold
K rows, which bounds its K-th distance, and then only those leaves that the triangle inequality
leaves possible. Leaves are dealt in blocks and queries in blocks too, so a task holds
two bounded blocks, compares them with numpy and emits at most K rows per query, none beyond its bound. The
number of visited leaves follows the data, not 3^d cells: for attributes without structure it grows
to all of them, which is the query set against all rows in blocks. The weighted Hamming
distance is no metric, so it always visits all.

Duplicates are pre-aggregated: of rows with identical attributes only the K + 1
lowest ids can ever be chosen (ties go to the lower id), so a hot group of identical
rows shrinks to K + 1 candidates; its salts follow its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import KNN_MISSING_THRESHOLD
from airlattice.functions import distance as D
from airlattice.functions.grouped import groups
from airlattice.operators.pivots import VECTORS, PivotTree, arrays, widen
from airlattice.session import cut_lineage

METHODS = ("mean", "median", "mode")
PIVOTS = 256          # children of a node of the tree at most; about sqrt(n) / 2 for fewer rows
BLOCK = 2048          # candidates, and queries, of a block
LEAF = 4 * BLOCK      # a node of more rows gets pivots of its own
COPIES = 50_000       # identical rows ordered in one task


def _check(n: int, k: int, how: str, numeric_target: bool, metric: str, categorical: str) -> bool:
    """A14 guards: False when there are too few rows (no imputation); bad arguments
    raise ValueError."""
    if how not in METHODS:
        raise ValueError(f"unknown fill {how!r}; one of {', '.join(METHODS)}")
    if not numeric_target and how != "mode":
        raise ValueError("a target that is not numeric can only be filled by its mode")
    if metric not in D.NUMERIC:
        raise ValueError(f"unknown numeric distance {metric!r}; one of {', '.join(D.NUMERIC)}")
    if categorical not in D.CATEGORICAL:
        raise ValueError(f"unknown categorical distance {categorical!r}; one of {', '.join(D.CATEGORICAL)}")
    if n < 3:
        return False
    if k > n or k < 1:
        raise ValueError(f"k must lie between 1 and the {n} rows, not {k}")
    return True


def _lowest_ids(df: DataFrame, group: list[str], order: str, k: int) -> DataFrame:
    """Keep the ``k`` lowest ``order`` rows of each group: per salt first, then over the
    survivors. A group has a salt per ``COPIES`` rows, so no task orders more."""
    sizes = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / COPIES).cast("long").alias("_salts"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group]
    salted = df.alias("l").join(sizes.alias("r"), same).select("l.*", F.pmod(F.xxhash64(order), F.col("r._salts")).alias("_salt"))
    w1 = Window.partitionBy(*group, "_salt").orderBy(order)
    first = salted.withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k).drop("_r", "_salt")
    w2 = Window.partitionBy(*group).orderBy(order)
    return first.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k).drop("_r")


class Mixed:
    """Distance of one row to many: numeric, categorical, or both weighted by their counts.

    Rows are three arrays: numbers, category codes, and the relative frequency of each
    category (used by the weighted Hamming distance only).
    """

    def __init__(self, n_num: int, n_cat: int, metric: str, categorical: str):
        self.n_num, self.n_cat, self.metric, self.categorical = n_num, n_cat, metric, categorical
        self.is_metric = not n_cat or categorical != "weighted-hamming"

    def __call__(self, q: tuple, rows: tuple) -> np.ndarray:
        num = cat = 0.0
        if self.n_num:
            gap = rows[0] - q[0]
            num = np.sqrt((gap * gap).sum(1)) if self.metric == "euclidean" else np.abs(gap).sum(1)
        if self.n_cat:
            same = rows[1] == q[1]
            m, d = float(self.n_cat), (~same).sum(1).astype(float)
            if self.categorical == "hamming":
                cat = d / m
            elif self.categorical == "jaccard":
                cat = 2.0 * d / (m + d)
            elif self.categorical == "euclidean":
                cat = np.sqrt(2.0 * d)
            else:
                cat = m / (1.0 / np.where(same, rows[2], 1.0)).sum(1)
        if self.n_num and self.n_cat:
            return (num * self.n_num + cat * self.n_cat) / (self.n_num + self.n_cat)
        return num if self.n_num else cat


def _rows(df: DataFrame, id_col: str, target: str, numeric: list[str], categorical: list[str], stats) -> DataFrame:
    """id, target, numbers (missing ones at the mean; scaled when mixed), category codes
    (missing ones at the mode) and the categories' relative frequencies."""
    out = df.select(id_col, target, *numeric, *categorical)
    nums = []
    for a in numeric:
        x = F.coalesce(F.col(a).cast("double"), F.lit(stats[f"mean_{a}"]), F.lit(0.0))
        if categorical:
            spread = (stats[f"max_{a}"] or 0.0) - (stats[f"min_{a}"] or 0.0)
            x = (x - F.lit(stats[f"mean_{a}"] or 0.0)) / F.lit(spread) if spread else F.lit(0.0)
        nums.append(x)
    codes, freqs = [], []
    for a in categorical:
        counts = out.filter(F.col(a).isNotNull()).groupBy(F.col(a).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        mode = counts.orderBy(F.col("_n").desc(), F.col("_v")).first()
        value = F.coalesce(F.col(a), F.lit(mode["_v"] if mode else None))
        out = out.withColumn(a, value)
        share = relative_frequency(out, a, f"_f_{a}").withColumnRenamed(a, f"_v_{a}")
        out = out.join(share, F.col(a).eqNullSafe(F.col(f"_v_{a}")), "left").drop(f"_v_{a}")
        codes.append(F.xxhash64(F.col(a).cast("string")))
        freqs.append(F.col(f"_f_{a}"))
    empty = F.array().cast("array<double>")
    return out.select(id_col, target, (F.array(*nums) if nums else empty).alias("_num"),
                      (F.array(*codes) if codes else F.array().cast("array<bigint>")).alias("_cat"),
                      (F.array(*freqs) if freqs else empty).alias("_freq"))


def knn(df: DataFrame, id_col: str, target: str, attrs: list[str], k: int, how: str = "mean",
        metric: str = "euclidean", threshold: float = KNN_MISSING_THRESHOLD, out: str | None = None,
        categorical: list[str] = (), categorical_metric: str = "jaccard") -> DataFrame:
    """M5: fill null ``target`` values from the K nearest rows.

    ``attrs`` are numeric attributes, ``categorical`` the others; with both, numbers are
    scaled by their range and the two distances are weighted by their attribute counts
    (H15). A row stays null when at least ``threshold * k`` of its neighbours are missing
    the target too. Returns ``df`` with ``out`` (default: ``target``) filled.
    """
    out, categorical = out or target, list(categorical)
    numeric_target = df.schema[target].dataType.typeName() in ("integer", "long", "double", "float", "short", "byte", "decimal")
    # one-row statistics (bounded: 3 numbers per attribute)
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(a).cast("double")).alias(f"{name}_{a}") for a in attrs
                                                  for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]).first()
    if not _check(stats["n"], k, how, numeric_target, metric, categorical_metric):
        return df.withColumn(out, F.col(target))
    resolved = _neighbours(_rows(df, id_col, target, attrs, categorical, stats), id_col, target, k,
                           Mixed(len(attrs), len(categorical), metric, categorical_metric))
    asked = {"mean": [F.avg("_t").alias("_mean")], "median": [F.median("_t").alias("_median")]}.get(how, []) \
        if numeric_target else []
    agg = resolved.groupBy(id_col).agg(F.count_if(F.col("_t").isNull()).alias("_missing"), *asked)
    if how == "mode":
        # most frequent neighbour value, smallest on ties (at most k rows per query)
        counts = resolved.filter(F.col("_t").isNotNull()).groupBy(id_col, "_t").agg(F.count(F.lit(1)).alias("_n"))
        wm = Window.partitionBy(id_col).orderBy(F.col("_n").desc(), F.col("_t").asc())
        modes = (counts.withColumn("_r", F.row_number().over(wm)).filter("_r = 1")
                       .select(id_col, F.col("_t").alias("_mode")))
        agg = agg.join(modes, on=id_col, how="left")
    value = F.col(f"_{how}")
    fill = agg.select(id_col, F.when(F.col("_missing") < F.lit(threshold * k), value).alias("_fill"))
    res = df.join(fill, on=id_col, how="left")
    kind = "double" if numeric_target else df.schema[target].dataType
    res = res.withColumn(out, F.coalesce(F.col(target).cast(kind), F.col("_fill").cast(kind)))
    return res.drop("_fill")


def _neighbours(rows: DataFrame, id_col: str, target: str, k: int, distance: Mixed) -> DataFrame:
    """The K nearest other rows of every row without a target: id, _j, _t, _dist."""
    rows = cut_lineage(rows)
    cands = cut_lineage(_lowest_ids(rows, ["_num", "_cat"], id_col, k + 1))
    tree = PivotTree(cands, id_col, distance, k, PIVOTS, BLOCK, LEAF, cut_lineage)
    queries = rows.filter(F.col(target).isNull()).select(id_col, *VECTORS)
    at_first = cut_lineage(tree.nearest(queries.withColumn("_bound", F.lit(None).cast("double"))))
    near = cut_lineage(_search(tree, at_first, target))
    nearest = Window.partitionBy(id_col).orderBy("_dist", "_j")
    bound = (near.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") == k)
             .select(id_col, F.col("_dist").alias("_bound")))
    rest = tree.possible(queries.join(bound, id_col, "left"), at_first)
    both = near.unionByName(_search(tree, cut_lineage(rest), target))
    return cut_lineage(both.withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k).drop("_r"))


def _search(tree: PivotTree, asked: DataFrame, target: str) -> DataFrame:
    """The K nearest of every query, and none beyond its bound, in each block of the leaves it visits."""
    id_col, k, distance = tree.id_col, tree.k, tree.distance
    kinds = {f.name: f.dataType.simpleString() for f in tree.dealt.schema.fields}
    load = asked.groupBy("_p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("_q")).join(
        tree.leaves.select("_p", F.ceil(F.col("_n") / BLOCK).cast("long").alias("_b")), "_p")
    asked = asked.join(load, "_p").withColumn("_part", F.pmod(F.xxhash64(F.lit(43), id_col), F.col("_q"))) \
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    held = tree.dealt.join(load, "_p").withColumn("_block", F.pmod(F.xxhash64(id_col), F.col("_b"))) \
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_q") - 1)))
    unit = F.xxhash64("_p", "_block", "_part").alias("_unit")
    keep = [id_col, *VECTORS]
    both = held.select(unit, *keep, target, F.lit(False).alias("_ask"), F.lit(None).cast("double").alias("_bound")).unionByName(
        asked.select(unit, *keep, F.lit(None).cast(kinds[target]).alias(target), F.lit(True).alias("_ask"), "_bound"))

    def compare(frames):
        for pdf in groups(frames, "_unit"):
            ask = pdf["_ask"].to_numpy(bool)
            if ask.all() or not ask.any():
                continue
            has, wants = pdf[~ask], pdf[ask]
            x, q = arrays(has), arrays(wants)
            ids, t = has[id_col].to_numpy(), has[target].to_numpy()
            reach = widen(wants["_bound"].fillna(np.inf).to_numpy(float))
            found = []
            for i, own in enumerate(wants[id_col].to_numpy()):
                d = distance(tuple(a[i] for a in q), x)
                near = np.flatnonzero(d <= reach[i])
                if not len(near):
                    continue
                if len(near) > k + 1:
                    v = d[near]
                    near = near[v <= np.partition(v, k)[k]]      # ties with the last one stay
                order = near[np.lexsort((ids[near], d[near]))][:k + 1]
                order = order[ids[order] != own][:k]
                found.append((i, order, d[order]))
            if not found:
                continue
            of = np.repeat([i for i, _, _ in found], [len(o) for _, o, _ in found])
            at = np.concatenate([o for _, o, _ in found])
            yield pd.DataFrame({id_col: wants[id_col].to_numpy()[of], "_j": ids[at], "_t": t[at],
                                "_dist": np.concatenate([v for _, _, v in found])})
    ordered = both.repartition("_unit").sortWithinPartitions("_unit")
    return ordered.mapInPandas(compare, f"`{id_col}` {kinds[id_col]}, _j {kinds[id_col]}, _t {kinds[target]}, _dist double")


def relative_frequency(df: DataFrame, col: str, alias: str | None = None) -> DataFrame:
    """Share of rows holding each value of ``col``: value, frequency.

    Per-value counts are a partial aggregation and the total is one number, counted first;
    no value list is gathered in one task, however many values the column has."""
    total = float(df.count())
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(col, (F.col("_n") / F.lit(total)).alias(alias or f"{col}_freq"))
