"""Exact quantiles of every series in bounded memory (A4, M4 robust).

``percentile`` holds all distinct values of a series in one buffer. Here a wanted rank is narrowed down: the rows of a
series' interval are counted by (series, interval, bin), summed in the tasks first, and the bins that hold wanted ranks are
the next intervals, from their smallest to their largest value. An interval of at most ``BOUND`` rows is sorted, one of a single value
needs no sorting, so neither many rows nor many copies meet in one task. Each round splits an interval's range
by ``BINS``; one or two are usual.

Defined cases: null and NaN values are left out; a series without values has no row in ``quantiles`` and null statistics;
ranks between two rows interpolate linearly; null keys are a series of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.session import cut_lineage

BINS = 512
BOUND = 50_000


def _keyed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on the keys; the right side has one row per series."""
    named = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, same or F.lit(True), how).drop(*[f"_r_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = BINS, bound: int = BOUND) -> DataFrame:
    """keys, n and ``q``, an array of the quantiles of ``value`` at ``probs``."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    spots = [F.col("n").cast("double").__sub__(1) * F.lit(float(p)) for p in probs]
    ranks = F.array_distinct(F.array(*[f(s).cast("long") for s in spots for f in (F.floor, F.ceil)]))
    series = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
                         .where("n > 0"))
    # an interval: the rows before it (base), its row count (size), ends and wanted ranks
    spans = series.select(*keys, F.lit(0).cast("long").alias("base"), F.col("n").alias("size"), "lo", "hi", ranks.alias("ranks"))
    settled = []
    while True:
        wide = spans.where(f"size > {bound} AND lo < hi")
        settled.append(spans.where(f"NOT (size > {bound} AND lo < hi)"))
        if wide.isEmpty():
            break
        half = "(hi / 2 - lo / 2)"
        inside = _within(rows, wide, keys).withColumn("_bin", F.expr(
            f"CASE WHEN {half} > 0 THEN least({bins - 1}, greatest(0, CAST(floor((_v / 2 - lo / 2) / {half} * {bins}) AS INT))) "
            f"WHEN _v > lo THEN {bins - 1} ELSE 0 END"))
        # the largest value has the last bin and the smallest the first, so every round splits
        counted = inside.groupBy(*keys, "base", "_bin").agg(F.count(F.lit(1)).alias("size"), F.min("_v").alias("lo"), F.max("_v").alias("hi"),
                                                            F.first("ranks").alias("ranks"))
        before = F.sum("size").over(Window.partitionBy(*keys, "base").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))
        parts = counted.withColumn("_from", F.col("base") + F.coalesce(before, F.lit(0)))
        held = F.filter("ranks", lambda r: (r >= F.col("_from")) & (r < F.col("_from") + F.col("size")))
        spans = cut_lineage(parts.withColumn("ranks", held).where("size(ranks) > 0").select(
            *keys, F.col("_from").alias("base"), "size", "lo", "hi", "ranks"))
    done = reduce(DataFrame.unionByName, settled)
    single = done.where("lo = hi").select(*keys, F.explode("ranks").alias("rank"), F.col("lo").alias("v"))
    order = F.row_number().over(Window.partitionBy(*keys, "base").orderBy("_v"))
    sorted_ = (_within(rows, done.where("lo < hi"), keys).withColumn("rank", F.col("base") + order - 1)
               .where(F.array_contains("ranks", F.col("rank"))).select(*keys, "rank", F.col("_v").alias("v")))
    found = single.unionByName(sorted_).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_at"))
    out = _keyed(series.select(*keys, "n"), found, keys)

    def value_at(spot):
        low = F.try_element_at("_at", F.floor(spot).cast("long"))
        high = F.try_element_at("_at", F.ceil(spot).cast("long"))
        part = spot - F.floor(spot)
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)
    return out.select(*keys, "n", F.array(*[value_at(s) for s in spots]).alias("q"))


def _within(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """The rows inside the intervals, with their interval: an equi-join on the series, which has at most two disjoint
    intervals per quantile."""
    near = spans.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "base", "lo", "hi", "ranks")
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return rows.join(near, [*same, F.col("_v") >= F.col("lo"), F.col("_v") <= F.col("hi")]).drop(*[f"_r_{k}" for k in keys])


def robust_stats(df: DataFrame, keys: list[str], cols: list[str], bins: int = BINS, bound: int = BOUND) -> DataFrame:
    """A4: ``series.scale_stats`` of the robust scaler (median and quartile distance of each column), for ``series.apply_scale``."""
    out = df.select(*keys).distinct()
    for c in cols:
        q = quantiles(df, keys, c, [0.25, 0.5, 0.75], bins, bound)
        out = _keyed(out, q.select(*keys, F.col("q")[1].alias(f"_a_{c}"), (F.col("q")[2] - F.col("q")[0]).alias(f"_b_{c}")), keys, "left")
    return out
