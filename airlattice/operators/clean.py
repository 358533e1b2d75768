"""Cleaning operators: renames, drops, coercion, de-duplication, fills, anti joins.

Covers P1-P5, P13-P16, W3, W7, J2, U1, U5, A2, A3, P15 and the composed pipeline M1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import (AQI_INPUTS, DROP_COLUMNS, DROP_CONTAINING, NON_NUMERIC,
                                  POLLUTANTS, RENAMES)
from airlattice.functions.aqi import aqi
from airlattice.functions.stats import exact_avg
from airlattice.operators.joins import join_stats


# ---------------------------------------------------------------- P1 / P2 / P4 / P5
def rename(df: DataFrame) -> DataFrame:
    """Canonical column names; unknown names are left alone."""
    present = {k: v for k, v in RENAMES.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def drop_unneeded(df: DataFrame) -> DataFrame:
    """Drop any column whose name contains 'weather', plus a fixed list."""
    doomed = [c for c in df.columns if DROP_CONTAINING in c] + [c for c in DROP_COLUMNS if c in df.columns]
    return df.drop(*doomed) if doomed else df


def coerce(df: DataFrame, cols: list[str]) -> DataFrame:
    """Numeric coercion; unparsable text becomes null (try_cast, ANSI-safe)."""
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in cols})


def to_ts(c) -> Column:
    """P5: epoch seconds (any type) -> timestamp; bad values -> null."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_seconds(col.try_cast("bigint"))


# ---------------------------------------------------------------- P13 / P14
def drop_null_columns(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Drop columns with no non-null value (one aggregation pass, tiny result)."""
    keep = set(keep or [])
    cand = [c for c in df.columns if c not in keep]
    if not cand:
        return df
    counts = df.agg(*[F.count(F.col(c)).alias(c) for c in cand]).first().asDict()
    return df.drop(*[c for c in cand if counts[c] == 0])


def null_column_flags(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """P13 per group: one row per key with ``<col>_present`` booleans."""
    return df.groupBy(*keys).agg(*[(F.count(F.col(c)) > 0).alias(f"{c}_present") for c in cols])


def drop_null_rows(df: DataFrame, cols: list[str], how: str = "all") -> DataFrame:
    """Drop rows whose value columns are all null (``how='all'``) or any null."""
    return df.dropna(how=how, subset=cols)


# ---------------------------------------------------------------- W3 / W7
def _order_key(order) -> Column:
    """Sort key for "latest": a struct of (is-not-null, value) per order column, so a
    null order ranks lowest and the struct itself is never null."""
    order = [order] if isinstance(order, str) else list(order)
    return F.struct(*[x for o in order for x in (F.col(o).isNotNull().alias(f"_nn_{o}"), F.col(o).alias(f"_v_{o}"))])


def latest_per_key(df: DataFrame, keys: list[str], order) -> DataFrame:
    """One row per key: the row with the largest ``order`` value(s).

    An aggregation (``max_by``), not a window: map-side partial aggregation keeps one
    candidate per key per task before the shuffle, so a hot key whose copies make up a
    large share of the data never lands whole in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in rest]), _order_key(order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def dedup_keep_last(df: DataFrame, keys: list[str], order) -> DataFrame:
    """One row per natural key (sensor, time), the last ingested (largest ``order``)."""
    return latest_per_key(df, keys, order)


def collapse_identical(df: DataFrame, group_keys: list[str], value_cols: list[str],
                       order) -> DataFrame:
    """Rows identical on every value column collapse to the latest one.

    Reproduces the reference's full-row de-duplication (different hours with the same
    readings keep only the later hour); opt-in, see D1. Nulls compare equal, as in
    pandas.
    """
    return latest_per_key(df, group_keys + value_cols, order)


# ---------------------------------------------------------------- J2 / U1 / U5
def common_columns(new: DataFrame, old: DataFrame) -> list[str]:
    """Columns of ``new`` that ``old`` also has, in ``new``'s order."""
    return [c for c in new.columns if c in old.columns]


def unseen(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``old`` (null-safe), all their columns.

    Only the key columns of ``old`` are read, so the anti join ships keys alone.
    """
    known = old.select(*[F.col(k).alias(f"_old_{k}") for k in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_old_{k}")) for k in keys])
    return new.join(known, cond, "left_anti")


def new_rows(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is absent from ``old`` (null-safe), common columns."""
    return unseen(new, old, keys).select(*common_columns(new, old))


def reconcile(local: DataFrame, stored: DataFrame, keys: list[str], units: list[str],
              job: str = "fetch") -> tuple[DataFrame, DataFrame]:
    """The stored rows that the local copy lacks (by key, null-safe), and an outcome
    per unit of either side: 'done' if it gains rows, else 'skipped'."""
    missing = unseen(stored, local, keys)
    both = local.select(*units).unionByName(stored.select(*units))
    return missing, outcomes(both, missing, units, job)


def merge_snapshots(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Concatenate two copies of a store; per key the second copy's row wins."""
    both = union_sparse(first.withColumn("_src", F.lit(0)), second.withColumn("_src", F.lit(1)))
    return dedup_keep_last(both, keys, "_src").drop("_src")


def union_sparse(*frames: DataFrame) -> DataFrame:
    """Union by name, columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# ---------------------------------------------------------------- A2 / A3 / P15
def fill_mean(df: DataFrame, keys: list[str], cols: list[str], scale: int | None = None) -> DataFrame:
    """A2: nulls take the mean of their column within the series.

    The means are a grouped aggregate, combined before the shuffle and joined back, so a
    series with very many rows never lands whole in one task (the skew join splits it).
    ``scale`` makes the mean order-independent (decimal sum), see ``exact_avg``.
    """
    stats = df.groupBy(*keys).agg(*[exact_avg(c, scale).alias(f"_mean_{c}") for c in cols])
    return join_stats(df, stats, keys).withColumns({c: F.coalesce(F.col(c), F.col(f"_mean_{c}")) for c in cols}) \
        .select(*df.columns)


def fill_and_mask(df: DataFrame, keys: list[str], cols: list[str], masked: list[str], scale: int | None = None) -> DataFrame:
    """A2 then P15 from one grouped aggregate: a filled column is constant exactly when its
    known values are all equal, so both need only mean, least, largest and row count."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *[exact_avg(c, scale).alias(f"_mean_{c}") for c in cols],
                                  *[(F.min(c) == F.max(c)).alias(f"_same_{c}") for c in masked])
    out = join_stats(df, stats, keys)

    def value(c: str) -> Column:
        filled = F.coalesce(F.col(c), F.col(f"_mean_{c}")) if c in cols else F.col(c)
        constant = (F.col("_rows") > 1) & F.coalesce(F.col(f"_same_{c}"), F.lit(False)) if c in masked else F.lit(False)
        return F.when(~constant, filled)
    return out.withColumns({c: value(c) for c in dict.fromkeys([*cols, *masked])}).select(*df.columns)


def fill_mode(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """A3: nulls take the most frequent value of the column (smallest on ties)."""
    out = df
    for c in cols:
        counts = out.filter(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*keys).orderBy(F.col("_n").desc(), F.col(c).asc())
        mode = (counts.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
                      .select(*keys, F.col(c).alias(f"_mode_{c}")))
        out = join_stats(out, mode, keys).withColumn(c, F.coalesce(F.col(c), F.col(f"_mode_{c}"))) \
                                        .drop(f"_mode_{c}")
    return out


def mask_constant(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """A pollutant column whose sample std is 0 within a series (at least two known
    values, all equal) becomes null.

    (The reference fails the whole unit; we null the column and go on.)
    """
    stats = df.groupBy(*keys).agg(*[((F.count(c) > 1) & (F.min(c) == F.max(c))).alias(f"_same_{c}") for c in cols])
    return join_stats(df, stats, keys).withColumns(
        {c: F.when(~F.coalesce(F.col(f"_same_{c}"), F.lit(False)), F.col(c)) for c in cols}).select(*df.columns)


def with_aqi(df: DataFrame) -> DataFrame:
    """A1 on a wide reading frame; absent pollutant columns count as 0."""
    return df.withColumn("aqi", aqi({p: p for p in AQI_INPUTS if p in df.columns}))


# ---------------------------------------------------------------- M1
def process(raw: DataFrame, processed: DataFrame | None, keys: list[str], time_col: str,
            collection: str, order: str, scale: int | None = None) -> DataFrame:
    """M1: the cleaning pipeline over every series at once; returns the rows to append.

    raw/processed carry the series keys; ``order`` is the ingest order of raw rows (a
    column of ``raw``, not returned): of copies of one reading the last ingested stays.
    Copies with equal order keep the one with the largest values, so the result does
    not depend on how rows were read. Steps: union stored and raw rows (a stored row wins
    over raw copies of its reading), rename, drop, trim (W3), coerce, mean-fill, mask
    constant pollutants, AQI (pollution only), keep only the rows that are new (marked at
    the union: no look-up of the store, before or after).
    """
    natural = keys + [time_col]
    df = raw.withColumnRenamed(order, "_order").withColumn("_new", F.lit(True))
    if processed is not None:
        # A stored row wins over raw copies of its reading, so no look-up of the stored keys is needed.
        df = df.select(*[c for c in df.columns if c in processed.columns], "_order", "_new")
        df = union_sparse(processed.withColumn("_new", F.lit(False)), df)
    df = drop_unneeded(rename(df)).withColumn("_kept", ~F.col("_new"))
    values = [c for c in df.columns if c not in set(natural + ["_order", "_new", "_kept"])]
    df = dedup_keep_last(df, natural, ["_kept", "_order", *values]).drop("_order", "_kept")
    value_cols = [c for c in df.columns if c not in set(natural + NON_NUMERIC + ["_new"])]
    df = coerce(df, value_cols)
    df = drop_null_rows(df, value_cols, "all")
    pols = [p for p in POLLUTANTS if p != "aqi" and p in df.columns]
    df = fill_and_mask(df, keys, value_cols, pols, scale)
    if collection != "weather":
        df = with_aqi(df)
    return df.filter("_new").drop("_new")


def outcomes(raw: DataFrame, appended: DataFrame, keys: list[str], job: str) -> DataFrame:
    """M1 outcome per unit: 'done' when rows were appended, 'skipped' when the unit had
    raw rows but nothing new. (Failures are per-job in a Spark plan: an exception fails
    the job, not one unit.) Output: job, keys, outcome - ready for ``evaluate.tally``."""
    units = raw.select(*keys).distinct()
    wrote = appended.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = units.alias("u").join(wrote.alias("w"), [F.col(f"u.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys], "left")
    return j.select(F.lit(job).alias("job"), *[F.col(f"u.{k}") for k in keys],
                    F.when(F.col("_n") > 0, "done").otherwise("skipped").alias("outcome"))
