"""Calendar and cyclic time features (H3-H11) as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airlattice.constants import DAYS_IN_MONTH, QUARTERS_IN_YEAR, SEASON_CODES, SEASONS, SESSION_LABELS
from airlattice.session import cut_lineage


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cyclic(value, max_value: int, digits: int | None = None) -> tuple[Column, Column]:
    """H3: (cos, sin) of 2*pi*value/max. With ``digits`` the result is rounded (and -0
    folded to 0) so that it compares equal across math libraries."""
    angle = (F.lit(2.0) * F.pi() * _c(value).cast("double")) / F.lit(float(max_value))
    c, s = F.cos(angle), F.sin(angle)
    if digits is not None:
        c, s = F.round(c, digits) + F.lit(0.0), F.round(s, digits) + F.lit(0.0)
    return c, s


def time_parts(ts) -> dict[str, Column]:
    """H4: integer calendar parts (day_of_week: Monday = 0; ISO week)."""
    t = _c(ts)
    return {
        "month": F.month(t),
        "day": F.dayofmonth(t),
        "hour": F.hour(t),
        "week_of_year": F.weekofyear(t),
        "day_of_week": F.weekday(t),
        "day_of_year": F.dayofyear(t),
        "quarter": F.quarter(t),
        "days_in_month": F.dayofmonth(F.last_day(t)),
    }


# maxima used by the cyclic encodings of each part
PART_MAX = {
    "month": 12, "day": DAYS_IN_MONTH, "hour": 24, "week_of_year": 52, "day_of_week": 7,
    "day_of_year": 365, "quarter": QUARTERS_IN_YEAR, "days_in_month": DAYS_IN_MONTH,
    "season": QUARTERS_IN_YEAR, "session": len(SESSION_LABELS),
}


def calendar_flags(ts) -> dict[str, Column]:
    """H5/H6: start/end flags, leap year, and the reference's inverted weekend flag
    (0 on Saturday/Sunday, 1 otherwise)."""
    t = _c(ts)
    d = F.to_date(t)
    m = F.month(t)
    last = F.last_day(d)
    y = F.year(t)
    return {
        "is_month_start": F.dayofmonth(t) == 1,
        "is_month_end": d == last,
        "is_quarter_start": (F.dayofmonth(t) == 1) & m.isin(1, 4, 7, 10),
        "is_quarter_end": (d == last) & m.isin(3, 6, 9, 12),
        "is_year_start": (m == 1) & (F.dayofmonth(t) == 1),
        "is_year_end": (m == 12) & (F.dayofmonth(t) == 31),
        "is_leap_year": ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0),
        "is_weekend": F.when(F.weekday(t).isin(5, 6), 0).otherwise(1),
    }


def season(ts) -> Column:
    """H7: season name from (month, day) ranges."""
    t = _c(ts)
    md = F.month(t) * 100 + F.dayofmonth(t)
    expr = None
    for name, (m0, d0), (m1, d1) in SEASONS:
        cond = (md >= m0 * 100 + d0) & (md <= m1 * 100 + d1)
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    return expr


def season_code(ts) -> Column:
    """H7 with fixed codes (autumn 0, spring 1, summer 2, winter 3)."""
    s = season(ts)
    expr = None
    for name, code in SEASON_CODES.items():
        expr = F.when(s == name, code) if expr is None else expr.when(s == name, code)
    return expr


def session_code(ts) -> Column:
    """H8: day session 0..5 from hour bins 0-4-8-12-16-20-24 (right-closed, 0 included)."""
    return F.greatest(F.ceil(F.hour(_c(ts)) / 4) - 1, F.lit(0)).cast("int")


def hour_round(ts, how: str = "current") -> Column:
    """Current (truncate), next (truncate + 1 h) or closest (>= 30 min rounds up)."""
    t = _c(ts)
    if how == "current":
        return F.date_trunc("hour", t)
    if how == "next":
        return F.date_trunc("hour", t) + F.expr("INTERVAL 1 HOUR")
    if how == "closest":
        return F.date_trunc("hour", t + F.expr("INTERVAL 30 MINUTES"))
    raise ValueError(f"unknown rounding {how!r}")


def time_features(df: DataFrame, ts: str, digits: int | None = 9) -> DataFrame:
    """M2: every cyclic encoding and calendar flag in one projection."""
    parts = time_parts(ts)
    parts["season"] = season_code(ts)
    parts["session"] = session_code(ts)
    cols = {}
    for name, col in parts.items():
        c, s = cyclic(col, PART_MAX[name], digits)
        cols[f"{name}_cos"], cols[f"{name}_sin"] = c, s
    cols.update({k: v.cast("int") if k != "is_weekend" else v for k, v in calendar_flags(ts).items()})
    return df.withColumns(cols)


def codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """H9: text columns -> 0-based codes in sorted order of their distinct values; null
    -> -1 (pandas category codes).

    The distinct values are dealt to tasks by range, numbered inside each range, and shifted by
    the sizes of the ranges before it (one number per task): neither the driver nor one
    task ever holds all values. The codes are joined back by value.
    """
    out = df
    for c in cols:
        codes_of = numbered(df.select(c).where(F.col(c).isNotNull()).distinct(), c, f"_{c}_code")
        codes_of = codes_of.withColumnRenamed(c, f"_{c}_value")
        out = out.join(codes_of, F.col(c) == F.col(f"_{c}_value"), "left") \
                 .withColumn(c, F.coalesce(F.col(f"_{c}_code"), F.lit(-1)).cast("int")).drop(f"_{c}_value", f"_{c}_code")
    return out


def numbered(values: DataFrame, col: str, name: str) -> DataFrame:
    """Distinct values of one column with their 0-based place in sorted order."""
    placed = cut_lineage(values.repartitionByRange(col).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)    # one row per task
    shift = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_range").orderBy(col)
    return placed.join(shift, "_range").select(col, (F.row_number().over(inside) - 1 + F.col("_shift")).alias(name))


def local_time(df: DataFrame, ts: str, zone_col: str) -> Column:
    """UTC wall clock -> local wall clock of the row's zone."""
    return F.from_utc_timestamp(F.col(ts), F.col(zone_col))
