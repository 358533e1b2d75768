"""Nearest place within a radius (J4, J5) as a grid-cell equi-join.

No cross join: every place is copied into the 3x3 block of cells around it, every
point looks up its own cell, and only those candidate pairs are measured. Cells are
``radius`` high (in degrees of latitude); a latitude band is cut into a whole number of
cells, each wide enough in longitude to cover the radius at the band's highest latitude,
and the last cell of a band borders on its first (longitude 180). Bands that reach a
pole are one cell. So any pair within the radius shares a cell. The nearest candidate per point is a grouped ``min`` over
(distance, place order) over a left join, so points without a candidate still get
their (null) row; partial aggregation, no sort of all candidates. Identical
coordinates are collapsed on both sides first (see ``nearest``), so piles of copies do
not multiply the pairs in a cell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlattice.constants import EARTH_RADIUS_KM, NEAREST_RADIUS_KM
from airlattice.functions.geo import haversine

KM_PER_DEG = EARTH_RADIUS_KM * math.pi / 180.0


def _cell_h(radius_km: float) -> float:
    return radius_km / KM_PER_DEG * 1.01


def _columns(band: Column, h: float) -> Column:
    """Number of cells around a latitude band; one where the band or its neighbour
    touches a pole."""
    edge = F.greatest(F.abs(band * h), F.abs((band + 1) * h)) + F.lit(h)
    w = F.lit(h * 1.01) / F.cos(F.radians(F.least(F.lit(89.0), edge)))
    return F.when(edge >= 89.0, F.lit(1)).otherwise(F.greatest(F.lit(1), F.floor(360.0 / w))).cast("long")


def _column(lon: Column, n: Column) -> Column:
    """Cell of a longitude (any range) among ``n`` around the band."""
    turn = F.pmod(lon + F.lit(180.0), F.lit(360.0)) / 360.0
    return F.least(F.floor(turn * n), n - 1).cast("long")


def nearest(points: DataFrame, places: DataFrame, point_key: str, place_key: str,
            radius_km: float = NEAREST_RADIUS_KM, keep: list[str] | None = None,
            lat: str = "lat", lon: str = "lon") -> DataFrame:
    """For every point, the closest place within ``radius_km`` (first by ``place_key``
    on equal distance), or nulls. Returns point_key, place_key, dist_km, *keep."""
    keep = keep or []
    h = _cell_h(radius_km)
    # Copies first: of places sharing a coordinate only the lowest key can win (ties go
    # to the lower key), and points sharing a coordinate share the answer. Both sides
    # are reduced with partial aggregation before any pairing, so a pile of identical
    # coordinates never multiplies the candidate pairs.
    places = (places.groupBy(F.col(lat).alias("_qlat"), F.col(lon).alias("_qlon"))
                    .agg(F.min(F.struct(F.col(place_key).alias("k"), *[F.col(c).alias(c) for c in keep]))
                         .alias("_p"))
                    .select(F.col("_p.k").alias(place_key), "_qlat", "_qlon",
                            *[F.col(f"_p.{c}").alias(c) for c in keep]))
    coords = points.select(F.col(lat).alias("_plat"), F.col(lon).alias("_plon")).distinct()
    pband = F.floor(F.col("_plat") / h)
    pts = coords.withColumn("_ci", pband)
    pts = pts.withColumn("_cj", _column(F.col("_plon"), _columns(F.col("_ci"), h)))

    d = F.array(F.lit(-1), F.lit(0), F.lit(1))
    plc = places.withColumn("_di", F.explode(d)).withColumn("_ci", F.floor(F.col("_qlat") / h) + F.col("_di"))
    plc = plc.withColumn("_n", _columns(F.col("_ci"), h)).withColumn("_j", _column(F.col("_qlon"), F.col("_n")))
    # neighbours wrap around the band; in a band of one or two cells they coincide
    around = F.array_distinct(F.array(*[F.pmod(F.col("_j") + k, F.col("_n")) for k in (-1, 0, 1)]))
    plc = plc.withColumn("_cj", F.explode(around)).drop("_di", "_n", "_j")

    # left join: a coordinate with no place in its cells still yields one (null) row, so
    # the per-coordinate minimum below covers every coordinate
    cand = pts.join(plc, on=["_ci", "_cj"], how="left")
    dist = haversine("_plat", "_plon", "_qlat", "_qlon")
    within = F.col(place_key).isNotNull() & (dist <= radius_km)
    best = cand.groupBy("_plat", "_plon").agg(F.min(F.when(within, F.struct(
        F.round(dist, 9).alias("d9"), F.col(place_key).alias("k"), dist.alias("d"),
        *[F.col(c).alias(c) for c in keep]))).alias("_b"))
    pts_all = points.select(point_key, F.col(lat).alias("_plat"), F.col(lon).alias("_plon"))
    # null-safe: a point without coordinates gets no place
    out = pts_all.join(best, on=[pts_all["_plat"].eqNullSafe(best["_plat"]),
                                 pts_all["_plon"].eqNullSafe(best["_plon"])], how="left")
    return out.select(point_key, F.col("_b.k").alias(place_key), F.col("_b.d").alias("dist_km"),
                      *[F.col(f"_b.{c}").alias(c) for c in keep])
