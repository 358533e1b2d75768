"""Geographic column functions: great-circle distance, position parsing, border sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlattice.constants import EARTH_RADIUS_KM


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """H1: great-circle distance in km (mean Earth radius)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    dlat = p2 - p1
    dlon = F.radians(_c(lon2)) - F.radians(_c(lon1))
    a = F.pow(F.sin(dlat * 0.5), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon * 0.5), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(a))


def position(c) -> tuple[Column, Column]:
    """P18: "lat,lon" text -> (lat, lon) doubles; unparsable parts -> null."""
    parts = F.split(_c(c), ",")
    return (F.trim(parts.getItem(0)).try_cast("double"),
            F.trim(parts.getItem(1)).try_cast("double"))


def sort_border(points, c_lat, c_lon) -> Column:
    """Sort an array<struct<latitude, longitude>> by angle about a centre."""
    keyed = F.transform(_c(points), lambda p: F.struct(
        F.atan2(p["longitude"] - _c(c_lon), p["latitude"] - _c(c_lat)).alias("angle"),
        p["latitude"].alias("latitude"), p["longitude"].alias("longitude")))
    return F.transform(F.array_sort(keyed), lambda p: F.struct(
        p["latitude"].alias("latitude"), p["longitude"].alias("longitude")))


def centroid(points) -> tuple[Column, Column]:
    """A10: mean latitude / longitude of an array of points (array-local aggregate)."""
    n = F.size(_c(points)).cast("double")
    lat = F.aggregate(_c(points), F.lit(0.0), lambda acc, p: acc + p["latitude"]) / n
    lon = F.aggregate(_c(points), F.lit(0.0), lambda acc, p: acc + p["longitude"]) / n
    return lat, lon
