"""Distance, coordinates and request parameters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspark.functions.text import col

EARTH_RADIUS_KM = 6371.0088
KM_PER_LATITUDE_DEGREE = 110.574
KM_PER_LONGITUDE_DEGREE = 111.320


def _value(v) -> Column:
    return F.lit(float(v)) if isinstance(v, (int, float)) else col(v)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b, c, d = map(_value, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin(F.radians(c - a) / 2), F.sin(F.radians(d - b) / 2)
    h = half_lat * half_lat + F.cos(F.radians(a)) * F.cos(F.radians(c)) * half_lon * half_lon
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))


def valid_coordinates(latitude, longitude) -> Column:
    # Spark orders NaN above every number, so the range test also refuses it.
    return F.coalesce(col(latitude).between(-90, 90) & col(longitude).between(-180, 180), F.lit(False))


def parse_coordinate(text) -> Column:
    number = F.btrim(col(text)).try_cast("double")
    return F.when(F.btrim(col(text)).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), number)


def radius_km(text, fallback: float = 10.0, maximum: float = 300.0) -> Column:
    number = parse_coordinate(text)
    return F.when(number > 0, F.least(number, F.lit(maximum))).otherwise(F.lit(fallback))


def page_number(text) -> Column:
    number = parse_coordinate(text)
    return F.when(number > 0, F.floor(number)).otherwise(F.lit(1)).cast("long")


def page_size(text, default: int = 48, maximum: int = 100) -> Column:
    number = parse_coordinate(text)
    return F.when(number > 0, F.least(F.floor(number), F.lit(maximum))).otherwise(F.lit(default)).cast("long")


def bounding_box(latitude: float, longitude: float, radius: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) of a plain range filter the scan can use."""
    d_lat = radius / KM_PER_LATITUDE_DEGREE
    d_lon = radius / max(KM_PER_LONGITUDE_DEGREE * math.cos(math.radians(latitude)), 0.01)
    return (max(-90.0, latitude - d_lat), min(90.0, latitude + d_lat),
            max(-180.0, longitude - d_lon), min(180.0, longitude + d_lon))


def in_box(latitude, longitude, box) -> Column:
    south, north, west, east = box
    return col(latitude).between(south, north) & col(longitude).between(west, east)


def accept_geocode(latitude, longitude, box=(45.4, 48.5, 26.4, 30.6)) -> Column:
    """Fixed box of the covered country; everything outside is a miss."""
    return F.coalesce(in_box(latitude, longitude, box), F.lit(False))
