"""Great-circle distance as column expressions, and circle predicates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellmob.schema import Area

EARTH_RADIUS_KM = 6371  # fixed value: results depend on it

# Widens a bounding box so that rounding can never exclude a point of the circle.
_BOX_MARGIN_DEG = 1e-6


def chord_sine_to_km(sine: Column) -> Column:
    """Kilometres from the sine of half the angle between two points."""
    return F.lit(EARTH_RADIUS_KM) * (F.lit(2) * F.asin(sine))


def cos_degrees(degrees: Column) -> Column:
    return F.cos(F.radians(degrees))


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Distance in km between two points given as columns (or numbers) in degrees."""
    lat1, lng1, lat2, lng2 = (x if isinstance(x, Column) else F.lit(float(x))
                              for x in (lat1, lng1, lat2, lng2))
    sin_lat = F.sin(F.radians(lat2 - lat1) / 2)
    sin_lng = F.sin(F.radians(lng2 - lng1) / 2)
    return chord_sine_to_km(F.sqrt(
        F.pow(sin_lat, F.lit(2.0))
        + F.pow(sin_lng, F.lit(2.0)) * cos_degrees(lat1) * cos_degrees(lat2)))


def bounding_box(area: Area, lat="lat", lng="lng") -> Column:
    """Comparisons with constants that every point of the circle satisfies.

    Unlike the distance itself they reach the Parquet reader and skip row groups.
    Coordinates outside the usual degree ranges are let through: the distance is
    periodic in them, and the exact test decides.
    """
    lat, lng = F.col(lat), F.col(lng)
    angle = area.radius_km / EARTH_RADIUS_KM
    d_lat = math.degrees(angle) + _BOX_MARGIN_DEG
    odd = (lat > 90.0) | (lat < -90.0) | (lng > 180.0) | (lng < -180.0)
    box = (lat >= area.lat - d_lat) & (lat <= area.lat + d_lat)
    if abs(area.lat) + d_lat < 90:
        d_lng = math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(area.lat))))
        west, east = area.lng - d_lng - _BOX_MARGIN_DEG, area.lng + d_lng + _BOX_MARGIN_DEG
        if -180 <= west and east <= 180:
            box = box & (lng >= west) & (lng <= east)
    return box | odd


def in_area(area: Area, lat="lat", lng="lng") -> Column:
    """True inside the circle, by the unrounded distance."""
    return bounding_box(area, lat, lng) & (
        haversine(F.col(lat), F.col(lng), area.lat, area.lng) <= F.lit(float(area.radius_km)))
