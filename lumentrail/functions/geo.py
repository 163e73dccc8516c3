"""Positions: distances, grid cells and distance scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def degrees_apart(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in degrees of latitude."""
    return haversine_km(lat1, lng1, lat2, lng2) / KM_PER_DEGREE


def manhattan_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.abs(lat1 - lat2) + F.abs(lng1 - lng2)


def place_key(lat: Column, lng: Column) -> Column:
    """The one key of a place: a cell of a hundredth of a degree (about 1.1 km)."""
    return F.concat_ws(",", F.format_string("%.2f", F.round(lat, 2)), F.format_string("%.2f", F.round(lng, 2)))


def nearness(distance: Column, furthest: Column) -> Column:
    """1 at no distance, one half at the furthest; 1 where nothing is apart."""
    return F.when(furthest > 0, 1 - distance / (2 * furthest)).otherwise(1.0)
