"""Distances on the sphere as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371


def distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance of two points in radians; null if a coordinate is null."""
    half = F.pow(F.sin((lat1 - lat2) / 2), F.lit(2)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lng1 - lng2) / 2), F.lit(2))
    # least() passes over nulls, so they are kept apart
    return F.when(half.isNotNull(), F.asin(F.sqrt(F.least(F.lit(1.0), half))) * 2 * EARTH_KM)


def cells(lat: Column, lng: Column, km: float) -> tuple[Column, Column, Column]:
    """The cube of edge ``km`` that holds a point; points nearer than ``km`` lie in the same or touching cubes."""
    at = lambda v: F.floor(v * (EARTH_KM / km)).cast("int")
    return at(F.cos(lat) * F.cos(lng)), at(F.cos(lat) * F.sin(lng)), at(F.sin(lat))


def radians32(degrees: Column) -> Column:
    """Degrees as single-precision floats, then radians in double precision."""
    return F.radians(degrees.cast("float"))
