"""Coordinates: great-circle distance, geohash, web-mercator grid cells, ISO 6709 strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
# fixed values: the alphabet of geohashes
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2.0 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def _steps(value: Column, low: float, span: float, bits: int) -> Column:
    """Which of 2**bits equal parts of a range a value is in; the range's end belongs to the last."""
    n = float(1 << bits)
    return F.least(F.greatest(F.floor((value - low) / span * n), F.lit(0)), F.lit(int(n) - 1)).cast("long")


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """The geohash of a point: bits of longitude and latitude in turn, longitude first. Null without both."""
    total = 5 * precision
    x, y = _steps(lon, -180.0, 360.0, (total + 1) // 2), _steps(lat, -90.0, 180.0, total // 2)
    letters = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for b in range(5 * k, 5 * k + 5):
            axis, left = (x, (total + 1) // 2 - 1 - b // 2) if b % 2 == 0 else (y, total // 2 - 1 - b // 2)
            code = code * 2 + F.shiftright(axis, left).bitwiseAND(F.lit(1))
        letters.append(F.substring(F.lit(BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.concat(*letters))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """A point's place in the unit square of the web map, y from the north; latitudes beyond the map are its edge."""
    s = F.sin(F.radians(lat))
    y = 0.5 - 0.25 * F.log((1 + s) / (1 - s)) / F.lit(3.141592653589793)
    y = F.when(lat >= 90, 0.0).when(lat <= -90, 1.0).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)))
    return lon / 360.0 + 0.5, y


def iso6709(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a string like +34.0522-118.2437/; nulls if it is none."""
    number = r"[0-9]+(?:\.[0-9]*)?"
    part = lambda k: F.expr("try_cast(null as double)") if k is None else F.nullif(F.regexp_extract(text, rf"^[^0-9+-]*([+-]?{number})([+-]{number})(?:[+/-].*|[^0-9.].*)?$", k), F.lit("")).try_cast("double")
    return part(1), part(2)
