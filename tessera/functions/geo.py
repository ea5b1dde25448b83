"""Distances and grid cells over latitude/longitude columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean earth radius in metres.
EARTH_RADIUS_M = 6371008.7714
# Fixed value: the geohash alphabet.
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Inside a bounding box; a box whose left edge is east of its right crosses the date line."""
    in_lat = lat.between(bottom, top)
    if left <= right:
        return in_lat & lon.between(left, right)
    return in_lat & ((lon >= left) | (lon <= right))


def tile(lat: Column, lon: Column, zoom: int) -> Column:
    """Web-mercator tile as ``zoom/x/y``."""
    n = 2**zoom
    x = F.floor((lon + 180.0) / 360.0 * n)
    s = F.sin(F.radians(lat))
    y = F.floor((F.lit(0.5) - F.ln((1 + s) / (1 - s)) / (4 * math.pi)) * n)
    clamp = lambda v: F.greatest(F.lit(0), F.least(v, F.lit(n - 1)))
    return F.concat_ws("/", F.lit(str(zoom)), clamp(x).cast("string"), clamp(y).cast("string"))


def geohash(lat: Column, lon: Column, precision: int = 5) -> Column:
    """Geohash cell: interleave the binary digits of the two scaled coordinates."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2

    def scaled(value: Column, span: float, n: int) -> Column:
        cell = F.floor((value + span / 2) / span * 2**n)
        return F.greatest(F.lit(0), F.least(cell, F.lit(2**n - 1))).cast("bigint")

    x, y = scaled(lon, 360.0, lon_bits), scaled(lat, 180.0, lat_bits)
    chars = []
    for k in range(precision):
        digit = F.lit(0).cast("bigint")
        for b in range(5):
            pos = 5 * k + b
            source, width = (x, lon_bits) if pos % 2 == 0 else (y, lat_bits)
            bit = F.shiftright(source, width - 1 - pos // 2).bitwiseAND(F.lit(1))
            digit = digit * 2 + bit
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)
