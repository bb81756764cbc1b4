"""Spherical geometry, geohash and grid cells as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_MILE = 1.609344
# Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    dlat = F.radians(lat2 - lat1) / 2
    dlng = F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def km_to_miles(km: Column) -> Column:
    return km / F.lit(KM_PER_MILE)


def in_box(lng: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lng.between(west, east) & lat.between(south, north)


def geohash(lat: Column, lng: Column, precision: int = 9) -> Column:
    """Base-32 geohash: scale both axes to integers, then interleave their bits."""
    total = 5 * precision
    lng_bits, lat_bits = (total + 1) // 2, total // 2

    def scaled(value: Column, span: float, bits: int) -> Column:
        top = (1 << bits) - 1
        index = F.floor((value + span / 2) / span * float(1 << bits)).cast("bigint")
        return F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(top).cast("bigint"), index))

    x, y = scaled(lng, 360.0, lng_bits), scaled(lat, 180.0, lat_bits)

    def bit(i: int) -> Column:
        axis, bits, nth = (x, lng_bits, i // 2) if i % 2 == 0 else (y, lat_bits, i // 2)
        return F.shiftright(axis, bits - 1 - nth).bitwiseAND(F.lit(1).cast("bigint"))

    letters = []
    for k in range(precision):
        code = bit(5 * k)
        for j in range(1, 5):
            code = code * 2 + bit(5 * k + j)
        letters.append(F.substring(F.lit(BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*letters)


def mercator_tile(lng: Column, lat: Column, zoom: int, tiles_per_axis: int = 1) -> tuple[Column, Column]:
    """Web-Mercator cell at ``zoom``, each map tile cut into ``tiles_per_axis`` squared cells."""
    n = float((1 << zoom) * tiles_per_axis)
    bounded = F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), lat))
    rad = F.radians(bounded)
    x = (lng + 180.0) / 360.0 * n
    y = (1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n
    return F.floor(x).cast("bigint"), F.floor(y).cast("bigint")


def chord_km(radius_km: float) -> float:
    """Straight-line length under a great-circle arc of ``radius_km``."""
    return 2 * EARTH_RADIUS_KM * math.sin(min(radius_km / (2 * EARTH_RADIUS_KM), math.pi / 2))


def cube_cell(lng: Column, lat: Column, side_km: float) -> list[Column]:
    """Cell of the point in a cubic grid around the globe.

    Cubes have the same size at every latitude and need no special case at the
    poles or the date line. Two points at most ``side_km`` apart in a straight
    line lie in the same cube or in touching ones.
    """
    phi, lam = F.radians(lat), F.radians(lng)
    scale = EARTH_RADIUS_KM / side_km
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(a * scale).cast("bigint") for a in axes]
