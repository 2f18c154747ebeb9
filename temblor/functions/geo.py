"""Grid cells and great-circle distance as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_RADIUS_KM = 6371.0088
_INT_LIMIT = float(2**31 - 1)


def round_half_away(x: Column) -> Column:
    """Nearest integer, halves away from zero.

    Same result as ``round(x)``, which goes through a BigDecimal for every row. The
    fraction ``x - trunc(x)`` is exact for doubles, so no tie is misjudged.
    """
    held = F.when(F.isnan(x), F.lit(0.0)).when(
        x.isNotNull(), F.least(F.greatest(x, F.lit(-_INT_LIMIT)), F.lit(_INT_LIMIT))
    )
    whole = held.cast("bigint")
    part = held - whole
    return whole + F.when(part >= 0.5, 1).when(part <= -0.5, -1).otherwise(0)


def half_degree_key(degrees: Column) -> Column:
    """Index of the half-degree grid line nearest to ``degrees``."""
    return round_half_away(degrees * 2)


def grid_half_degree(degrees: Column) -> Column:
    return half_degree_key(degrees) / F.lit(2.0)


def haversine_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Great-circle distance to a fixed point."""
    dlat = F.radians(lat - F.lit(float(lat0))) / 2
    dlon = F.radians(lon - F.lit(float(lon0))) / 2
    chord = F.pow(F.sin(dlat), F.lit(2.0)) + F.cos(F.radians(lat)) * F.lit(
        math.cos(math.radians(lat0))
    ) * F.pow(F.sin(dlon), F.lit(2.0))
    return F.asin(F.sqrt(F.least(chord, F.lit(1.0)))) * F.lit(2 * EARTH_RADIUS_KM)


def circle_box(lat0: float, lon0: float, radius_km: float) -> dict[str, tuple[float, float]]:
    """Latitude and, where it cannot wrap, longitude bounds that enclose a circle.

    Used in front of the exact distance so that the scan can skip row groups. The bounds
    are a little wide, never narrow.
    """
    margin = 1e-6
    angle = radius_km / EARTH_RADIUS_KM
    reach = math.degrees(angle) + margin
    box = {"lat": (lat0 - reach, lat0 + reach)}
    if abs(lat0) + reach < 90:
        dlon = math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat0)))) + margin
        if abs(lon0) + dlon < 180:
            box["lon"] = (lon0 - dlon, lon0 + dlon)
    return box


def place_key(lat: Column, lon: Column, bits: int = 16) -> Column:
    """A point's place on a Z-shaped curve through ``2^bits`` by ``2^bits`` cells: near numbers are near places.

    The bits of both cells take turns. Positions outside the globe count as its edge; null for none.
    """
    def spread(degrees: Column, half: float) -> Column:
        top = F.lit((1 << bits) - 1).cast("bigint")
        cell = F.floor((degrees + half) / (2 * half) * float(1 << bits))
        held = F.when(F.isnan(degrees), F.lit(0).cast("bigint")).otherwise(F.least(F.greatest(cell, F.lit(0).cast("bigint")), top))
        # Each bit goes to twice its place, half of them at a time.
        for step in (8, 4, 2, 1):
            mask = sum(((1 << step) - 1) << at for at in range(0, 32, 2 * step))
            held = held.bitwiseOR(F.shiftleft(held, step)).bitwiseAND(F.lit(mask).cast("bigint"))
        return held

    if not 1 <= bits <= 16:
        raise ValueError("1 to 16 bits for each side")
    return spread(lat, 90.0).bitwiseOR(F.shiftleft(spread(lon, 180.0), 1))
