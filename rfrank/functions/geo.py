"""Geodesic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
#: The compass points, clockwise.
CARDINALS = ("N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW")
#: Kilometres that one degree of latitude spans, rounded down: cells found with it never miss a neighbour.
KM_PER_DEGREE = 111.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Great-circle distance; ``cos1`` and ``cos2``, where they are at hand, are the cosines of the latitudes."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    c1, c2 = F.cos(p1) if cos1 is None else cos1, F.cos(p2) if cos2 is None else cos2
    h = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + c1 * c2 * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return F.lit(EARTH_RADIUS_KM * 2) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from the first point to the second, 0 to 360."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(d) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)
    return (F.degrees(F.atan2(east, north)) + 360.0) % F.lit(360.0)


def cardinal(bearing: Column) -> Column:
    """One of 16 compass points; halves go to the even one."""
    at = F.rint(bearing / 22.5).cast("int") % 16
    return F.element_at(F.array(*[F.lit(c) for c in CARDINALS]), at + 1)


def cells_per_degree(km: float) -> int:
    """How finely to cut degrees for circles of about so many kilometres: a radius spans two cells or a little more,
    so a circle touches some thirty cells, and these hold about twice its area."""
    return max(1, min(1000, round(2 * KM_PER_DEGREE / max(km, 0.1))))


def grid_cell(lat: Column, lon: Column, per_degree: int = 1) -> Column:
    """The cell of a point, as one number; ``per_degree`` rows and columns to a degree."""
    n = per_degree
    row = F.least(F.floor((lat + 90) * n), F.lit(180 * n - 1))
    return row * (360 * n) + F.pmod(F.floor(lon * n), F.lit(360 * n))


def latitude_reach(lat: Column, km: Column) -> tuple[Column, Column]:
    """The lowest and the highest latitude that a circle may touch."""
    reach = km / KM_PER_DEGREE
    return F.greatest(lat - reach, F.lit(-90.0)), F.least(lat + reach, F.lit(90.0))


def longitude_reach(lat: Column, km: Column) -> Column:
    """Degrees of longitude that a circle may extend to either side; 180 if it may touch every one."""
    low, high = latitude_reach(lat, km)
    # The widest parallel that the circle touches is the one nearest to a pole.
    steep = F.greatest(F.abs(low), F.abs(high))
    return F.when(steep >= 89.0, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.sin(F.least(km / EARTH_RADIUS_KM, F.lit(1.5))) / F.cos(F.radians(steep)), F.lit(1.0)))) + 0.01
    )


def cells_in_reach(lat: Column, lon: Column, km: Column, per_degree: int = 1) -> Column:
    """The cells that a circle may touch, across the date line and over the poles."""
    n = per_degree
    low, high = latitude_reach(lat, km)
    rows = F.sequence(F.least(F.floor((low + 90) * n), F.lit(180 * n - 1)), F.least(F.floor((high + 90) * n), F.lit(180 * n - 1)))
    wide = longitude_reach(lat, km)
    columns = F.when(wide >= 90.0, F.sequence(F.lit(0).cast("long"), F.lit(360 * n - 1).cast("long"))).otherwise(
        F.transform(F.sequence(F.floor((lon - wide) * n), F.floor((lon + wide) * n)), lambda c: F.pmod(c, F.lit(360 * n)))
    )
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * (360 * n) + c)))
