"""Parsers as expressions: numbers of any shape, well-known text, degrees, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def number(text: Column) -> Column:
    """A double from plain decimal text, else null."""
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def as_float(json: Column) -> Column:
    """A double from a JSON scalar, a numeric string, {"value": x}, or the mean of {"low": x, "high": y}.

    Anything else, and a ``value`` that is no number, is null. true and false count as 1 and 0.
    """
    parsed = F.try_parse_json(json)

    def at(path: str) -> Column:
        return F.try_variant_get(parsed, path, "double")

    ends = F.when(F.try_variant_get(parsed, "$.value", "string").isNull(), (at("$.low") + at("$.high")) / 2)
    return F.coalesce(at("$"), at("$.value"), ends)


def point(wkt: Column) -> Column:
    """(lat, lon) of POINT text, whose order is lon lat; null if malformed."""
    inner = F.regexp_extract(wkt, r"(?i)^\s*POINT[^(]*\(([^)]*)\)", 1)
    parts = F.split(F.trim(F.regexp_replace(inner, r"\s+", " ")), " ")
    lat, lon = number(F.get(parts, F.lit(1))), number(F.get(parts, F.lit(0)))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


def ring_centroid(wkt: Column) -> Column:
    """(lat, lon) averaged over the vertices of the first ring, its closing one included.

    A pair whose latitude does not parse still counts for the mean longitude; a ring ends at the first
    character that is no digit, sign, point, comma or space.
    """
    ring = F.regexp_extract(wkt, r"\(\([\(]?([-\d\.\s,]+)\)?", 1)
    pairs = F.transform(F.split(ring, ","), lambda p: F.split(F.trim(F.regexp_replace(p, r"\s+", " ")), " "))
    full = F.filter(pairs, lambda p: (F.size(p) >= 2) & number(F.get(p, F.lit(0))).isNotNull())
    lons = F.transform(full, lambda p: number(F.get(p, F.lit(0))))
    lats = F.filter(F.transform(full, lambda p: number(F.get(p, F.lit(1)))), lambda x: x.isNotNull())

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)

    return F.when(F.size(lats) > 0, F.struct(mean(lats).alias("lat"), mean(lons).alias("lon")))


def geometry(wkt: Column) -> Column:
    """(lat, lon) of a point, or of the first ring of a polygon."""
    upper = F.upper(F.trim(wkt))
    return F.when(upper.startswith("POINT"), point(wkt)).when(F.contains(upper, F.lit("POLYGON")), ring_centroid(wkt))


def degrees_of(d: Column, m: Column, s: Column, side: Column, negative: str) -> Column:
    """Decimal degrees from whole degrees and minutes and decimal seconds; null if one does not parse."""
    value = F.trim(d).try_cast("int") + F.trim(m).try_cast("int") / 60 + number(s) / 3600
    return F.when(side == negative, -value).otherwise(value)


def title(text: Column) -> Column:
    """Every run of letters with its first letter upper case and the rest lower case."""
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")
