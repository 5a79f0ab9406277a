"""Number functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; the argument of the arc sine is held to [0, 1]."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def percent_change(old: Column, new: Column) -> Column:
    """100 * (new - old) / old; null where old is 0 or null."""
    return F.when(old != 0, (new - old) / old * 100)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent, rounded; 0 if the whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(100 * part / whole, digits))


def norm(v: Column) -> Column:
    """Euclidean length of an array, summed in double."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector counts as length 1, so its cosine is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    one = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot / (one(a) * one(b))


def structurally_empty(c: Column, kind: str = "value") -> Column:
    """Null and NaN are empty, and so is an array or map without entries; 0 and false are not."""
    if kind == "array":
        return c.isNull() | (F.size(c) == 0)
    if kind == "double":
        return c.isNull() | F.isnan(c)
    return c.isNull()
