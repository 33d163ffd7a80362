"""Column functions of the link metric. Distances are epicentral, on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quakeloom.params import EARTH_KM, YEAR_SECONDS, Params


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    up = F.sin((F.radians(lat2) - F.radians(lat1)) / 2.0)
    across = F.sin((F.radians(lon2) - F.radians(lon1)) / 2.0)
    a = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    # least and greatest pass over nulls, so that a missing place would lie at no distance
    return F.when(a.isNotNull(), F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))))


def positive_log10(x: Column) -> Column:
    """log10 of positive numbers, null otherwise."""
    return F.when(x > 0, F.log10(x))


def log10_eta(seconds: Column, km: Column, magnitude: Column, p: Params) -> Column:
    """Nearest-neighbour proximity of a later event to a parent of this magnitude; null unless both gaps are positive."""
    return positive_log10(seconds / YEAR_SECONDS) + F.lit(p.d_f) * positive_log10(km) - F.lit(p.b) * magnitude


def log10_rescaled_time(seconds: Column, magnitude: Column, p: Params) -> Column:
    return positive_log10(seconds / YEAR_SECONDS) - F.lit(p.q * p.b) * magnitude


def log10_rescaled_distance(km: Column, magnitude: Column, p: Params) -> Column:
    return F.lit(p.d_f) * positive_log10(km) - F.lit((1 - p.q) * p.b) * magnitude


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, by the same steps in every engine."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def bin_index(x: Column, width: float) -> Column:
    return F.floor((x + 1e-9) / F.lit(width)).cast("long")


def bin_lower(index: Column, width: float) -> Column:
    return F.floor(index * F.lit(width) * 1000.0 + 0.5) / 1000.0
