"""Distances and scores of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = 6_371_000.0) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(h), F.sqrt(1 - F.least(h, F.lit(1.0))))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return haversine_m(lat1, lng1, lat2, lng2, 6371.0)


#: Metres and the score up to them.
GEO_STEPS = ((40, 1.0), (80, 0.95), (150, 0.88), (300, 0.75), (500, 0.55), (800, 0.35), (1200, 0.18))


def geo_score(m: Column) -> Column:
    out = F.when(m.isNull(), 0.0)
    for limit, score in GEO_STEPS:
        out = out.when(m <= limit, score)
    return out.otherwise(0.0)
