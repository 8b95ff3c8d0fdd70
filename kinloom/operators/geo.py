"""Distances and paths on the globe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0
STEPS = 12


def haversine(lat1, lng1, lat2, lng2) -> Column:
    r = lambda c: F.radians(F.col(c) if isinstance(c, str) else c)
    a = F.pow(F.sin((r(lat2) - r(lat1)) / 2), 2) + F.cos(r(lat1)) * F.cos(r(lat2)) * F.pow(F.sin((r(lng2) - r(lng1)) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1, lng1, lat2, lng2) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    r = lambda c: F.radians(F.col(c) if isinstance(c, str) else c)
    y = F.sin(r(lng2) - r(lng1)) * F.cos(r(lat2))
    x = F.cos(r(lat1)) * F.sin(r(lat2)) - F.sin(r(lat1)) * F.cos(r(lat2)) * F.cos(r(lng2) - r(lng1))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(degrees: Column) -> Column:
    names = F.array(*map(F.lit, "N NE E SE S SW W NW".split()))
    return names[F.pmod(F.floor((degrees + 22.5) / 45).cast("int"), F.lit(8))]


def interpolate(points: DataFrame, path: str, order: str, steps: int = STEPS) -> DataFrame:
    """path, order, step, lat, lng: ``steps`` points from each point towards the next of its path."""
    w = Window.partitionBy(path).orderBy(order)
    legs = points.select(path, order, "lat", "lng", F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2")).filter("lat2 IS NOT NULL")
    t = F.col("step") / F.lit(float(steps))
    each = legs.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    return each.select(path, order, "step", (F.col("lat") + (F.col("lat2") - F.col("lat")) * t).alias("lat"), (F.col("lng") + (F.col("lng2") - F.col("lng")) * t).alias("lng"))
