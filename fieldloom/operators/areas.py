"""Points in and near polygons, by an index of the polygons' sides.

A point is inside a polygon if a ray to the east crosses an odd number of its sides; only sides that reach the point's band of
latitude can be crossed. It is near a polygon if it is near a side, which lies in the squares of the lattice that its box, widened by
the distance, touches. So points meet sides by equal joins, however many of either there are, and never all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geo import SPHERE, point_in_degrees
from fieldloom.functions.scalar import is_finite


def _cells(lo: Column, hi: Column, side: float) -> Column:
    return F.sequence(F.floor(lo / side), F.floor(hi / side))


def _sites(points: DataFrame) -> DataFrame:
    return points.select("lon", "lat").filter(is_finite(F.col("lon")) & is_finite(F.col("lat"))).distinct()


def inside(points: DataFrame, sides: DataFrame, band: float = 1.0) -> DataFrame:
    """lon, lat, name: the areas (``polygons.edges``) that hold each of the points' places; holes are not inside."""
    bands = sides.filter("y1 <> y2").select("*", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), band)).alias("band"))
    met = _sites(points).withColumn("band", F.floor(F.col("lat") / band)).join(bands, "band")
    at = (F.col("x2") - F.col("x1")) * (F.col("lat") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    crossed = met.filter(((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("lon") < at))
    return crossed.groupBy("lon", "lat", "name", "part").agg(F.count("*").alias("n")).filter("n % 2 = 1").select("lon", "lat", "name").distinct()


def _side_km() -> Column:
    """Distance from (lon, lat) to a side, which is straight in a local projection around the point."""
    k = F.cos(F.radians("lat"))
    ax, ay = (F.col("x1") - F.col("lon")) * k, F.col("y1") - F.col("lat")
    bx, by = (F.col("x2") - F.col("lon")) * k, F.col("y2") - F.col("lat")
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.least(-(ax * dx + ay * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300)), F.lit(1.0)), F.lit(0.0))
    return F.radians(F.sqrt((ax + t * dx) * (ax + t * dx) + (ay + t * dy) * (ay + t * dy))) * SPHERE


def near_sides(points: DataFrame, sides: DataFrame, km: float, square: float | None = None) -> DataFrame:
    """lon, lat, name: the areas with a side at most km from each of the points' places (up to 89 degrees of latitude)."""
    pad = point_in_degrees(km)
    square = square or max(pad, 0.5)
    top = F.least(F.lit(89.0), F.greatest(F.abs("y1"), F.abs("y2")) + pad)
    wide = F.lit(pad) / F.cos(F.radians(top))
    xs = _cells(F.least("x1", "x2") - wide, F.greatest("x1", "x2") + wide, square)
    ys = _cells(F.least("y1", "y2") - pad, F.greatest("y1", "y2") + pad, square)
    seats = sides.select("*", F.explode(xs).alias("sx")).select("*", F.explode(ys).alias("sy"))
    met = _sites(points).select("lon", "lat", F.floor(F.col("lon") / square).alias("sx"), F.floor(F.col("lat") / square).alias("sy")).join(seats, ["sx", "sy"])
    return met.filter(_side_km() <= km).select("lon", "lat", "name").distinct()


def within(points: DataFrame, sides: DataFrame, km: float) -> DataFrame:
    """The points (lon, lat, ...) in the union of areas or at most km from it; each row once."""
    if not math.isfinite(km) or km < 0:
        raise ValueError("a distance is finite and not negative")
    found = inside(points, sides).unionByName(near_sides(points, sides, km)).select("lon", "lat").distinct()
    return points.join(found, ["lon", "lat"], "left_semi")
