"""Polygon files: named areas from GeoJSON feature collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Coordinates stay text here, since polygons and multipolygons nest them to different depths.
FEATURES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
POLYGON = "array<array<array<double>>>"


def read_areas(spark: SparkSession, path: str, names: list[str] | None = None, name: str = "name") -> DataFrame:
    """name, part, ring, points: each ring of each polygon, as lists of (lon, lat); ``names`` keeps the areas of these names.

    ``name`` is the property that names a feature. A multipolygon has several parts; rings after a part's first are its holes.
    """
    f = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    f = f.select(F.col("f.properties")[name].alias("name"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("text"))
    if names is not None:
        f = f.filter(F.col("name").isin(names))
    parts = F.when(F.col("type") == "Polygon", F.array(F.from_json("text", POLYGON))).when(F.col("type") == "MultiPolygon", F.from_json("text", f"array<{POLYGON}>"))
    parts = f.select("name", F.posexplode(parts).alias("part", "rings"))
    return parts.select("name", "part", F.posexplode("rings").alias("ring", "points"))


def edges(areas: DataFrame) -> DataFrame:
    """name, part, x1, y1, x2, y2: the sides of all rings, each closed; sides without length are left out."""
    following = F.concat(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), F.slice("points", 1, 1))
    sides = areas.select("name", "part", F.explode(F.arrays_zip("points", following.alias("next"))).alias("s"))
    ends = {"x1": "s.points", "y1": "s.points", "x2": "s.next", "y2": "s.next"}
    out = sides.select("name", "part", *[F.col(c)[0 if k[0] == "x" else 1].alias(k) for k, c in ends.items()])
    return out.filter("x1 <> x2 or y1 <> y2")
