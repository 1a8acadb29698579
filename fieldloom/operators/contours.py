"""Contour lines of a gridded field, as segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contour_segments(grid: DataFrame, levels: list[float]) -> DataFrame:
    """level, x1, y1, x2, y2 for a grid of i, j (whole numbers), x, y, z: where the field crosses each level, straight within triangles.

    Every square of four neighbours is cut into two triangles by the diagonal from (i, j) to (i + 1, j + 1). A triangle with corners on
    both sides of a level (above, or at and below) is crossed once, between two of its sides, so neighbouring segments share their
    ends and no square is ambiguous. Squares with a missing corner or value have no segment; ends are in order of x and y.
    """
    full = grid.filter(F.col("z").isNotNull() & ~F.isnan(F.col("z").cast("double")))
    corner = lambda di, dj, name: full.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.struct("x", "y", "z").alias(name))
    squares = corner(0, 0, "a").join(corner(1, 0, "b"), ["i", "j"]).join(corner(0, 1, "c"), ["i", "j"]).join(corner(1, 1, "d"), ["i", "j"])
    sides = lambda p, q, r: F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ((p, q), (q, r), (p, r))])
    rows = squares.select(F.explode(F.array(sides("a", "b", "d"), sides("a", "c", "d"))).alias("sides"))
    rows = rows.select("sides", F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))

    def crossing(s: Column) -> Column:
        t = (F.col("level") - s["u"]["z"]) / (s["v"]["z"] - s["u"]["z"])
        return F.struct((s["u"]["x"] + t * (s["v"]["x"] - s["u"]["x"])).alias("x"), (s["u"]["y"] + t * (s["v"]["y"] - s["u"]["y"])).alias("y"))

    crossed = F.filter("sides", lambda s: (s["u"]["z"] > F.col("level")) != (s["v"]["z"] > F.col("level")))
    ends = rows.filter(F.size(crossed) == 2).select("level", F.array_sort(F.transform(crossed, crossing)).alias("e"))
    return ends.select("level", *[F.col("e")[k][c].alias(f"{c}{k + 1}") for k in (0, 1) for c in ("x", "y")])
