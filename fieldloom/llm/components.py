"""Connected components of a link table by alternating stars; nothing of the graph reaches the driver but two sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each node's greater neighbours go to the least node around it; small: its lesser neighbours and itself do."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = around.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """node, label (the least node of its component) for every node with a link to another node."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct()
    now = stored(now)
    state = None
    for _ in range(most_rounds):
        before, now = now, stored(_stars(_stars(now, True), False))
        discard(before)
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
