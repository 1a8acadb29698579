"""Fixture constructions: the driver's tables seen as sparse ordinal records, an ensemble cube and series.

Each has a DataFrame form and the same thing as SQL common table expressions, so that queries and their SQL start alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEVEL_OF = {"error": -2, "view": -1, "click": 0, "purchase": 1, "signup": 1}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def coordinates(key: Column) -> tuple[Column, Column]:
    """Longitude and latitude derived from an integer key."""
    return F.lit(98.0) + (key * 37 % 265) / 10.0, F.lit(18.0) + (key * 53 % 245) / 10.0


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentary records: source_order, site, day (1 to 31), level, lon, lat."""
    e = read(spark, sf_dir, "events")
    level = F.lit(None)
    for name, v in LEVEL_OF.items():
        level = F.when(F.col("event_type") == name, v).otherwise(level)
    lon, lat = coordinates(F.col("user_id"))
    return e.select(F.col("event_id").alias("source_order"), F.col("user_id").alias("site"), F.dayofmonth("ts").alias("day"), level.cast("int").alias("level"), lon.alias("lon"), lat.alias("lat"), "value")


RECORDS = f"""records AS (SELECT event_id AS source_order, user_id AS site, CAST(day(ts) AS INT) AS day, CAST(CASE event_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LEVEL_OF.items())} END AS INT) AS level,
98.0 + CAST(user_id * 37 % 265 AS DOUBLE) / 10.0 AS lon, 18.0 + CAST(user_id * 53 % 245 AS DOUBLE) / 10.0 AS lat, value FROM events)"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = coordinates(F.col("n_nationkey"))
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell_id"), lon.alias("glon"), lat.alias("glat"))


GRID = "grid AS (SELECT n_nationkey AS cell_id, 98.0 + CAST(n_nationkey * 37 % 265 AS DOUBLE) / 10.0 AS glon, 18.0 + CAST(n_nationkey * 53 % 245 AS DOUBLE) / 10.0 AS glat FROM nation)"


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ensemble cube: location, member, year, month, value."""
    l = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    s = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    j = l.join(s, l["l_suppkey"] == s["s_suppkey"])
    return j.select(F.col("s_nationkey").alias("location"), F.col("l_linenumber").alias("member"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("value"))


CUBE = "cube AS (SELECT s_nationkey AS location, l_linenumber AS member, CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, l_extendedprice AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"


def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location, member, year, temp: means over complete years, scaled to a few tens."""
    from fieldloom.operators.relational import complete_mean

    return complete_mean(cube(spark, sf_dir), ["location", "member", "year"], "month", "value", 12, 1000.0, "temp")


ANNUAL = CUBE + """, monthly AS (SELECT location, member, year, month, avg(value) AS v FROM cube GROUP BY ALL),
annual AS (SELECT location, member, year, avg(v) / 1000.0 AS temp FROM monthly GROUP BY ALL HAVING count(v) = 12)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site, day, obs: daily means of events per user, on the days that have any."""
    return records(spark, sf_dir).groupBy("site", "day").agg((F.avg("value") / 100).alias("obs"))


SERIES = RECORDS + ", series AS (SELECT site, day, avg(value) / 100 AS obs FROM records GROUP BY ALL)"
