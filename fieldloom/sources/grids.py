"""Generated sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def half_degree_grid(spark: SparkSession, lon0: float, lat0: float, n_lon: int, n_lat: int, step: float = 0.5) -> DataFrame:
    """cell_id, lon, lat: built from whole numbers, so that every engine gets equal doubles."""
    cells = spark.range(n_lon * n_lat)
    return cells.select(F.col("id").alias("cell_id"), (F.lit(lon0) + F.lit(step) * (F.col("id") % n_lon)).alias("lon"), (F.lit(lat0) + F.lit(step) * F.floor(F.col("id") / n_lon)).alias("lat"))


@udtf(returnType="i int, x double")
class EventGrid:
    """A table function for SQL: event_grid(lo, hi, step)."""

    def eval(self, lo: float, hi: float, step: float):
        n = int((hi - lo) / step + 1e-9)
        for i in range(n + 1):
            yield i, lo + i * step


def register(spark: SparkSession) -> None:
    """Makes the table function and the file formats known to a session."""
    from fieldloom.sources.netcdf import NetcdfSource
    from fieldloom.sources.xlsx import WorkbookSource

    spark.udtf.register("event_grid", EventGrid)
    spark.dataSource.register(WorkbookSource)
    spark.dataSource.register(NetcdfSource)
