"""Expectations. Schema checks answer at once; data checks return the violations as a frame (empty: met)."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import is_finite


class ExpectationError(ValueError):
    pass


def missing_columns(frame: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c not in frame.columns]


def require_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    if lost := missing_columns(frame, columns):
        raise ExpectationError(f"missing columns: {', '.join(lost)}")
    return frame


def require_exact_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    if frame.columns != columns:
        raise ExpectationError(f"columns are {frame.columns}, not {columns}")
    return frame


def not_finite(frame: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: how many rows of each column are null, NaN or infinite."""
    counts = frame.agg(*[F.sum((~is_finite(F.col(c))).cast("long")).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n").filter("n > 0")


def wrong_cardinality(frame: DataFrame, keys: list[str], of: str, expected: int) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count_distinct(of).alias("n")).filter(F.col("n") != expected)


def missing_steps(frame: DataFrame, keys: list[str], step: str, first: int, last: int) -> DataFrame:
    """Keys and steps that a dense range would have and the frame has not."""
    every = frame.select(*keys).distinct().withColumn(step, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return every.join(frame.select(*keys, F.col(step).cast("int").alias(step)).distinct(), [*keys, step], "left_anti")


def unexpected_entities(frame: DataFrame, column: str, expected: list) -> DataFrame:
    """Values that should not be there, and those that should and are not."""
    fixed = frame.sparkSession.createDataFrame([(v,) for v in expected], f"{column} {dict(frame.dtypes)[column]}")
    have = frame.select(column).distinct()
    return have.join(fixed, column, "left_anti").withColumn("problem", F.lit("unexpected")).unionByName(fixed.join(have, column, "left_anti").withColumn("problem", F.lit("missing")))


def apart(frame: DataFrame, a: str, b: str, tolerance: float = 1e-8) -> DataFrame:
    return frame.filter(~(F.abs(F.col(a) - F.col(b)) <= tolerance))


def index_problems(frame: DataFrame, indices: list[str], products: list[tuple[str, str, str]], most: float = 5.0, tolerance: float = 1e-8) -> DataFrame:
    """problem (scale, product), n: rows with an index further than ``most`` from 0, and rows whose first two columns do not multiply to the third."""
    large, wrong = F.lit(False), F.lit(False)
    for c in indices:
        large = large | (F.abs(F.col(c)) > most)
    for a, b, ab in products:
        wrong = wrong | ~(F.abs(F.col(a) * F.col(b) - F.col(ab)) <= tolerance)
    counts = frame.agg(F.count(F.when(large, 1)).alias("scale"), F.count(F.when(wrong, 1)).alias("product"))
    return counts.unpivot([], ["scale", "product"], "problem", "n").filter("n > 0")


def unsorted(frame: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Rows whose value is below that of the row before."""
    from pyspark.sql import Window

    return frame.withColumn("before", F.lag(value).over(Window.partitionBy(*keys).orderBy(order))).filter(F.col(value) < F.col("before"))


def require_none(violations: DataFrame, what: str) -> None:
    some = violations.limit(5).collect()
    if some:
        raise ExpectationError(f"{what}: {[r.asDict() for r in some]}")


def headline(frame: DataFrame, what: str, expected: int) -> int:
    """The row count; a warning where it isn't the expected one."""
    n = frame.count()
    if n != expected:
        warnings.warn(f"{what}: {n} rows, expected {expected}", stacklevel=2)
    return n


def key_columns_fit(frame: DataFrame, key: str) -> bool:
    """Whether a key is complete and unique, by two sums."""
    r = frame.agg(F.count("*").alias("n"), F.count(key).alias("k"), F.count_distinct(key).alias("d")).first()
    return r["n"] == r["k"] == r["d"]


def aligned(left: DataFrame, right: DataFrame, key: str, lon: str = "lon", lat: str = "lat", tolerance: float = 1e-8) -> DataFrame:
    """Left and right joined one to one: by key if it is complete and unique in both, else by coordinates; coordinates must agree."""
    from fieldloom.functions.geo import coordinate_key

    by_key = key in left.columns and key in right.columns and key_columns_fit(left, key) and key_columns_fit(right, key)
    l, r = left.alias("l"), right.alias("r")
    on = F.col(f"l.{key}") == F.col(f"r.{key}") if by_key else coordinate_key(F.col(f"l.{lon}"), F.col(f"l.{lat}")) == coordinate_key(F.col(f"r.{lon}"), F.col(f"r.{lat}"))
    joined = l.join(r, on)
    require_none(joined.filter(~((F.abs(F.col(f"l.{lon}") - F.col(f"r.{lon}")) <= tolerance) & (F.abs(F.col(f"l.{lat}") - F.col(f"r.{lat}")) <= tolerance))).select(f"l.{lon}", f"r.{lon}"), "coordinates differ")
    return joined
