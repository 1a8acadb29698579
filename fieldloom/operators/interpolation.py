"""Thin-plate splines: one matrix of weights, computed once, applied to any number of fields as a sum of products."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kernel(d2: np.ndarray) -> np.ndarray:
    return np.where(d2 > 0, d2 * np.log(np.maximum(d2, 1e-300)) / 2, 0.0)


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def smoothing_system(points: np.ndarray, penalty: float) -> np.ndarray:
    n = len(points)
    t = np.column_stack((np.ones(n), points))
    return np.block([[_kernel(_d2(points, points)) + penalty * np.eye(n), t], [t.T, np.zeros((3, 3))]])


def weights(points: np.ndarray, targets: np.ndarray, penalty: float = 1e-8, least_condition: float = 1e-14) -> np.ndarray:
    """targets by points: what each point's value adds to each target's."""
    points, targets = np.asarray(points, float), np.asarray(targets, float)
    centre, scale = points.mean(axis=0), max(float(points.std()), 1e-12)
    p, q = (points - centre) / scale, (targets - centre) / scale
    a = smoothing_system(p, penalty)
    if 1 / np.linalg.cond(a) < least_condition:
        raise np.linalg.LinAlgError("the interpolation system is too ill conditioned")
    basis = np.column_stack((_kernel(_d2(q, p)), np.ones(len(q)), q))
    return np.linalg.solve(a.T, basis.T).T[:, : len(p)]


def penalty_for_df(points: np.ndarray, df: float) -> float:
    """The penalty at which the fit's hat matrix has trace df."""
    lo, hi = -20.0, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.trace(weights(points, points, float(np.exp(mid)), 0.0)) > df else (lo, mid)
    return float(np.exp((lo + hi) / 2))


def apply_weights(fields: DataFrame, matrix: DataFrame, keys: list[str], point: str = "location", value: str = "value") -> DataFrame:
    """keys, target, value: fields (keys, point, value) under matrix (target, point, weight)."""
    return fields.join(matrix, point).groupBy(*keys, "target").agg(F.sum(F.col("weight") * F.col(value)).alias("value"))


def weight_table(spark, points: list[tuple], targets: list[tuple], penalty: float = 1e-8) -> DataFrame:
    """target, location, weight from (id, lon, lat) lists: parameters, as many as grid cells times targets."""
    w = weights(np.asarray([p[1:] for p in points]), np.asarray([t[1:] for t in targets]), penalty)
    return spark.createDataFrame([(t[0], p[0], float(w[i, j])) for i, t in enumerate(targets) for j, p in enumerate(points)], "target long, location long, weight double")


def display_grid(points: list[tuple], columns: int, rows: int) -> list[tuple]:
    """Evenly spaced (id, lon, lat) over the extent of points (id, lon, lat), row after row from the south-west."""
    lon, lat = ([p[k] for p in points] for k in (1, 2))
    return [(j * columns + i, float(x), float(y)) for j, y in enumerate(np.linspace(min(lat), max(lat), rows)) for i, x in enumerate(np.linspace(min(lon), max(lon), columns))]


def smoothed_fields(fields: DataFrame, points: list[tuple], targets: list[tuple], keys: list[str], df: float, point: str = "location", value: str = "value") -> DataFrame:
    """keys, target, value: each field (keys, point, value) smoothed by a thin plate of df degrees of freedom and taken at targets.

    Points and targets are lists of parameters (id, lon, lat); one matrix of weights serves all fields. A field that lacks the value of a
    point has another plate, so it is left out, as is one with a point twice; rows of other points take no part.
    """
    ids = [p[0] for p in points]
    whole = fields.filter(F.col(point).isin(ids) & F.col(value).isNotNull() & ~F.isnan(value))
    known = whole.groupBy(*keys).agg(F.count_distinct(point).alias("__n"), F.count("*").alias("__all")).filter((F.col("__n") == len(ids)) & (F.col("__all") == len(ids)))
    matrix = weight_table(fields.sparkSession, points, targets, penalty_for_df(np.asarray([p[1:] for p in points], float), df))
    return apply_weights(whole.join(known.select(*keys), keys, "left_semi"), matrix, keys, point, value)


def self_check(points: np.ndarray, targets: np.ndarray, values: np.ndarray, penalty: float = 1e-8) -> float:
    """Largest difference between the operator's values and a direct solve for one field."""
    p = np.asarray(points, float)
    centre, scale = p.mean(axis=0), max(float(p.std()), 1e-12)
    u, q = (p - centre) / scale, (np.asarray(targets, float) - centre) / scale
    c = np.linalg.solve(smoothing_system(u, penalty), np.concatenate((values, np.zeros(3))))
    direct = np.column_stack((_kernel(_d2(q, u)), np.ones(len(q)), q)) @ c
    return float(np.abs(direct - weights(points, targets, penalty) @ values).max())
