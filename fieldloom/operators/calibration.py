"""From an observed ordinal variogram to the latent field's variances and range.

Three monotone curves tie what is observed to what is latent: total variance (f1), nugget (f2) and range (f3). Each is
tabulated, made monotone, and inverted by linear interpolation. All work is on tables of a few hundred rows; the range
curve's rows are independent and may be spread over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from fieldloom.functions.ordinal import LEVELS, np_covariance, np_moments, np_probabilities, np_slope


class CalibrationError(ValueError):
    pass


def isotonic(y: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling adjacent violators."""
    y = np.asarray(y, float)
    w = np.ones_like(y) if w is None else np.asarray(w, float)
    means: list[float] = []
    weights: list[float] = []
    counts: list[int] = []
    for v, u in zip(y, w, strict=True):
        means.append(v)
        weights.append(u)
        counts.append(1)
        while len(means) > 1 and means[-2] > means[-1]:
            total = weights[-2] + weights[-1]
            means[-2:] = [(means[-2] * weights[-2] + means[-1] * weights[-1]) / total]
            weights[-2:] = [total]
            counts[-2:] = [counts[-2] + counts[-1]]
    return np.repeat(means, counts)


def monotone_inverse(x, y, target: float, what: str = "curve") -> float:
    """x at which the monotone version of y reaches target; levels with several x stand at their mean."""
    order = np.argsort(x)
    x, y = np.asarray(x, float)[order], isotonic(np.asarray(y, float)[order])
    level, back = np.unique(y, return_inverse=True)
    mean = np.bincount(back, weights=x) / np.bincount(back)
    if not level[0] <= target <= level[-1]:
        raise CalibrationError(f"{what}: {target:g} is outside [{level[0]:g}, {level[-1]:g}]")
    return float(np.interp(target, level, mean))


def total_curve(target: float, points: int = 200, engine: str = "analytic", draws: int = 1_000_000, seed: int = 1, most: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """f1: latent total variance against observed variance, on a grid that is widened until it holds the target."""
    top = max(2.0, 2 * target)
    noise = np.random.default_rng(seed).standard_normal(draws) if engine == "monte_carlo" else None
    while True:
        x = np.linspace(1e-4, top, points)
        if noise is None:
            y = np.array([np_moments(v)[1] for v in x])
        else:
            y = np.array([np.clip(np.rint(np.sqrt(v) * noise), -2, 1).var(ddof=1) for v in x])
        if y.max() >= target:
            return x, y
        if (top := top * 1.5) > most:
            raise CalibrationError(f"no total variance up to {most:g} gives an observed variance of {target:g}")


def nugget_curve(total: float, points: int = 200, engine: str = "analytic", draws: int = 200_000, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """f2: latent nugget against observed nugget, the variance less the covariance of two values that share the rest."""
    x = np.linspace(1e-4 * total, (1 - 1e-4) * total, points)
    if engine == "analytic":
        return x, np_moments(total)[1] - np_covariance(1 - x / total, total)
    rng = np.random.default_rng(seed)
    shared, a, b = (rng.standard_normal(draws) for _ in range(3))
    level = lambda e, v: np.clip(np.rint(np.sqrt(total - v) * shared + np.sqrt(v) * e), -2, 1)
    return x, np.array([(level(a, v) - level(b, v)).var(ddof=1) / 2 for v in x])


class CovarianceTable:
    """Ordinal covariance by correlation, 0 to the largest that the nugget allows; clamped outside."""

    def __init__(self, total: float, process: float, points: int = 4001) -> None:
        self.rho = np.linspace(0, process / total, points)
        self.value = np.maximum.accumulate(np_covariance(self.rho, total))

    def __call__(self, rho):
        return np.interp(rho, self.rho, self.value)


def monotone_slopes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes at the knots of a cubic Hermite curve that is monotone where the data are (Fritsch and Carlson, 1980)."""
    secant = np.diff(y) / np.diff(x)
    slope = np.concatenate((secant[:1], (secant[1:] + secant[:-1]) / 2, secant[-1:]))
    for k, s in enumerate(secant):
        if s == 0:
            slope[k : k + 2] = 0.0
            continue
        a, b = slope[k : k + 2] / s
        u, v = 2 * a + b - 3, a + 2 * b - 3
        if u > 0 and v > 0 and a * (u + v) < u * u:  # outside the region of monotone pieces
            slope[k : k + 2] *= 3 / np.hypot(a, b)
    return slope


class SplineCovarianceTable(CovarianceTable):
    """The same on 1501 points, made monotone by pooling, with a monotone cubic between them."""

    def __init__(self, total: float, process: float, points: int = 1501) -> None:
        self.rho = np.linspace(0, process / total, points)
        self.value = isotonic(np_covariance(self.rho, total))
        self.slope = monotone_slopes(self.rho, self.value)

    def __call__(self, rho):
        r = np.clip(rho, self.rho[0], self.rho[-1])
        k = np.clip(np.searchsorted(self.rho, r, side="right") - 1, 0, len(self.rho) - 2)
        h = self.rho[k + 1] - self.rho[k]
        t = (r - self.rho[k]) / h
        ends = self.value[k] * (1 + 2 * t) * (1 - t) ** 2 + self.value[k + 1] * t * t * (3 - 2 * t)
        return ends + h * t * (1 - t) * (self.slope[k] * (1 - t) - self.slope[k + 1] * t)


def _golden(f, lo: float, hi: float, rounds: int = 70) -> float:
    g = (5**0.5 - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa <= fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = f(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = f(b)
    return (lo + hi) / 2


def latent_range(observed: float, sill: float, total: float, process: float, table: CovarianceTable, distances=None, bounds: tuple[float, float] = (20.0, 2500.0)) -> float:
    """The latent range whose ordinal covariance lies nearest to the exponential one of the observed range and sill."""
    d = np.arange(0, 1201, 5.0) if distances is None else np.asarray(distances, float)
    want = sill * np.exp(-d / observed)
    return _golden(lambda r: float(((table(process / total * np.exp(-d / r)) - want) ** 2).sum()), *bounds)


def range_curve(spark: SparkSession, observed: list[float], sill: float, total: float, process: float) -> DataFrame:
    """f3: observed, latent; each row is a task's work of its own."""

    def fit(batches):
        table = SplineCovarianceTable(total, process)
        for b in batches:
            yield pd.DataFrame({"observed": b["observed"], "latent": [latent_range(a, sill, total, process, table) for a in b["observed"]]})

    return spark.createDataFrame([(float(a),) for a in observed], "observed double").repartition(min(len(observed), 16)).mapInPandas(fit, "observed double, latent double")


@dataclass(frozen=True)
class Calibration:
    total: float
    process: float
    nugget: float
    range_km: float


def calibrate(nugget: float, sill: float, range_km: float, engine: str = "analytic", grid: tuple[float, float, float] = (50.0, 1000.0, 10.0), most: float = 5000.0, spark: SparkSession | None = None, forward: bool = False) -> Calibration:
    """Latent parameters from a pilot variogram of levels.

    The range solves f3(range) = pilot range, on a grid that grows upwards only; ``forward`` takes f3(pilot range) instead.
    """
    total = monotone_inverse(*total_curve(nugget + sill, engine=engine), nugget + sill, "total variance")
    latent_nugget = monotone_inverse(*nugget_curve(total, engine=engine), nugget, "nugget")
    process = total - latent_nugget
    if process <= 0:
        raise CalibrationError("the nugget takes all of the variance")
    table = SplineCovarianceTable(total, process)
    if forward:
        return Calibration(total, process, latent_nugget, latent_range(range_km, sill, total, process, table))
    lo, hi, step = grid
    y = np.empty(0)
    while True:
        x = np.arange(lo, hi + step / 2, step)
        more = x[len(y) :]  # a grid that has grown keeps what it had
        if spark is None:
            found = [latent_range(a, sill, total, process, table) for a in more]
        else:
            found = [r["latent"] for r in range_curve(spark, more.tolist(), sill, total, process).orderBy("observed").collect()]  # a row per grid value
        y = np.concatenate((y, found))
        if y.max() >= range_km:
            return Calibration(total, process, latent_nugget, monotone_inverse(x, y, range_km, "range"))
        if (hi := hi * 1.5) > most:
            raise CalibrationError(f"no range up to {most:g} km gives {range_km:g} km")


def simulate_levels(rho: float, total: float, n: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of levels of latent values with correlation rho, for checks."""
    rng = np.random.default_rng(seed)
    a, e = rng.standard_normal(n), rng.standard_normal(n)
    b = rho * a + np.sqrt(1 - rho * rho) * e
    return np.clip(np.rint(np.sqrt(total) * a), -2, 1), np.clip(np.rint(np.sqrt(total) * b), -2, 1)


def level_summary(total: float) -> dict[str, float]:
    mean, variance = np_moments(total)
    p = np_probabilities(np.array(0.0), np.array(total**0.5))
    return {"mean": mean, "variance": variance, "slope": np_slope(total)} | {f"p_{int(v)}": float(q) for v, q in zip(LEVELS, p, strict=True)}
