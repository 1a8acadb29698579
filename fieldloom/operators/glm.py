"""Logistic additive models by penalised iteratively reweighted least squares.

The design has few columns (splines of coordinates and year, and covariates); each round sums X'WX and X'Wz over the rows
of every partition in NumPy and adds those matrices, so the driver holds columns squared numbers whatever the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from fieldloom.operators.functional import bspline_basis


@dataclass
class Term:
    """A part of the design: names of the columns it reads, a function of a frame, and its penalty (None: not penalised)."""

    name: str
    columns: list[str]
    make: object
    penalty: np.ndarray | None = None
    width: int = 1


def linear(column: str) -> Term:
    return Term(column, [column], lambda f, c=column: f[[c]].to_numpy(float))


def smooth(column: str, lo: float, hi: float, k: int) -> Term:
    """A cubic B-spline with a second-difference penalty; the first function is left out, as the intercept holds its level."""
    d = np.diff(np.eye(k), n=2, axis=0)[:, 1:]
    return Term(f"s({column})", [column], lambda f: bspline_basis(f[column].to_numpy(float), lo, hi, k)[:, 1:], d.T @ d, k - 1)


def surface(lon: str, lat: str, knots: np.ndarray) -> Term:
    """A thin-plate surface on given knots with its bending energy as penalty."""
    from fieldloom.operators.interpolation import _d2, _kernel

    p = np.asarray(knots, float)
    centre, scale = p.mean(axis=0), max(float(p.std()), 1e-12)
    u = (p - centre) / scale
    e = _kernel(_d2(u, u))
    t = np.column_stack((np.ones(len(u)), u))
    q = np.linalg.qr(t, mode="complete")[0][:, 3:]  # functions without a linear part
    s = q.T @ e @ q

    def make(f: pd.DataFrame) -> np.ndarray:
        x = (f[[lon, lat]].to_numpy(float) - centre) / scale
        return np.column_stack((x, _kernel(_d2(x, u)) @ q))

    penalty = np.zeros((len(u) - 1, len(u) - 1))
    penalty[2:, 2:] = (s + s.T) / 2
    return Term(f"s({lon},{lat})", [lon, lat], make, penalty, len(u) - 1)


@dataclass
class Fit:
    terms: list[Term]
    beta: np.ndarray
    covariance: np.ndarray
    deviance: float
    null_deviance: float
    edf: float
    n: int
    lambdas: list[float]
    score: float
    slices: dict[str, slice] = field(default_factory=dict)

    @property
    def aic(self) -> float:
        return self.deviance + 2 * self.edf

    @property
    def bic(self) -> float:
        return self.deviance + math.log(self.n) * self.edf

    @property
    def explained(self) -> float | None:
        """The share of the null deviance; none where the response does not vary."""
        return 1 - self.deviance / self.null_deviance if self.null_deviance else None


def _design(terms: list[Term], f: pd.DataFrame) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), *[t.make(f) for t in terms]])


def _sums(data: DataFrame, response: str, terms: list[Term], beta: np.ndarray | None, width: int) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    columns = list(dict.fromkeys([response, *(c for t in terms for c in t.columns)]))

    def part(batches):
        a, b, dev, ones, n = np.zeros((width, width)), np.zeros(width), 0.0, 0.0, 0
        for f in batches:
            x, y = _design(terms, f), f[response].to_numpy(float)
            eta = np.clip(x @ beta, -30, 30) if beta is not None else np.log((y + 0.5) / (1.5 - y))
            mu = 1 / (1 + np.exp(-eta))
            w = np.maximum(mu * (1 - mu), 1e-10)
            a += (x * w[:, None]).T @ x
            b += x.T @ (w * eta + (y - mu))
            dev -= 2 * float((y * np.log(np.maximum(mu, 1e-300)) + (1 - y) * np.log(np.maximum(1 - mu, 1e-300))).sum())
            ones, n = ones + float(y.sum()), n + len(y)
        yield pd.DataFrame({"a": [a.ravel()], "b": [b], "dev": [dev], "ones": [ones], "n": [n]})

    rows = data.select(*columns).mapInPandas(part, "a array<double>, b array<double>, dev double, ones double, n long")
    a, b, dev, ones, n = np.zeros(width * width), np.zeros(width), 0.0, 0.0, 0
    for r in rows.collect():  # one row per partition, which fit_logistic bounds
        a, b, dev, ones, n = a + np.asarray(r["a"]), b + np.asarray(r["b"]), dev + r["dev"], ones + r["ones"], n + r["n"]
    return a.reshape(width, width), b, dev, ones, n


def fit_logistic(data: DataFrame, response: str, terms: list[Term], lambdas: list[float] | None = None, rounds: int = 25, tol: float = 1e-7) -> Fit:
    """Fits with fixed smoothing parameters, or picks each by an approximate marginal likelihood from the sums of each round."""
    width, slices, at = 1 + sum(t.width for t in terms), {"(Intercept)": slice(0, 1)}, 1
    for t in terms:
        slices[t.name] = slice(at, at + t.width)
        at += t.width
    smooths = [t for t in terms if t.penalty is not None]
    rho = np.log(np.asarray(lambdas if lambdas is not None else [1.0] * len(smooths), float))

    def penalty(r) -> np.ndarray:
        s = np.zeros((width, width))
        for t, v in zip(smooths, r, strict=True):
            s[slices[t.name], slices[t.name]] += math.exp(v) * t.penalty
        return s

    def solve(a, b, r):
        h = a + penalty(r) + 1e-9 * np.eye(width)
        return np.linalg.solve(h, b), h

    def criterion(a, b, c, r) -> float:
        beta, h = solve(a, b, r)
        rank = sum(np.linalg.matrix_rank(t.penalty) * v for t, v in zip(smooths, r, strict=True))
        return float(c - 2 * beta @ b + beta @ h @ beta - rank + np.linalg.slogdet(h)[1])

    beta, before = None, np.inf
    parts = min(64, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    data = data.select(*dict.fromkeys([response, *(c for t in terms for c in t.columns)])).coalesce(parts).persist()
    try:
        for _ in range(rounds):
            a, b, dev, ones, n = _sums(data, response, terms, beta, width)
            if lambdas is None and smooths:
                for _ in range(3):
                    for k in range(len(rho)):
                        tries = [(criterion(a, b, 0.0, np.r_[rho[:k], rho[k] + d, rho[k + 1 :]]), rho[k] + d) for d in (-1.5, -0.5, 0.0, 0.5, 1.5)]
                        rho[k] = min(max(min(tries)[1], -12.0), 14.0)
            beta, h = solve(a, b, rho)
            if abs(before - dev) < tol * (abs(dev) + 0.1):
                break
            before = dev
        a, b, dev, ones, n = _sums(data, response, terms, beta, width)
    finally:
        data.unpersist()
    h = a + penalty(rho) + 1e-9 * np.eye(width)
    inverse = np.linalg.inv(h)
    p = ones / n
    null = -2 * (ones * math.log(p) + (n - ones) * math.log(1 - p)) if 0 < p < 1 else 0.0
    return Fit(terms, beta, inverse, dev, null, float(np.trace(inverse @ a)), n, np.exp(rho).tolist(), criterion(a, b, dev, rho), slices)


def chi2_tail(x: float, df: float) -> float:
    """P(chi-squared > x): the upper incomplete gamma function by series or continued fraction."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - front * total)
    tiny, b = 1e-300, z + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * out


def model_table(spark, fits: dict[str, Fit]) -> DataFrame:
    rows = [(name, f.n, f.edf, f.deviance, f.aic, f.bic, f.explained) for name, f in fits.items()]
    return spark.createDataFrame(rows, "model string, n long, edf double, deviance double, aic double, bic double, explained double")


def nested_tests(spark, fits: dict[str, Fit], pairs: list[tuple[str, str]]) -> DataFrame:
    """Likelihood-ratio comparisons of nested models on the same rows."""
    rows = []
    for small, large in pairs:
        if fits[small].n != fits[large].n:
            raise ValueError("nested models must be fitted on the same rows")
        stat, df = fits[small].deviance - fits[large].deviance, max(fits[large].edf - fits[small].edf, 1e-3)
        rows.append((small, large, stat, df, chi2_tail(max(stat, 0.0), df)))
    return spark.createDataFrame(rows, "small string, large string, statistic double, df double, p double")


def coefficient_table(spark, fits: dict[str, Fit], order: list[str] | None = None) -> DataFrame:
    """Parametric terms: estimate, standard error, z and p; by order, unknown terms last."""
    from fieldloom.functions.normal import np_cdf

    rows = []
    for name, f in fits.items():
        for term in ["(Intercept)", *[t.name for t in f.terms if t.penalty is None]]:
            i = f.slices[term].start
            est, se = float(f.beta[i]), math.sqrt(max(float(f.covariance[i, i]), 0.0))
            z = est / se if se else float("nan")
            rows.append((name, term, est, se, z, float(2 * np_cdf(np.array(-abs(z)))), order.index(term) if order and term in order else None))
    out = spark.createDataFrame(rows, "model string, term string, estimate double, se double, z double, p double, place int")
    return out.orderBy("model", out["place"].asc_nulls_last(), "term").drop("place")
