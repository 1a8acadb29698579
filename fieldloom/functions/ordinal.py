"""A latent normal field seen through ordered categories: probabilities, moments, slope and covariance."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.normal import norm_cdf, norm_cdf_sql, np_cdf, np_pdf

#: The categories and the cut points between them.
LEVELS = (-2.0, -1.0, 0.0, 1.0)
CUTS = (-1.5, -0.5, 0.5)
NODES, WEIGHTS = (a.tolist() for a in np.polynomial.legendre.leggauss(20))


def category_probabilities(mean: Column, sd: Column) -> list[Column]:
    """P(category) for a latent normal with the mean and sd, lowest category first."""
    upto = [norm_cdf((F.lit(c) - mean) / sd) for c in CUTS]
    return [upto[0], *[b - a for a, b in zip(upto, upto[1:], strict=False)], 1 - upto[-1]]


def category_probabilities_sql(mean: str, sd: str) -> list[str]:
    upto = [norm_cdf_sql(f"(({c} - ({mean})) / ({sd}))") for c in CUTS]
    return [upto[0], *[f"({b} - {a})" for a, b in zip(upto, upto[1:], strict=False)], f"(1 - {upto[-1]})"]


def moments(variance: Column) -> tuple[Column, Column]:
    """Mean and variance of the category when the latent mean is 0."""
    p = category_probabilities(F.lit(0.0), F.sqrt(variance))
    mean = sum((v * q for v, q in zip(LEVELS, p, strict=True)), F.lit(0.0))
    return mean, sum((v * v * q for v, q in zip(LEVELS, p, strict=True)), F.lit(0.0)) - mean * mean


def _terms() -> list[tuple[float, float, float]]:
    """Pairs of cut points and how often each occurs among all nine."""
    return [(a, b, 1.0 if i == j else 2.0) for i, a in enumerate(CUTS) for j, b in enumerate(CUTS) if i <= j]


def covariance(rho: Column, variance: Column) -> Column:
    """Covariance of the categories of two latent values with correlation rho: the sum over pairs of cut points of the density's integral from 0 to rho."""
    angle = F.asin(rho)
    total = F.lit(0.0)
    for t, w in zip(NODES, WEIGHTS, strict=True):
        theta = angle * ((t + 1) / 2)
        s, c = F.sin(theta), F.cos(theta)
        inner = F.lit(0.0)
        for a, b, times in _terms():
            inner = inner + times * F.exp(-(a * a + b * b - 2 * a * b * s) / (2 * variance * c * c))
        total = total + w * inner
    return total * angle / (4 * math.pi)


def covariance_sql(rho: str, variance: str) -> str:
    parts = []
    for t, w in zip(NODES, WEIGHTS, strict=True):
        theta = f"(asin({rho}) * {(t + 1) / 2!r})"
        inner = " + ".join(f"{times!r} * exp(-({a * a + b * b!r} - {2 * a * b!r} * sin({theta})) / (2 * {variance} * cos({theta}) * cos({theta})))" for a, b, times in _terms())
        parts.append(f"{w!r} * ({inner})")
    return f"(({' + '.join(parts)}) * asin({rho}) / {4 * math.pi!r})"


def np_probabilities(mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    upto = np_cdf((np.asarray(CUTS) - np.asarray(mean)[..., None]) / np.asarray(sd)[..., None])
    return np.diff(np.concatenate((np.zeros_like(upto[..., :1]), upto, np.ones_like(upto[..., :1])), axis=-1), axis=-1)


def np_moments(variance: float) -> tuple[float, float]:
    p = np_probabilities(np.array(0.0), np.array(math.sqrt(variance)))
    v = np.asarray(LEVELS)
    mean = float(p @ v)
    return mean, float(p @ (v * v)) - mean * mean


def np_slope(variance: float) -> float:
    """E[z* h(z*)] over the latent value in units of its sd times the sd: how strongly a category follows the latent value."""
    sd = math.sqrt(variance)
    edges = np.concatenate(([-np.inf], np.asarray(CUTS) / sd, [np.inf]))
    return float(sd * (np.asarray(LEVELS) * (np_pdf(edges[:-1]) - np_pdf(edges[1:]))).sum())


def np_covariance(rho: np.ndarray, variance: float, nodes: int = 20) -> np.ndarray:
    t, w = np.polynomial.legendre.leggauss(nodes)
    angle = np.arcsin(np.clip(np.asarray(rho, dtype=float), -1, 1))
    theta = angle[..., None] * ((t + 1) / 2)
    s, c2 = np.sin(theta), np.maximum(np.cos(theta) ** 2, 1e-12)
    total = np.zeros_like(theta)
    for a, b, times in _terms():
        total += times * np.exp(-(a * a + b * b - 2 * a * b * s) / (2 * variance * c2))
    return (total * w).sum(axis=-1) * angle / (4 * math.pi)
