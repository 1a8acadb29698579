"""The normal distribution as column expressions, SQL text and NumPy, with one set of coefficients.

The distribution function is West's rational approximation (2005), which Spark evaluates inside generated code.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numerator and denominator coefficients, highest power first.
NUMERATOR = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
SPLIT, ROOT_2PI, FAR = 7.07106781186547, 2.506628274631, 37.0


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def _horner(z, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = z * out + c
    return out


def norm_cdf(x: Column) -> Column:
    """Phi(x); null for null, and the limits 0 and 1 at the infinities."""
    z = F.abs(x)
    e = F.exp(-z * z / 2)
    tail = F.when(z < SPLIT, e * _horner(z, NUMERATOR) / _horner(z, DENOMINATOR)).when(z <= FAR, e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / ROOT_2PI).otherwise(0.0)
    return F.when(x.isNull(), F.lit(None)).when(x <= 0, tail).otherwise(1 - tail)


#: A published rational start for the quantile, in the middle and in the tails, highest power first.
QUANTILE_MIDDLE = ((-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.357751867269, -30.66479806614716, 2.506628277459239), (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0))
QUANTILE_TAIL = ((-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783), (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0))
TAIL = 0.02425


def norm_quantile(p: Column) -> Column:
    """The x with Phi(x) = p, for p between 0 and 1 (else null): a rational start and one step of Halley's method, at the smaller tail."""
    low = F.least(p, 1 - p)
    q, t = low - 0.5, F.sqrt(-2 * F.log(low))
    middle = _horner(q * q, QUANTILE_MIDDLE[0]) * q / _horner(q * q, QUANTILE_MIDDLE[1])
    start = F.when(low < TAIL, _horner(t, QUANTILE_TAIL[0]) / _horner(t, QUANTILE_TAIL[1])).otherwise(middle)

    def better(x: Column) -> Column:
        u = (norm_cdf(x) - low) * math.sqrt(2 * math.pi) * F.exp(x * x / 2)
        return F.when(x > 1 - FAR, x - u / (1 + x * u / 2)).otherwise(x)  # beyond, norm_cdf ends

    x = F.element_at(F.transform(F.array(start), better), 1)  # the start is computed once
    return F.when((p > 0) & (p < 1), F.when(p <= 0.5, x).otherwise(-x))


def norm_quantile_sql(p: str) -> str:
    horner = lambda z, cs: "".join("(" for _ in cs[1:]) + repr(cs[0]) + "".join(f" * {z} + {c!r})" for c in cs[1:])
    low = f"least({p}, 1 - {p})"
    q, t = f"({low} - 0.5)", f"sqrt(-2 * ln({low}))"
    start = f"(CASE WHEN {low} < {TAIL!r} THEN {horner(t, QUANTILE_TAIL[0])} / {horner(t, QUANTILE_TAIL[1])} ELSE {horner(f'({q} * {q})', QUANTILE_MIDDLE[0])} * {q} / {horner(f'({q} * {q})', QUANTILE_MIDDLE[1])} END)"
    step = f"list_transform([{start}], lambda x: CASE WHEN x > {1 - FAR!r} THEN x - {{u}} / (1 + x * {{u}} / 2) ELSE x END)[1]".format(u=f"(({norm_cdf_sql('x')} - {low}) * {math.sqrt(2 * math.pi)!r} * exp(x * x / 2))")
    return f"(CASE WHEN {p} <= 0.5 THEN {step} ELSE -{step} END)"


NODES_2, WEIGHTS_2 = (a.tolist() for a in np.polynomial.legendre.leggauss(20))


def bivariate_cdf(x: Column, y: Column, rho: Column) -> Column:
    """P(X <= x, Y <= y) for finite x and y and |rho| < 1."""
    angle, total = F.asin(rho), F.lit(0.0)
    for t, w in zip(NODES_2, WEIGHTS_2, strict=True):
        s, c = F.sin(angle * ((t + 1) / 2)), F.cos(angle * ((t + 1) / 2))
        total = total + w * F.exp(-(x * x + y * y - 2 * x * y * s) / (2 * c * c))
    return norm_cdf(x) * norm_cdf(y) + total * angle / (4 * math.pi)


def bivariate_cdf_sql(x: str, y: str, rho: str) -> str:
    parts = [f"{w!r} * exp(-({x} * {x} + {y} * {y} - 2 * {x} * {y} * sin(asin({rho}) * {(t + 1) / 2!r})) / (2 * pow(cos(asin({rho}) * {(t + 1) / 2!r}), 2)))" for t, w in zip(NODES_2, WEIGHTS_2, strict=True)]
    return f"({norm_cdf_sql(x)} * {norm_cdf_sql(y)} + ({' + '.join(parts)}) * asin({rho}) / {4 * math.pi!r})"


def norm_cdf_sql(x: str) -> str:
    z = f"abs({x})"
    horner = lambda cs: "".join("(" for _ in cs[1:]) + repr(cs[0]) + "".join(f" * {z} + {c!r})" for c in cs[1:])
    tail = f"CASE WHEN {z} < {SPLIT!r} THEN exp(-{z} * {z} / 2) * {horner(NUMERATOR)} / {horner(DENOMINATOR)} WHEN {z} <= {FAR!r} THEN exp(-{z} * {z} / 2) / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + 0.65))))) / {ROOT_2PI!r} ELSE 0.0 END"
    return f"(CASE WHEN {x} <= 0 THEN {tail} ELSE 1 - ({tail}) END)"


def np_pdf(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.square(x) / 2) / math.sqrt(2 * math.pi)


def np_cdf(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    z = np.minimum(np.abs(x), 1e3)
    with np.errstate(under="ignore"):
        e = np.exp(-z * z / 2)
        near = e * _horner(np.minimum(z, SPLIT), NUMERATOR) / _horner(np.minimum(z, SPLIT), DENOMINATOR)
        far = e / (z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) / ROOT_2PI
    tail = np.where(z < SPLIT, near, np.where(z <= FAR, far, 0.0))
    return np.where(x <= 0, tail, 1 - tail)


def np_bivariate_cdf(x: float, y: float, rho: float, nodes: int = 40) -> float:
    """P(X <= x, Y <= y) for correlation rho, by integrating the density along the correlation."""
    t, w = np.polynomial.legendre.leggauss(nodes)
    theta = math.asin(max(-1.0, min(1.0, rho))) * (t + 1) / 2
    c2 = np.maximum(np.cos(theta) ** 2, 1e-300)
    inner = np.exp(-(x * x + y * y - 2 * x * y * np.sin(theta)) / (2 * c2)) / (2 * math.pi)
    return float(np_cdf(np.array(x)) * np_cdf(np.array(y)) + (w * inner).sum() * math.asin(max(-1.0, min(1.0, rho))) / 2)


def np_rectangle(a1: float, b1: float, a2: float, b2: float, rho: float) -> float:
    """P(a1 < X <= b1, a2 < Y <= b2)."""
    big = lambda v: max(-40.0, min(40.0, v))
    f = lambda u, v: np_bivariate_cdf(big(u), big(v), rho)
    return f(b1, b2) - f(a1, b2) - f(b1, a2) + f(a1, a2)
