"""Penalised nonstationary AR(1) prior from an ensemble: block-coordinate fits and leave-one-member-out selection.

For members X (J by N): mu and the slopes M are smoothed by squared differences (ridges lambda1 on M, lambda2 on mu), the
innovation variances r2 by lambda3 on their differences. Every linear update is tridiagonal and solved in linear time;
(site, lambdas, fold) are independent groups of one distributed table.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import dealt

FLOOR = 1e-10


def tridiagonal(lower: np.ndarray, diagonal: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a tridiagonal system; lower[i] multiplies x[i-1], upper[i] multiplies x[i+1]."""
    low, dia, up, out = lower.tolist(), diagonal.tolist(), upper.tolist(), rhs.tolist()  # plain floats are faster one at a time
    n = len(dia)
    factor = [0.0] * n
    factor[0], out[0] = up[0] / dia[0], out[0] / dia[0]
    for i in range(1, n):
        m = dia[i] - low[i] * factor[i - 1]
        factor[i], out[i] = up[i] / m, (out[i] - low[i] * out[i - 1]) / m
    for i in range(n - 2, -1, -1):
        out[i] -= factor[i] * out[i + 1]
    return np.asarray(out)


def _ridge(n: int, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of 2 * weight * D'D for first differences."""
    diagonal = np.full(n, 4.0 * weight)
    diagonal[[0, -1]] = 2.0 * weight
    if n == 1:
        diagonal[:] = 0
    return diagonal, np.full(n, -2.0 * weight)


def member_loss(x: np.ndarray, mu: np.ndarray, slope: np.ndarray, r2: np.ndarray) -> float:
    """Negative log-likelihood of one member without constants; infinite for a variance that is not positive."""
    if not np.all(np.isfinite(r2)) or np.any(r2 <= 0):
        return float("inf")
    a = x - mu
    e = a.copy()
    e[1:] -= slope * a[:-1]
    return float(0.5 * (np.log(r2) + e * e / r2).sum())


def innovations(x: np.ndarray, mu: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Mean over members of the squared one-step residuals."""
    a = x - mu
    e = a.copy()
    e[:, 1:] -= slope * a[:, :-1]
    return (e * e).mean(axis=0)


def update_slope(x, mu, r2, weight) -> np.ndarray:
    a = x - mu
    n = a.shape[1] - 1
    ridge, off = _ridge(n, weight)
    own = (a[:, :-1] ** 2).sum(axis=0) / r2[1:]
    return tridiagonal(off, own + ridge + 1e-12, off, (a[:, :-1] * a[:, 1:]).sum(axis=0) / r2[1:])


def update_mean(x, slope, r2, weight) -> np.ndarray:
    j, n = x.shape
    ridge, off = _ridge(n, weight)
    diagonal, lower, upper = ridge + j / r2, off.copy(), off.copy()
    diagonal[:-1] += j * slope**2 / r2[1:]
    lower[1:] -= j * slope / r2[1:]
    upper[:-1] -= j * slope / r2[1:]
    z = x.copy()
    z[:, 1:] -= slope * x[:, :-1]
    z = z.sum(axis=0) / r2
    rhs = z.copy()
    rhs[:-1] -= slope * z[1:]
    return tridiagonal(lower, diagonal, upper, rhs)


def variance_root(s: float, neighbours: list[float], weight: float, members: int) -> float:
    """The positive x that minimises members/2 (log x + s/x) + weight * sum (x - neighbour)^2."""
    d, q = len(neighbours), sum(neighbours)
    if weight == 0 or d == 0:
        return max(s, FLOOR)
    real = _positive_roots(-q / d, members / (4 * weight * d), -members * s / (4 * weight * d))
    if len(real) == 1:
        return real[0]
    cost = lambda x: members / 2 * (math.log(x) + s / x) + weight * sum((x - v) ** 2 for v in neighbours)
    if not real:
        real = np.geomspace(FLOOR, max(s, q / d, 1e-6) * 10, 400).tolist()
    return min(real, key=cost)


def _positive_roots(a: float, b: float, c: float) -> list[float]:
    """Roots above the floor of x^3 + a x^2 + b x + c, in closed form and polished by Newton steps."""
    p, r = b - a * a / 3, 2 * a**3 / 27 - a * b / 3 + c
    disc = (r / 2) ** 2 + (p / 3) ** 3
    if disc > 0:
        root = math.sqrt(disc)
        found = [math.cbrt(-r / 2 + root) + math.cbrt(-r / 2 - root)]
    elif p == 0:
        found = [0.0]
    else:
        size = 2 * math.sqrt(-p / 3)
        angle = math.acos(max(-1.0, min(1.0, 3 * r / (p * size)))) / 3
        found = [size * math.cos(angle - 2 * math.pi * k / 3) for k in range(3)]
    out = []
    for y in found:
        x = y - a / 3
        for _ in range(3):
            slope = (3 * x + 2 * a) * x + b
            if slope:
                x -= (((x + a) * x + b) * x + c) / slope
        if x > FLOOR:
            out.append(x)
    return out


def update_variance(s, r2, weight, members) -> np.ndarray:
    """One sweep from left to right, each entry between its new left and its old right neighbour."""
    if weight == 0:
        return np.maximum(s, FLOOR)
    out, seen = r2.tolist(), s.tolist()
    n = len(out)
    for t in range(n):
        around = out[max(t - 1, 0) : t] + out[t + 1 : t + 2]
        out[t] = max(variance_root(seen[t], around, weight, members), FLOOR)
    return np.asarray(out)


def objective(x, mu, slope, r2, w1, w2, w3) -> float:
    fit = x.shape[0] / 2 * float((np.log(r2) + innovations(x, mu, slope) / r2).sum()) if np.all(r2 > 0) else float("inf")
    return fit + w1 * (np.diff(slope) ** 2).sum() + w2 * (np.diff(mu) ** 2).sum() + w3 * (np.diff(r2) ** 2).sum()


def fit(x: np.ndarray, w1: float, w2: float, w3: float, rounds: int = 100, tol: float = 1e-6) -> dict:
    """x: members by years."""
    mu, slope = x.mean(axis=0), np.zeros(x.shape[1] - 1)
    r2 = np.maximum(x.var(axis=0), FLOOR)
    before, done = np.inf, 0
    for done in range(1, rounds + 1):
        slope = update_slope(x, mu, r2, w1)
        mu = update_mean(x, slope, r2, w2)
        r2 = update_variance(innovations(x, mu, slope), r2, w3, x.shape[0])
        now = objective(x, mu, slope, r2, w1, w2, w3)
        if np.isfinite(before) and abs(before - now) < tol * (1 + abs(before)):
            break
        before = now
    return {"mu": mu, "slope": slope, "r2": r2, "rounds": done}


#: Powers of ten from 1 to 1000 by half steps.
WEIGHTS = tuple(10 ** (k / 2) for k in range(7))


def matrices(ensemble: DataFrame, site: str = "site", member: str = "member", year: str = "year", value: str = "value") -> DataFrame:
    """site, years, members, x: each site's members by years as one row (a site is members times years numbers)."""
    rows = ensemble.groupBy(site, member).agg(F.sort_array(F.collect_list(F.struct(year, value))).alias("s"))
    rows = rows.select(site, member, F.transform("s", lambda v: v[year]).alias("years"), F.transform("s", lambda v: v[value].cast("double")).alias("x"))
    return rows.groupBy(site).agg(F.min("years").alias("years"), F.min("years").eqNullSafe(F.max("years")).alias("dense"), F.sort_array(F.collect_list(F.struct(member, "x"))).alias("m")).select(site, "years", "dense", F.transform("m", lambda v: v["x"]).alias("x"))


def cross_validate(sites: DataFrame, site: str = "site", weights: tuple[float, ...] = WEIGHTS, parts: int | None = None, rounds: int = 100, batch: int = 172) -> DataFrame:
    """site, w1, w2, w3, score: mean held-out loss over members for every triple. A row of work is a site and ``batch`` triples, which
    are fitted for all held-out members at once; rows are dealt to ``parts`` tasks (by default eight for each shuffle partition). Sites of
    one step have no fit."""
    from fieldloom.operators.prior_batch import held_out_scores

    parts = parts or 8 * int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    triples = list(product(weights, repeat=3))
    grid = F.explode(F.sequence(F.lit(0), F.lit(len(triples) - 1), F.lit(batch))).alias("grid")  # the first triple of each batch
    work = dealt(sites.filter(F.size("years") > 1).select(site, "x", grid), site, "grid", parts=parts)
    kind = dict(sites.dtypes)[site]

    def score(batches):
        for b in batches:
            for key, first, rows in zip(b[site], b["grid"], b["x"], strict=True):
                mine = triples[first : first + batch]
                found = held_out_scores(np.stack([np.asarray(r, float) for r in rows]), np.asarray(mine), rounds)
                yield pd.DataFrame([(key, first + k, *w, v) for k, (w, v) in enumerate(zip(mine, found.tolist(), strict=True))], columns=[site, "grid", "w1", "w2", "w3", "score"])

    return work.mapInPandas(score, f"{site} {kind}, grid int, w1 double, w2 double, w3 double, score double")


def best_weights(scores: DataFrame, site: str = "site") -> DataFrame:
    return scores.groupBy(site).agg(F.min_by(F.struct("w1", "w2", "w3"), F.struct("score", "grid")).alias("w")).select(site, "w.w1", "w.w2", "w.w3")


def fit_sites(sites: DataFrame, weights: DataFrame | tuple[float, float, float], site: str = "site") -> DataFrame:
    """site, year, parameter (mu, slope, r2), coefficient (Penalized ML or ML), value. Slopes stand at the later year. Sites of one step have no fit."""
    sites = sites.filter(F.size("years") > 1)
    if isinstance(weights, tuple):
        work = sites.withColumns({f"w{i + 1}": F.lit(float(w)) for i, w in enumerate(weights)})
    else:
        work = sites.join(weights, site)
    kind = dict(sites.dtypes)[site]

    def run(batches):
        for b in batches:
            out = []
            for key, years, rows, w1, w2, w3 in zip(b[site], b["years"], b["x"], b["w1"], b["w2"], b["w3"], strict=True):
                x = np.stack([np.asarray(r, float) for r in rows])
                for name, w in (("Penalized ML", (w1, w2, w3)), ("ML", (0.0, 0.0, 0.0))):
                    f = fit(x, *w)
                    for parameter, at in (("mu", years), ("slope", years[1:]), ("r2", years)):
                        out += [(key, int(y), parameter, name, float(v)) for y, v in zip(at, f[parameter], strict=True)]
            yield pd.DataFrame(out, columns=[site, "year", "parameter", "coefficient", "value"])

    return work.select(site, "years", "x", "w1", "w2", "w3").transform(dealt, site).mapInPandas(run, f"{site} {kind}, year int, parameter string, coefficient string, value double")
