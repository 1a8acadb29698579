"""Many fits of the prior at once: the steps of ``prior.fit`` over a batch of (penalties, held-out member) cases of one site.

Every array has a row per case. A tridiagonal system of each case is solved in one sweep over the steps (Thomas), a variance
update in another, so that a step costs a few array operations whatever the number of cases. Cases that have converged leave the batch.
"""

from __future__ import annotations

import numpy as np

from fieldloom.operators.prior import FLOOR, member_loss, variance_root


def tridiagonal(lower: np.ndarray, diagonal: np.ndarray, upper: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves a system per row; lower[:, i] multiplies x[:, i - 1], upper[:, i] multiplies x[:, i + 1]."""
    low, dia, up = (np.ascontiguousarray(a.T) for a in (lower, diagonal, upper))
    out = np.array(rhs.T, order="C")
    factor = np.empty_like(out)
    factor[0], out[0] = up[0] / dia[0], out[0] / dia[0]
    for i in range(1, len(out)):
        m = dia[i] - low[i] * factor[i - 1]
        factor[i], out[i] = up[i] / m, (out[i] - low[i] * out[i - 1]) / m
    for i in range(len(out) - 2, -1, -1):
        out[i] -= factor[i] * out[i + 1]
    return out.T


def _ridge(n: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of 2 * weight * D'D for first differences, per case."""
    diagonal = np.repeat(4.0 * weight[:, None], n, axis=1)
    diagonal[:, [0, -1]] = 2.0 * weight[:, None]
    if n == 1:
        diagonal[:] = 0
    return diagonal, np.repeat(-2.0 * weight[:, None], n, axis=1)


def moments(x: np.ndarray, left_out: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per case and step, over the members that it keeps: number, mean, and about the centre of all members (so that no digits cancel) the
    sums, the sums of squares and those of products with the next step."""
    out = left_out[:, None] >= 0
    kept = lambda v: v.sum(axis=0) - np.where(out, v[left_out], 0.0)
    n = len(x) - (left_out >= 0)
    centre = x.mean(axis=0)
    d = x - centre
    return n, kept(x) / n[:, None], centre, kept(d), kept(d * d), kept(d[:, :-1] * d[:, 1:])


def _about(n, centre, s1, s2, s11, mu) -> tuple[np.ndarray, np.ndarray]:
    """Sums over a case's members of (x - mu)^2, and of its products with the next step."""
    n, shift = n[:, None], mu - centre
    square = s2 - 2 * shift * s1 + n * shift**2
    return square, s11 - shift[:, 1:] * s1[:, :-1] - shift[:, :-1] * s1[:, 1:] + n * shift[:, 1:] * shift[:, :-1]


def _residuals(own: tuple, mu, slope) -> np.ndarray:
    """Mean over a case's members of the squared one-step residuals."""
    square, cross = _about(*own, mu)
    out = square.copy()
    out[:, 1:] += slope**2 * square[:, :-1] - 2 * slope * cross
    return np.maximum(out, 0.0) / own[0][:, None]


def _slopes(own: tuple, mu, r2, weight) -> np.ndarray:
    square, cross = _about(*own, mu)
    ridge, off = _ridge(cross.shape[1], weight)
    return tridiagonal(off, square[:, :-1] / r2[:, 1:] + ridge + 1e-12, off, cross / r2[:, 1:])


def _means(n, mean, slope, r2, weight) -> np.ndarray:
    n = n[:, None]
    ridge, off = _ridge(mean.shape[1], weight)
    diagonal, lower, upper = ridge + n / r2, off.copy(), off.copy()
    diagonal[:, :-1] += n * slope**2 / r2[:, 1:]
    lower[:, 1:] -= n * slope / r2[:, 1:]
    upper[:, :-1] -= n * slope / r2[:, 1:]
    z = n * mean
    z[:, 1:] -= slope * n * mean[:, :-1]
    z /= r2
    rhs = z.copy()
    rhs[:, :-1] -= slope * z[:, 1:]
    return tridiagonal(lower, diagonal, upper, rhs)


def _polished(x: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Roots of x^3 + a x^2 + b x + c after three Newton steps."""
    for _ in range(3):
        slope = (3 * x + 2 * a) * x + b
        with np.errstate(invalid="ignore", divide="ignore"):
            x = np.where(slope != 0, x - (((x + a) * x + b) * x + c) / slope, x)
    return x


def variance_roots(s: np.ndarray, neighbours: np.ndarray, count: int, weight: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Per case the positive x that minimises members/2 (log x + s/x) + weight * sum (x - neighbour)^2; neighbours: their sum."""
    out = np.maximum(s, FLOOR)
    some = np.flatnonzero(weight > 0)
    if not count or not len(some):
        return out
    s_, q, w, j = s[some], neighbours[some], weight[some], members[some]
    a, b, c = -q / count, j / (4 * w * count), -j * s_ / (4 * w * count)
    p, r = b - a * a / 3, 2 * a**3 / 27 - a * b / 3 + c
    disc = (r / 2) ** 2 + (p / 3) ** 3
    best = np.zeros(len(some))
    one = np.flatnonzero(disc > 0)
    root = np.sqrt(disc[one])
    best[one] = _polished((np.cbrt(-r[one] / 2 + root) + np.cbrt(-r[one] / 2 - root) - a[one] / 3)[None], a[one], b[one], c[one])[0]
    three = np.flatnonzero(disc <= 0)
    if len(three):
        a, b, c, p, r, q, w, j, s3 = (v[three] for v in (a, b, c, p, r, q, w, j, s_))
        size = 2 * np.sqrt(np.maximum(-p / 3, 0.0))
        with np.errstate(invalid="ignore", divide="ignore"):
            angle = np.arccos(np.clip(np.where(size > 0, 3 * r / (p * size), 0.0), -1.0, 1.0)) / 3
        x = _polished(np.stack([size * np.cos(angle - 2 * np.pi * k / 3) for k in range(3)]) - a / 3, a, b, c)
        good = x > FLOOR
        safe = np.where(good, x, 1.0)
        # the sum of squared distances, but for a part that is the same for all roots of a case
        cost = np.where(good, j / 2 * (np.log(safe) + s3 / safe) + w * (count * x * x - 2 * q * x), np.inf)
        best[three] = np.take_along_axis(x, np.argmin(cost, axis=0)[None], axis=0)[0]
    for k in np.flatnonzero(best <= FLOOR):  # no root above the floor
        best[k] = variance_root(float(s_[k]), [float(neighbours[some[k]]) / count] * count, float(weight[some[k]]), int(members[some[k]]))
    out[some] = np.maximum(best, FLOOR)
    return out


def _variances(s: np.ndarray, r2: np.ndarray, weight: np.ndarray, members: np.ndarray) -> np.ndarray:
    """One sweep from left to right, each entry between its new left and its old right neighbour."""
    out, seen = np.array(r2.T, order="C"), np.ascontiguousarray(s.T)
    for t in range(len(out)):
        around = [out[k] for k in (t - 1, t + 1) if 0 <= k < len(out)]
        out[t] = variance_roots(seen[t], sum(around, np.zeros(out.shape[1])), len(around), weight, members)
    return out.T


def _objective(n, resid, mu, slope, r2, w) -> np.ndarray:
    fit = n / 2 * (np.log(r2) + resid / r2).sum(axis=1)
    return fit + sum(w[:, k] * (np.diff(v, axis=1) ** 2).sum(axis=1) for k, v in enumerate((slope, mu, r2)))


def fit_cases(x: np.ndarray, weights: np.ndarray, left_out: np.ndarray, rounds: int = 100, tol: float = 1e-6) -> dict[str, np.ndarray]:
    """x: members by steps; weights: cases by three penalties; left_out: the member that each case leaves out, or -1.
    mu, slope and r2 by case and step, and the rounds that each case took."""
    cases, steps = len(weights), x.shape[1]
    n, mean, centre, s1, s2, s11 = moments(x, left_out)
    mu, slope = mean.copy(), np.zeros((cases, steps - 1))
    r2 = np.maximum((s2 - s1**2 / n[:, None]) / n[:, None], FLOOR)
    done, before = np.zeros(cases, dtype=int), np.full(cases, np.inf)
    going = np.arange(cases)
    for k in range(1, rounds + 1):
        own = (n[going], centre, s1[going], s2[going], s11[going])
        w = weights[going]
        new_slope = _slopes(own, mu[going], r2[going], w[:, 0])
        new_mu = _means(n[going], mean[going], new_slope, r2[going], w[:, 1])
        resid = _residuals(own, new_mu, new_slope)
        new_r2 = _variances(resid, r2[going], w[:, 2], n[going])
        mu[going], slope[going], r2[going], done[going] = new_mu, new_slope, new_r2, k
        now = _objective(n[going], resid, new_mu, new_slope, new_r2, w)
        settled = np.isfinite(before[going]) & (np.abs(before[going] - now) < tol * (1 + np.abs(before[going])))
        before[going] = now
        going = going[~settled]
        if not len(going):
            break
    return {"mu": mu, "slope": slope, "r2": r2, "rounds": done}


def held_out_scores(x: np.ndarray, weights: np.ndarray, rounds: int = 100) -> np.ndarray:
    """For every triple of penalties the mean over members of a member's loss under the fit to the others."""
    members = len(x)
    fold = np.tile(np.arange(members), len(weights))
    f = fit_cases(x, np.repeat(weights, members, axis=0), fold, rounds)
    losses = np.array([member_loss(x[j], f["mu"][k], f["slope"][k], f["r2"][k]) for k, j in enumerate(fold)])
    return losses.reshape(len(weights), members).mean(axis=1)
