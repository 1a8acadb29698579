"""Gaussian mixtures by EM over a distributed table: tasks sum what each component needs, the driver turns these sums into parameters.

A model's three letters say whether volume, shape and orientation of the components are equal (E), varying (V) or, of a shape or an
orientation, the identity (I). All candidates advance in the same pass over the rows; one that has converged leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.session import stored

MODELS = ("EII", "VII", "EEI", "VEI", "EVI", "VVI", "EEE", "VEE", "EVE", "VVE", "EEV", "VEV", "EVV", "VVV")


def _size(m: np.ndarray) -> np.ndarray:
    """The d-th root of each determinant."""
    return np.exp(np.linalg.slogdet(m)[1] / m.shape[-1])


def _common_axes(scatter: np.ndarray, spread: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Better axes for all components with these variances along them: one step of a linear majorant and an SVD."""
    top = np.linalg.eigvalsh(scatter)[:, -1]
    f = sum((axes / s).T @ (w - t * np.eye(len(w))) for w, s, t in zip(scatter, spread, top, strict=True))
    p, _, r = np.linalg.svd(f)
    return r.T @ p.T


def covariances(model: str, w: np.ndarray, scatter: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Maximum-likelihood covariances of one model from the components' weights and scatter matrices about their means."""
    volume, shape, turn = model
    n, (k, d) = w.sum(), scatter.shape[:2]
    if shape == "I":
        mean = np.trace(scatter, axis1=1, axis2=2) / d
        return (np.full(k, mean.sum() / n) if volume == "E" else mean / w)[:, None, None] * np.eye(d)
    if turn == "E" and shape == "E":
        if volume == "E":
            return np.repeat(scatter.sum(axis=0)[None] / n, k, axis=0)
        size = np.ones(k)
        for _ in range(rounds):
            common = (scatter / size[:, None, None]).sum(axis=0)
            common /= _size(common)
            last, size = size, np.trace(np.linalg.solve(common[None], scatter), axis1=1, axis2=2) / (d * w)
            if np.allclose(size, last, rtol=1e-9, atol=0):
                break
        return size[:, None, None] * common
    if turn == "I":
        axes = np.repeat(np.eye(d)[None], k, axis=0)
    elif turn == "V":
        axes = np.linalg.eigh(scatter)[1]
    else:
        axes = np.repeat(np.linalg.eigh(scatter.sum(axis=0))[1][None], k, axis=0)
    for _ in range(rounds):
        along = np.einsum("kij,kia,kja->ka", scatter, axes, axes)  # variances along the axes, times weights
        if shape == "V":
            size = np.exp(np.log(along).mean(axis=1))
            form = along / size[:, None]
            size = np.full(k, size.sum() / n) if volume == "E" else size / w
        elif volume == "E":
            size, form = np.ones(k), np.repeat(along.sum(axis=0)[None] / n, k, axis=0)
        else:
            size = np.ones(k)
            for _ in range(rounds):
                form = (along / size[:, None]).sum(axis=0)
                form /= np.exp(np.log(form).mean())
                last, size = size, (along / form).sum(axis=1) / (d * w)
                if np.allclose(size, last, rtol=1e-9, atol=0):
                    break
            form = np.repeat(form[None], k, axis=0)
        spread = size[:, None] * form
        if turn != "E":
            break
        better = _common_axes(scatter, spread, axes[0])
        settled = np.allclose(np.abs((better * axes[0]).sum(axis=0)), 1, atol=1e-12)
        axes = np.repeat(better[None], k, axis=0)
        if settled:
            break
    return np.einsum("kia,ka,kja->kij", axes, spread, axes)


def parameters_of(model: str, k: int, d: int) -> int:
    """Free parameters of a mixture: weights, means and covariances."""
    volume, shape, turn = ({"I": 0, "E": 1, "V": k}[letter] for letter in model)
    return k - 1 + k * d + volume + shape * (d - 1) + turn * d * (d - 1) // 2


def _memberships(x: np.ndarray, c: dict) -> tuple[np.ndarray, np.ndarray]:
    """Each component's share of each row (k by n), and the rows' log densities; without covariances the nearest mean has all of a row."""
    gap = x[None] - c["means"][:, None]
    if c["covs"] is None:
        near = (gap**2).sum(axis=2)
        return (np.arange(len(near))[:, None] == near.argmin(axis=0)).astype(float), -near.min(axis=0)
    l = np.linalg.cholesky(c["covs"])
    z = np.linalg.solve(l, gap.transpose(0, 2, 1))
    scale = np.log(c["weights"]) - np.log(np.diagonal(l, axis1=1, axis2=2)).sum(axis=1) - x.shape[1] / 2 * np.log(2 * np.pi)
    logs = scale[:, None] - 0.5 * (z**2).sum(axis=1)
    top = logs.max(axis=0)
    total = top + np.log(np.exp(logs - top).sum(axis=0))
    return np.exp(logs - total), total


def _many_memberships(candidates: dict[int, dict]):
    """A function of rows that gives ``_memberships`` under all candidates, which have covariances: shares (all components by n) and each
    candidate's log likelihood. A component's rows are whitened by a product, a dimension at a time for all components."""
    means, covs, weights = (np.concatenate([c[name] for c in candidates.values()]) for name in ("means", "covs", "weights"))
    l = np.linalg.cholesky(covs)
    white = np.linalg.solve(l, np.broadcast_to(np.eye(means.shape[1]), l.shape))
    shift = np.einsum("kij,kj->ki", white, means)
    scale = np.log(weights) - np.log(np.diagonal(l, axis1=1, axis2=2)).sum(axis=1) - means.shape[1] / 2 * np.log(2 * np.pi)
    count = [len(c["means"]) for c in candidates.values()]
    first = np.cumsum([0, *count[:-1]])

    def shares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logs = np.zeros((len(means), len(x)))
        for j in range(means.shape[1]):
            z = white[:, j] @ x.T
            z -= shift[:, j, None]
            z *= z
            logs += z
        logs *= -0.5
        logs += scale[:, None]
        top = np.maximum.reduceat(logs, first, axis=0)
        logs -= np.repeat(top, count, axis=0)
        np.exp(logs, out=logs)
        total = np.add.reduceat(logs, first, axis=0)
        logs /= np.repeat(total, count, axis=0)
        return logs, (top + np.log(total)).sum(axis=1)

    return shares


def _rows(batch: pd.DataFrame, centre: np.ndarray) -> np.ndarray:
    return np.stack(batch["scores"].to_numpy()).astype(float) - centre


def component_sums(scores: DataFrame, candidates: dict[int, dict], centre: np.ndarray) -> dict[int, tuple]:
    """Per candidate its components' weights, first and second moments and the log likelihood: one pass over the rows. What the driver
    receives depends on candidates and dimensions alone."""
    d = len(centre)
    upper = np.triu_indices(d)
    m = 2 + d + len(upper[0])
    shared = scores.sparkSession.sparkContext.broadcast({i: {name: c.get(name) for name in ("weights", "means", "covs")} for i, c in candidates.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = {i: np.zeros((len(c["means"]), m)) for i, c in shared.value.items()}
        full = {i: c for i, c in shared.value.items() if c["covs"] is not None}
        together, ends = _many_memberships(full) if full else None, np.cumsum([len(c["means"]) for c in full.values()])[:-1]
        for b in batches:
            if b.empty:
                continue
            every = _rows(b, centre)
            for x in np.split(every, range(256, len(every), 256)):  # what a slice makes for all components stays in a core's cache
                moments = np.column_stack([np.ones(len(x)), x, x[:, upper[0]] * x[:, upper[1]]])
                if full:
                    share, logs = together(x)
                    for i, more, total in zip(full, np.split(share @ moments, ends), logs, strict=True):
                        held[i][:, 1:] += more
                        held[i][0, 0] += total
                for i, c in shared.value.items():
                    if i not in full:
                        share, logs = _memberships(x, c)
                        held[i][:, 1:] += share @ moments
                        held[i][0, 0] += logs.sum()
        rows = np.concatenate(list(held.values()))
        out = pd.DataFrame(rows, columns=[f"s{j}" for j in range(m)])
        out.insert(0, "component", np.concatenate([np.arange(len(v)) for v in held.values()]))
        out.insert(0, "candidate", np.repeat(list(held), [len(v) for v in held.values()]))
        yield out

    names = [f"s{j}" for j in range(m)]
    parts = scores.select("scores").mapInPandas(run, "candidate int, component int, " + ", ".join(f"{s} double" for s in names))
    found = parts.groupBy("candidate", "component").agg(*[F.sum(s).alias(s) for s in names]).collect()
    shared.unpersist()
    out = {}
    for i, c in candidates.items():
        rows = np.asarray([r[2:] for r in sorted((r for r in found if r["candidate"] == i), key=lambda r: r["component"])])
        second = np.zeros((len(c["means"]), d, d))
        second[:, upper[0], upper[1]] = rows[:, 2 + d :]
        second[:, upper[1], upper[0]] = rows[:, 2 + d :]
        out[i] = (rows[:, 1], rows[:, 2 : 2 + d], second, float(rows[:, 0].sum()))
    return out


def _scatter(sums: tuple, means: np.ndarray) -> np.ndarray:
    """Each component's scatter about its mean."""
    w, first, second = sums[:3]
    cross = np.einsum("ki,kj->kij", first, means)
    return second - cross - cross.transpose(0, 2, 1) + w[:, None, None] * np.einsum("ki,kj->kij", means, means)


def _maximised(c: dict, sums: tuple, floor: float) -> dict:
    """The candidate's parameters from its sums; a component without rows keeps its mean."""
    w, first = sums[:2]
    means = np.where((w > 1e-8)[:, None], first / np.maximum(w, 1e-8)[:, None], c["means"])
    w = w + 1e-10
    covs = None
    if c["model"]:
        covs = covariances(c["model"], w, _scatter(sums, means) + floor * w[:, None, None] * np.eye(means.shape[1]))
    return c | {"weights": w / w.sum(), "means": means, "covs": covs}


def _advanced(c: dict, sums: tuple, floor: float, tol: float) -> tuple[dict, bool]:
    """The candidate one step on, and whether it has converged. After every third step its sums are extrapolated along the last three
    (squared steps), as EM alone takes hundreds of passes; a leap that lowers the likelihood is taken back."""
    loglik = sums[3]
    best = c["at"]["loglik"]
    idle = 0 if loglik > best + tol * (1 + abs(loglik)) else c["idle"] + 1
    at = {name: c[name] for name in ("k", "model", "weights", "means", "covs")} | {"loglik": loglik} if loglik > best else c["at"]
    if idle >= 6 or c["safe"] is None and abs(loglik - c["loglik"]) <= tol * (1 + abs(loglik)):
        return c | {"at": at}, True
    if c["safe"] is not None and not loglik >= c["loglik"]:
        return c["safe"] | {"at": at, "idle": idle}, False
    step = _maximised(c, sums, floor) | {"at": at, "idle": idle, "loglik": loglik, "safe": None, "trail": [*c["trail"], sums[:3]]}
    if len(step["trail"]) < 3:
        return step, False
    a, b, e = step["trail"]
    first, second = [q - p for p, q in zip(a, b)], [p - 2 * q + r for p, q, r in zip(a, b, e)]
    stride = np.sqrt(sum((v**2).sum() for v in first) / max(sum((v**2).sum() for v in second), 1e-300))
    step["trail"] = []
    if stride <= 1:
        return step, False
    far = tuple(p + 2 * stride * q + stride**2 * r for p, q, r in zip(a, first, second))
    if (far[0] <= 1e-8).any() or np.linalg.eigvalsh(_scatter(far, far[1] / far[0][:, None])).min() <= 0:
        return step, False
    return _maximised(step, far, floor) | {"safe": step}, False


def _apart(scores: DataFrame, curve: str, centre: np.ndarray, k: int) -> np.ndarray:
    """k rows far from each other: the nearest to the centre, then always the farthest from those taken; ties go by curve."""

    def gap(to: np.ndarray):
        return F.aggregate(F.zip_with("scores", F.array(*[F.lit(float(v)) for v in to]), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)

    taken = [np.asarray(scores.orderBy(gap(centre), curve).first()["scores"], float)]
    while len(taken) < k:
        nearest = F.array_min(F.array(*[gap(t) for t in taken]))
        taken.append(np.asarray(scores.orderBy(nearest.desc(), curve).first()["scores"], float))
    return np.asarray(taken) - centre


def mixture_by_bic(scores: DataFrame, curve: str, most: int = 8, models: tuple[str, ...] = MODELS, fixed_k: int | None = None, rounds: int = 100, tol: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """(curve, component from 1, membership) of the mixture with the largest BIC, and the table (k, model, loglik, bic).

    scores holds curve and scores (arrays of one length); rows with null or non-finite scores take no part, and without rows both results
    are empty. Candidates are all models with 1 to ``most`` components, or with ``fixed_k``; of one component, models that say the same are
    tried once. EM starts from k-means on far-apart rows and ends when a step changes the log likelihood by less than ``tol`` of itself, six passes have not
    gained that much, or after ``rounds`` passes; a candidate's result is the best that it has had.
    """
    spark = scores.sparkSession
    kind = dict(scores.dtypes)[curve]
    finite = F.col("scores").isNotNull() & F.forall("scores", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = stored(scores.filter(finite).select(curve, "scores"))
    axes = x.select(F.posexplode("scores").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var")).orderBy("i").collect()  # a row per dimension
    if not axes:
        return x.selectExpr(curve, "0 component", "0D membership").limit(0), spark.createDataFrame([], "k int, model string, loglik double, bic double")
    if len({a["n"] for a in axes}) > 1:
        raise ValueError("arrays of scores differ in length")
    n, d = axes[0]["n"], len(axes)
    centre = np.asarray([a["mean"] for a in axes])
    floor = 1e-6 * max(float(np.mean([a["var"] for a in axes])), 1e-12)
    ks = [fixed_k] if fixed_k else list(range(1, min(most, max(1, n - 1)) + 1))

    starts = _apart(x, curve, centre, min(max(ks), n))
    grouped = {k: {"k": k, "model": None, "means": np.resize(starts[:k], (k, d)), "covs": None} for k in ks}
    moving, sums = grouped, {}
    for _ in range(10):
        sums |= component_sums(x, moving, centre)
        new = {k: _maximised(c, sums[k], floor) for k, c in moving.items()}
        moving = {k: c for k, c in new.items() if not np.allclose(c["means"], moving[k]["means"], rtol=0, atol=1e-12)}
        grouped |= new
        if not moving:
            break

    candidates: dict[int, dict] = {}
    for k in ks:
        same = set()
        for m in models:
            alike = (m[1] == "I", m[2] == "I")
            if k > 1 or alike not in same:
                candidates[len(candidates)] = _maximised(grouped[k] | {"model": m}, sums[k], floor) | {"loglik": -np.inf}
                same.add(alike)
    active = {i: c | {"trail": [], "safe": None, "at": c, "idle": 0} for i, c in candidates.items()}
    for _ in range(rounds):
        sums = component_sums(x, active, centre)
        for i in list(active):
            active[i], ended = _advanced(active[i], sums[i], floor, tol)
            candidates[i] = active[i]["at"]
            if ended:
                del active[i]
        if not active:
            break

    bics = {i: 2 * c["loglik"] - parameters_of(c["model"], c["k"], d) * float(np.log(n)) for i, c in candidates.items()}
    best = candidates[max(bics, key=lambda i: (bics[i], -i))]
    table = spark.createDataFrame([(c["k"], c["model"], c["loglik"], bics[i]) for i, c in candidates.items()], "k int, model string, loglik double, bic double")

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not b.empty:
                share = _memberships(_rows(b, centre), best)[0]
                yield pd.DataFrame({curve: b[curve], "component": share.argmax(axis=0) + 1, "membership": share.max(axis=0)})

    return x.mapInPandas(label, f"{curve} {kind}, component int, membership double"), table
