"""Interval-censored kriging: predicts a latent field from ordered categories, one period at a time.

A period is one group: its places, with the mean of the observations at each, are gathered, their covariance is factorised in tiles
once, and all targets of all sets are predicted from it in slices. Targets are a table of parameters (a grid), whose
size is checked before it is sent to every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.geo import np_ellipsoid_matrix
from fieldloom.functions.ordinal import np_moments, np_slope
from fieldloom.operators.calibration import Calibration, CovarianceTable
from fieldloom.session import dealt

#: What is added to the diagonal until the factorisation holds.
JITTERS = (0.0, 1e-12, 1e-10, 1e-8, 1e-6)
MOST_TARGETS = 200_000
#: Sums under a calibration near the factorised one: settled when what is left of them is estimated at this share of them; otherwise
#: that calibration has a factor of its own, as it has for more held-out observations of a period than FEW.
SETTLED, MOST_PASSES, FEW = 1e-12, 8, 16


BLOCK = 128


@dataclass(frozen=True)
class Factor:
    """The lower triangular factor; systems are solved by substitution, a block of rows at a time, so no inverse is formed."""

    lower: np.ndarray
    jitter: float

    def forward(self, b: np.ndarray) -> np.ndarray:
        out = np.array(b, float)
        for lo in range(0, len(out), BLOCK):
            hi = min(lo + BLOCK, len(out))
            out[lo:hi] = np.linalg.solve(self.lower[lo:hi, lo:hi], out[lo:hi] - self.lower[lo:hi, :lo] @ out[:lo])
        return out

    def backward(self, b: np.ndarray) -> np.ndarray:
        out = np.array(b, float)
        for lo in reversed(range(0, len(out), BLOCK)):
            hi = min(lo + BLOCK, len(out))
            out[lo:hi] = np.linalg.solve(self.lower[lo:hi, lo:hi].T, out[lo:hi] - self.lower[hi:, lo:hi].T @ out[hi:])
        return out

    def solve(self, b: np.ndarray) -> np.ndarray:
        return self.backward(self.forward(b))


def factorise(matrix: np.ndarray) -> Factor:
    for jitter in JITTERS:  # added to the diagonal as it is
        try:
            return Factor(np.linalg.cholesky(matrix + jitter * np.eye(len(matrix)) if jitter else matrix), jitter)
        except np.linalg.LinAlgError:
            continue
    raise np.linalg.LinAlgError("the covariance is not positive definite, even with jitter")


class Tiles:
    """The lower factor of a matrix that ``tile(rows, columns)`` gives in pieces: only its lower half is ever held, a slab of ``size`` rows at a time."""

    def __init__(self, n: int, tile, size: int = 512) -> None:
        self.cuts = [slice(lo, min(lo + size, n)) for lo in range(0, n, size)]
        for self.jitter in JITTERS:
            try:
                self._factorise(tile)
                return
            except np.linalg.LinAlgError:
                continue
        raise np.linalg.LinAlgError("the covariance is not positive definite, even with jitter")

    def _factorise(self, tile) -> None:
        self.slabs, self.inverses = [], []
        for rows in self.cuts:
            slab = np.empty((rows.stop - rows.start, rows.stop))
            for k, columns in enumerate(self.cuts[: len(self.slabs)]):
                left = slab[:, : columns.start] @ self.slabs[k][:, : columns.start].T
                slab[:, columns] = (tile(rows, columns) - left) @ self.inverses[k].T
            own = tile(rows, rows) - slab[:, : rows.start] @ slab[:, : rows.start].T
            own[np.diag_indices(len(own))] += self.jitter
            slab[:, rows] = np.linalg.cholesky(own)
            self.inverses.append(np.linalg.inv(slab[:, rows]))
            self.slabs.append(slab)

    def forward(self, b: np.ndarray) -> np.ndarray:
        out = np.array(b, float)
        for rows, slab, inverse in zip(self.cuts, self.slabs, self.inverses, strict=True):
            out[rows] = inverse @ (out[rows] - slab[:, : rows.start] @ out[: rows.start])
        return out

    def backward(self, b: np.ndarray) -> np.ndarray:
        out = np.array(b, float)
        for rows, slab, inverse in reversed(list(zip(self.cuts, self.slabs, self.inverses, strict=True))):
            out[rows] = inverse.T @ out[rows]
            out[: rows.start] -= slab[:, : rows.start].T @ out[rows]
        return out


def by_place(lon, lat, level) -> tuple[np.ndarray, ...]:
    """lon, lat, mean level and number of the observations of each place, and each observation's place."""
    where, first = np.unique(np.column_stack((np.asarray(lon, float), np.asarray(lat, float))), axis=0, return_inverse=True)
    first = first.ravel()
    n = np.bincount(first)
    return where[:, 0], where[:, 1], np.bincount(first, np.asarray(level, float)) / n, n, first


class Predictor:
    """Fixed quantities of a calibrated field, and prediction of one period.

    Observations at one place have one covariance with all others, so that they weigh the same: their mean stands for them, with the
    part of its variance that they don't share divided by their number. A period's matrix has a row per place.
    """

    def __init__(self, c: Calibration) -> None:
        self.c = c
        self.mean, self.variance = np_moments(c.total)
        self.slope = np_slope(c.total)
        self.table = CovarianceTable(c.total, c.process)
        self.rise = np.append(np.diff(self.table.value), 0.0)

    def covariance(self, lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
        return self.covariance_at(np_ellipsoid_matrix(lon, lat, lon, lat))

    def covariance_at(self, km: np.ndarray) -> np.ndarray:
        """Between observations at these distances."""
        s = self.table(self.c.process / self.c.total * np.exp(-km / self.c.range_km))
        np.fill_diagonal(s, self.variance)
        return s

    def factor(self, lon: np.ndarray, lat: np.ndarray, n: np.ndarray) -> Tiles:
        """Of the covariance of the means of n observations at distinct places."""
        return Tiles(len(lon), lambda rows, columns: self.tile(np_ellipsoid_matrix(lon[rows], lat[rows], lon[columns], lat[columns]), n[rows] if rows == columns else None))

    def tile(self, km: np.ndarray, n: np.ndarray | None) -> np.ndarray:
        """The covariance of means at these distances; n where it lies on the diagonal. The table's steps are equal, so that a value is
        found by its place and not by a search."""
        s = np.exp(km * (-1 / self.c.range_km))
        s *= len(self.rise) - 1
        k = s.astype(np.int32)
        s -= k
        s *= self.rise.take(k, mode="clip")
        s += self.table.value.take(k, mode="clip")
        if n is not None:
            np.fill_diagonal(s, self.variance / n + self.table.value[-1] * (1 - 1 / n))
        return s

    def predict(self, lon, lat, level, tlon, tlat, n=None) -> tuple[np.ndarray, np.ndarray, float]:
        """Mean, error variance at the targets, and the jitter used. With n, a row is a place with the mean level of n observations."""
        if n is None:
            lon, lat, level, n, _ = by_place(lon, lat, level)
        f = self.factor(lon, lat, n)
        weight = f.forward(np.asarray(level, float) - self.mean)
        means, variances = [], []
        some = max(16, 2**22 // len(lon))
        for k in range(0, len(tlon), some):
            half = f.forward(self.cross(np_ellipsoid_matrix(lon, lat, tlon[k : k + some], tlat[k : k + some])))
            means.append(half.T @ weight)
            variances.append(np.maximum(self.c.process - (half * half).sum(axis=0), 0))
        return np.concatenate(means), np.concatenate(variances), f.jitter

    def cross(self, km: np.ndarray) -> np.ndarray:
        """Between observations and the latent field at these distances."""
        return self.c.process * np.exp(-km / self.c.range_km) * self.slope / self.c.total

    def left_out(self, lon, lat, level, n, f: Tiles, places: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and error variance at each of ``places`` without one of its observations, of level ``own``, from one factor of all.

        Without an observation the place's mean has a larger variance, or the place is gone: a change of one diagonal element, so that
        the solution of a system becomes u - v u_i / (v_i + 1 / change), where u solves the whole system and v solves it for the i-th unit vector.
        """
        b = f.forward(self.right(lon, lat, level, places))
        return self.without(b.T @ b, level, n, places, own)

    def right(self, lon, lat, level, places: np.ndarray) -> np.ndarray:
        """The levels, the covariances with the field at ``places`` and the unit vectors of these, as columns."""
        unit = np.zeros((len(lon), len(places)))
        unit[places, np.arange(len(places))] = 1.0
        return np.column_stack((level - self.mean, self.cross(np_ellipsoid_matrix(lon, lat, lon[places], lat[places])), unit))

    def without(self, sums: np.ndarray, level, n, places: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What ``left_out`` gives, from the products of ``right``'s columns by the inverse of the matrix."""
        cross, unit = np.arange(1, len(places) + 1), np.arange(len(places) + 1, len(sums))
        u, v, m = sums[unit, cross], sums[unit, unit], n[places]
        alone = self.variance - float(self.table(self.c.process / self.c.total))
        with np.errstate(divide="ignore"):
            part = u / (v + m * (m - 1) / max(alone, 1e-300))
        at = np.where(m > 1, u - part * v, 0.0)  # the place's weight
        moved = np.where(m > 1, (level[places] - own) / np.maximum(m - 1, 1), 0.0)
        mean = sums[cross, 0] - part * sums[unit, 0] + at * moved
        return mean, np.maximum(self.c.process - (sums[cross, cross] - part * u), 0)


def near_sums(several: list[Predictor], base: Predictor, lon, lat, n, right: list[np.ndarray]) -> list[np.ndarray | None]:
    """Each predictor's b' K^-1 b, where b is its ``right`` and K its covariance, all from one factor, of ``base``.

    Where x is near K^-1 b and leaves r = b - K x, the sums are x'b + r'x + r' K^-1 r, and the factor stands for K in the last term alone.
    Each pass computes the distances and all products K x once, with two columns more for each held-out observation, and adds to x
    what the factor makes of r, so that with a relative difference e of the matrices the error is e^3, e^5, e^7 and so on. None where
    the passes do not contract well or ``base`` needs jitter.
    """
    f = base.factor(lon, lat, n)
    found: list[np.ndarray | None] = [None] * len(several)
    if f.jitter:
        return found

    def together(solve, columns: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        ends = np.cumsum([b.shape[1] for b in columns.values()])[:-1]
        return dict(zip(columns, np.split(solve(np.column_stack(list(columns.values()))), ends, axis=1), strict=True))

    x = together(f.backward, together(f.forward, dict(enumerate(right))))
    cuts = [slice(lo, min(lo + 256, len(lon))) for lo in range(0, len(lon), 256)]  # tiles that stay in a core's cache
    active, last = list(range(len(several))), np.ones(len(several))
    for _ in range(MOST_PASSES):
        left = {k: right[k].copy() for k in active}
        for i, rows in enumerate(cuts):
            for columns in cuts[: i + 1]:
                km = np_ellipsoid_matrix(lon[rows], lat[rows], lon[columns], lat[columns])
                for k in active:
                    s = several[k].tile(km, n[rows] if rows == columns else None)
                    left[k][rows] -= s @ x[k][columns]
                    if rows != columns:
                        left[k][columns] -= s.T @ x[k][rows]
        going, halves = [], together(f.forward, left)
        for k, half in halves.items():
            rest = half.T @ half
            sums = x[k].T @ right[k] + left[k].T @ x[k] + rest
            share = float(np.sqrt(np.max(np.diag(rest) / np.diag(sums)))) if (np.diag(sums) > 0).all() else np.inf
            rate = share / last[k]
            if not rate < 0.5:
                continue
            if rate * share**2 <= SETTLED:
                found[k] = (sums + sums.T) / 2
                continue
            last[k] = share
            going.append(k)
        if not (active := going):
            break
        for k, more in together(f.backward, {k: halves[k] for k in active}).items():
            x[k] = x[k] + more
    return found


def krige(observations: DataFrame, targets: DataFrame, c: Calibration, period: str = "year") -> DataFrame:
    """period, target_set, target_id, mean, variance, n_obs, jitter. observations: period, lon, lat, level; targets: target_set, target_id, lon, lat."""
    n = targets.limit(MOST_TARGETS + 1).count()
    if n > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets: cut them into sets")
    t = targets.orderBy("target_set", "target_id").toPandas()  # n rows, checked above
    shared = targets.sparkSession.sparkContext.broadcast((t, Predictor(c)))
    kinds = dict(observations.dtypes) | {f"t_{k}": v for k, v in targets.dtypes}
    shape = f"{period} {kinds[period]}, target_set {kinds['t_target_set']}, target_id {kinds['t_target_id']}, mean double, variance double, n_obs int, jitter double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        where, p = shared.value
        mean, variance, jitter = p.predict(*(pdf[c].to_numpy(float) for c in ("lon", "lat", "level")), where["lon"].to_numpy(), where["lat"].to_numpy(), pdf["n"].to_numpy())
        return pd.DataFrame({period: pdf[period].iloc[0], "target_set": where["target_set"], "target_id": where["target_id"], "mean": mean, "variance": variance, "n_obs": pdf["n"].sum(), "jitter": jitter})

    places = observations.groupBy(period, "lon", "lat").agg(F.avg("level").alias("level"), F.count("*").alias("n"))
    return dealt(places, period).groupBy(period).applyInPandas(one, shape)


def krige_held_out(training: DataFrame, held: DataFrame, c: Calibration | dict[int, Calibration], keys: list[str]) -> DataFrame:
    """Predictions at held-out sites from the training records of the same keys (repetition and period): keys, site, level, yhat, mspe.

    With a calibration for each value of the first key, that key's one predicts; values without one give no rows.
    """
    several = isinstance(c, dict)
    shared = training.sparkSession.sparkContext.broadcast({k: Predictor(v) for k, v in c.items()} if several else Predictor(c))  # 4001 numbers each
    if several:
        training, held = (f.filter(F.col(keys[0]).isin(list(c))) for f in (training, held))
    kinds = dict(held.dtypes)
    shape = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"site {kinds['site']}", f"level {kinds['level']}", "yhat double", "mspe double", "jitter double"])

    def one(key: tuple, train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        if train.empty or test.empty:
            return pd.DataFrame({k: [] for k in [*keys, "site", "level", "yhat", "mspe", "jitter"]})
        p = shared.value[key[0]] if several else shared.value
        mean, variance, jitter = p.predict(train["lon"].to_numpy(), train["lat"].to_numpy(), train["level"].to_numpy(), test["lon"].to_numpy(), test["lat"].to_numpy())
        return test[[*keys, "site", "level"]].assign(yhat=mean, mspe=variance, jitter=jitter)

    fresh = lambda f, columns: f.select(*[F.col(c).alias(c) for c in columns])  # noqa: E731  both may come from one frame
    return dealt(fresh(training, [*keys, "lon", "lat", "level"]), *keys).groupBy(*keys).cogroup(dealt(fresh(held, held.columns), *keys).groupBy(*keys)).applyInPandas(one, shape)


def krige_left_out(records: DataFrame, held: DataFrame, c: Calibration | dict[int, Calibration], period: str = "year", repetition: str = "repetition", chunk: int = 32) -> DataFrame:
    """repetition, period, site, level, yhat, mspe, jitter: predictions at held-out sites from all other records of their period.

    records: period, site, lon, lat, level, one row a site and period; held: repetition, period, site. A group is a period, whose places
    are factorised once for all repetitions; with a calibration for each repetition that one predicts, a group is a period and up to
    ``chunk`` repetitions, each with its factor, and repetitions without a calibration give no rows. No training table is copied for each repetition.
    """
    several = isinstance(c, dict)
    shared = records.sparkSession.sparkContext.broadcast({k: Predictor(v) for k, v in c.items()} if several else Predictor(c))  # 4001 numbers each
    if several:
        held = held.filter(F.col(repetition).isin(list(c)))
    kinds = dict(records.dtypes) | {repetition: dict(held.dtypes)[repetition]}
    shape = f"{repetition} {kinds[repetition]}, {period} {kinds[period]}, site {kinds['site']}, level {kinds['level']}, yhat double, mspe double, jitter double"
    names = [x.split()[0] for x in shape.split(", ")]
    fresh = lambda f, *columns: f.select(*[F.col(k).alias(k) for k in columns])  # noqa: E731  both come from one frame
    numbered = fresh(held, period, "site", repetition).withColumn("chunk", F.floor(F.col(repetition) / chunk) if several else F.lit(0))
    out = numbered.join(fresh(records, period, "site", "lon", "lat", "level"), [period, "site"])
    groups = numbered.select(period, "chunk").distinct()
    places = records.groupBy(period, "lon", "lat").agg(F.avg("level").alias("mean_level"), F.count("*").alias("n"))
    mine = fresh(places, period, "lon", "lat", "mean_level", "n").join(fresh(groups, period, "chunk"), period)

    def one(key: tuple, rows: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        if out.empty or rows["n"].sum() < 2:
            return pd.DataFrame({k: [] for k in names})
        lon, lat, level, n = (rows[k].to_numpy(float) for k in ("lon", "lat", "mean_level", "n"))
        number = {where: k for k, where in enumerate(zip(lon, lat, strict=True))}
        place = lambda part: np.asarray([number[where] for where in zip(part["lon"], part["lat"], strict=True)])
        found, sums = [], {}
        if several:
            few = {which: place(part) for which, part in out.groupby(repetition) if len(part) <= FEW}
            if len(few) > 1:
                own = [shared.value[which] for which in few]
                base = Predictor(Calibration(*np.median([(p.c.total, p.c.process, p.c.nugget, p.c.range_km) for p in own], axis=0).tolist()))
                sums = dict(zip(few, near_sums(own, base, lon, lat, n, [p.right(lon, lat, level, at) for p, at in zip(own, few.values(), strict=True)]), strict=True))
        for which, part in out.groupby(repetition) if several else [(None, out)]:
            p, at = shared.value[which] if several else shared.value, place(part)
            if sums.get(which) is not None:
                mean, variance = p.without(sums[which], level, n, at, part["level"].to_numpy(float))
                found.append(part.assign(yhat=mean, mspe=variance, jitter=0.0))
                continue
            f = p.factor(lon, lat, n)
            for k in range(0, len(part), 256):
                some = part.iloc[k : k + 256]
                mean, variance = p.left_out(lon, lat, level, n, f, at[k : k + 256], some["level"].to_numpy(float))
                found.append(some.assign(yhat=mean, mspe=variance, jitter=f.jitter))
        return pd.concat(found)[names]

    parts = 8 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # groups are few and heavy
    keys = [period, "chunk"]
    return dealt(fresh(mine, *keys, "lon", "lat", "mean_level", "n"), *keys, parts=parts).groupBy(*keys).cogroup(dealt(fresh(out, *keys, repetition, "site", "lon", "lat", "level"), *keys, parts=parts).groupBy(*keys)).applyInPandas(one, shape)
