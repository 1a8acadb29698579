"""Distribution estimates and quantile mapping: kernel and mixture distribution functions, inverses by table, and their composition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.normal import norm_cdf, np_cdf
from fieldloom.session import dealt


def kernel_cdf(sample: DataFrame, keys: list[str], value: str, at: list[float], bandwidth: Column | float) -> DataFrame:
    """keys, q, p: the smoothed distribution function at fixed places. Few places are as many sums over the rows; many are
    rows of their own, summed before they are shuffled, since the generated code for many sums grows too large."""
    h = F.lit(bandwidth) if not isinstance(bandwidth, Column) else bandwidth
    if len(at) > 12:
        rows = sample.select(*keys, F.col(value).alias("__v"), h.alias("__h"), F.explode(F.array(*[F.lit(float(q)) for q in at])).alias("q"))
        return rows.groupBy(*keys, "q").agg(F.avg(norm_cdf((F.col("q") - F.col("__v")) / F.col("__h"))).alias("p"))
    wide = sample.groupBy(*keys).agg(*[F.avg(norm_cdf((F.lit(float(q)) - F.col(value)) / h)).alias(f"k{i}") for i, q in enumerate(at)])
    points = F.array(*[F.struct(F.lit(float(q)).alias("q"), F.col(f"k{i}").alias("p")) for i, q in enumerate(at)])
    return wide.select(*keys, F.explode(points).alias("z")).select(*keys, "z.q", "z.p")


def mixture_cdf(estimates: DataFrame, keys: list[str], mean: str, sd: str, at: list[float], floor: float = 1e-8) -> DataFrame:
    """keys, q, p: mean over rows of Phi((q - mean) / max(sd, floor))."""
    return kernel_cdf(estimates, keys, mean, at, F.greatest(F.col(sd), F.lit(floor)))


def inverse_table(cdf: DataFrame, keys: list[str]) -> DataFrame:
    """keys, segments p0 to p1 and q0 to q1: running maximum of p, first q of each level, linear between."""
    w = Window.partitionBy(*keys).orderBy("q").rowsBetween(Window.unboundedPreceding, 0)
    levels = cdf.withColumn("p", F.max("p").over(w)).groupBy(*keys, "p").agg(F.min("q").alias("q"))
    after = Window.partitionBy(*keys).orderBy("p")
    return levels.select(*keys, F.col("p").alias("p0"), F.lead("p").over(after).alias("p1"), F.col("q").alias("q0"), F.lead("q").over(after).alias("q1"))


def quantile_map(targets: DataFrame, source: DataFrame, keys: list[str], clip: float = 1e-12) -> DataFrame:
    """keys, q, x: for target distribution points (keys, q, p) the value of the source distribution (keys, q, p) with the same probability; clamped at its ends."""
    table = inverse_table(source, keys)
    ends = table.groupBy(*keys).agg(F.min("p0").alias("lo"), F.max("p0").alias("hi"))
    t = targets.withColumn("u", F.greatest(F.least(F.col("p"), F.lit(1 - clip)), F.lit(clip))).join(ends, keys)
    t = t.withColumn("u", F.greatest(F.least(F.col("u"), F.col("hi")), F.col("lo"))).drop("lo", "hi")
    on = [t[k] == table[k] for k in keys]
    inside = (F.col("u") >= F.col("p0")) & ((F.col("u") < F.col("p1")) | F.col("p1").isNull())
    x = F.when(F.col("p1").isNull(), F.col("q0")).otherwise(F.col("q0") + (F.col("u") - F.col("p0")) * (F.col("q1") - F.col("q0")) / (F.col("p1") - F.col("p0")))
    joined = t.join(table, on) if keys else t.crossJoin(table)
    return joined.filter(inside).select(*[t[k] for k in keys], t["q"], x.alias("x"))


def np_bandwidth(x: np.ndarray, slice_rows: int = 4096) -> float:
    """Cross-validated bandwidth of a Gaussian-kernel distribution function: leave-one-out integrated squared error over a grid of
    bandwidths, of all values, in slices."""
    x = np.asarray(x, float)
    n, sd = len(x), x.std(ddof=1)
    if n < 3 or sd == 0:
        return max(float(sd), 1e-8)
    grid = np.quantile(x, np.linspace(0.02, 0.98, 40))
    best = (np.inf, sd)
    if n * len(grid) <= 2**13:  # a small sample: all bandwidths at once
        hs = sd * n ** (-1 / 3) * np.geomspace(0.2, 3, 15)
        own = np_cdf((grid[None, None, :] - x[None, :, None]) / hs[:, None, None])
        errors = (((x[:, None] <= grid[None, :]) - (own.sum(axis=1, keepdims=True) - own) / (n - 1)) ** 2).reshape(len(hs), -1).sum(axis=1)
        return float(hs[errors.argmin()])
    for h in sd * n ** (-1 / 3) * np.geomspace(0.2, 3, 15):
        parts = [x[lo : lo + slice_rows, None] for lo in range(0, n, slice_rows)]
        every = sum(np_cdf((grid[None, :] - part) / h).sum(axis=0) for part in parts)[None, :]
        error = sum(float((((part <= grid[None, :]) - (every - np_cdf((grid[None, :] - part) / h)) / (n - 1)) ** 2).sum()) for part in parts)
        best = min(best, (error, float(h)))
    return best[1]


def np_map(sample: np.ndarray, yhat: np.ndarray, nu: np.ndarray, total: float, points: int = 2001, table: int = 5001, tail: float = 1e-14, clip: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """y and g(y) over a range that holds the latent distribution's tails and every estimate by eight of its sds."""
    from statistics import NormalDist

    nu = np.maximum(nu, 1e-8)
    far = -NormalDist().inv_cdf(tail) * np.sqrt(total)
    lo, hi = min(-far, float((yhat - 8 * nu).min())), max(far, float((yhat + 8 * nu).max()))
    y = np.linspace(lo, hi, points)
    fy = np.clip(np_cdf((y[:, None] - yhat[None, :]) / nu[None, :]).mean(axis=1), clip, 1 - clip)
    h = np_bandwidth(sample)
    q = np.linspace(sample.min() - 8 * h, sample.max() + 8 * h, table)
    fx = np.maximum.accumulate(np.concatenate([np_cdf((part[:, None] - sample[None, :]) / h).mean(axis=1) for part in np.array_split(q, 10)]))
    first = np.concatenate(([True], np.diff(fx) > 0))
    return y, np.interp(fy, fx[first], q[first])


def at_index(maps: DataFrame, y: float = 0.0, site: str = "site") -> DataFrame:
    """site, x: each site's map at one index, between its two nearest points; beyond the ends, the end."""
    below = F.max(F.when(F.col("y") <= y, F.struct("y", "x")))
    above = F.min(F.when(F.col("y") >= y, F.struct("y", "x")))
    ends = maps.groupBy(site).agg(below.alias("a"), above.alias("b"))
    span = F.col("b.y") - F.col("a.y")
    inside = F.when(span > 0, F.col("a.x") + (y - F.col("a.y")) * (F.col("b.x") - F.col("a.x")) / span).otherwise(F.col("a.x"))
    return ends.select(site, F.when(F.col("a").isNull(), F.col("b.x")).when(F.col("b").isNull(), F.col("a.x")).otherwise(inside).alias("x"))


def quantile_maps(samples: DataFrame, estimates: DataFrame, total: float, points: int = 401) -> DataFrame:
    """site, y, x: the uncertainty-aware mapping of each site; samples (site, value), estimates (site, yhat, nu)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo in range(0, len(b), 128):
                found = []
                for site, s, yhat, nu in zip(*(b[c].iloc[lo : lo + 128] for c in ("site", "values", "yhat", "nu")), strict=True):
                    found.append((site, *np_map(np.asarray(s, float), np.asarray(yhat, float), np.asarray(nu, float), total, points, 2001)))
                yield pd.DataFrame({"site": np.repeat(np.asarray([f[0] for f in found], b["site"].dtype), points), "y": np.concatenate([f[1] for f in found]), "x": np.concatenate([f[2] for f in found])})

    kind, known = dict(samples.dtypes)["site"], lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))
    s = dealt(samples, "site").groupBy(F.col("site").alias("site")).agg(F.sort_array(F.collect_list(known("value"))).alias("values")).filter(F.size("values") > 1)  # a site's sample is one task's work
    e = dealt(estimates, "site").groupBy(F.col("site").alias("site")).agg(F.sort_array(F.collect_list(F.struct(known("yhat").alias("yhat"), known("nu").alias("nu")))).alias("e"))
    rows = s.join(e, "site").select("site", "values", F.col("e.yhat").alias("yhat"), F.col("e.nu").alias("nu"))
    return rows.mapInPandas(run, f"site {kind}, y double, x double")
