"""Nonstationary AR(1) state space on a dense annual grid: filter, smoother, checks and measurement equations.

x_t = mu_t + M_t (x_{t-1} - mu_{t-1}) + e_t, var e_t = r2_t; an observation is alpha_t + beta_t x_t + d_t, var d_t = vdelta_t.
The column form folds over each key's ordered steps inside the JVM; one key's steps are one row, as its recursion must be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.draws import normal
from fieldloom.session import dealt

STEP = "struct<t:int,mu:double,slope:double,r2:double,obs:double,alpha:double,beta:double,vdelta:double>"
STATE = "struct<t:int,mu:double,slope:double,r2:double,obs:double,m_pred:double,p_pred:double,gain:double,innovation:double,proxy:double,weight:double,m:double,p:double>"


def _forward(steps: Column) -> Column:
    start = F.array().cast(f"array<{STATE}>")

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        m_pred = F.when(last.isNull(), s["mu"]).otherwise(s["mu"] + s["slope"] * (last["m"] - last["mu"]))
        p_pred = F.when(last.isNull(), s["r2"]).otherwise(s["slope"] * s["slope"] * last["p"] + s["r2"])

        def update(q: Column) -> Column:
            seen = s["obs"].isNotNull()
            total = s["beta"] * s["beta"] * q["p"] + s["vdelta"]
            gain = F.when(seen, q["p"] * s["beta"] / total)
            innovation = F.when(seen, s["obs"] - s["alpha"] - s["beta"] * q["m"])
            steep = seen & (F.abs(s["beta"]) > 1e-10)
            return F.struct(
                s["t"].alias("t"),
                s["mu"].alias("mu"),
                s["slope"].alias("slope"),
                s["r2"].alias("r2"),
                s["obs"].alias("obs"),
                q["m"].alias("m_pred"),
                q["p"].alias("p_pred"),
                gain.alias("gain"),
                innovation.alias("innovation"),
                F.when(steep, (s["obs"] - s["alpha"]) / s["beta"]).alias("proxy"),
                F.when(seen, s["beta"] * s["beta"] * q["p"] / total).alias("weight"),
                F.when(seen, q["m"] + gain * innovation).otherwise(q["m"]).alias("m"),
                F.when(seen, F.greatest((1 - gain * s["beta"]) * q["p"], F.lit(0.0))).otherwise(q["p"]).alias("p"),
            ).cast(STATE)

        one = F.transform(F.array(F.struct(m_pred.alias("m"), p_pred.alias("p"))), update)
        return F.concat(done, one)

    return F.aggregate(steps, start, step)


def _backward(states: Column) -> Column:
    start = F.array().cast("array<struct<t:int,ms:double,ps:double,p_pred:double,m_pred:double,slope:double>>")

    def step(done: Column, s: Column) -> Column:
        after = F.get(done, F.size(done) - 1)
        g = F.when(after["p_pred"] > 0, s["p"] * after["slope"] / after["p_pred"]).otherwise(0.0)
        ms = F.when(after.isNull(), s["m"]).otherwise(s["m"] + g * (after["ms"] - after["m_pred"]))
        ps = F.when(after.isNull(), s["p"]).otherwise(F.greatest(s["p"] + g * g * (after["ps"] - after["p_pred"]), F.lit(0.0)))
        return F.concat(done, F.array(F.struct(s["t"].alias("t"), ms.alias("ms"), ps.alias("ps"), s["p_pred"].alias("p_pred"), s["m_pred"].alias("m_pred"), s["slope"].alias("slope"))))

    return F.aggregate(F.reverse(states), start, step)


def filter_series(series: DataFrame, keys: list[str]) -> DataFrame:
    """series: keys, t, mu, slope (M), r2, obs (null: prediction only), alpha, beta, vdelta. Adds the filter's and the smoother's results per step."""
    fields = ["t", "mu", "slope", "r2", "obs", "alpha", "beta", "vdelta"]
    rows = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in fields]).cast(STEP))).alias("steps"))  # a key's steps: one per year
    rows = rows.select(*keys, _forward(F.col("steps")).alias("states"))
    rows = rows.select(*keys, F.arrays_zip("states", F.reverse(_backward(F.col("states"))).alias("smooth")).alias("z"))
    z = rows.select(*keys, F.explode("z").alias("z"))
    names = ["t", "mu", "slope", "r2", "obs", "m_pred", "p_pred", "gain", "innovation", "proxy", "weight", "m", "p"]
    return z.select(*keys, *[F.col(f"z.states.{c}").alias(c) for c in names], F.col("z.smooth.ms").alias("m_smooth"), F.col("z.smooth.ps").alias("p_smooth"))


def identity_violations(filtered: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Steps whose filtered mean is not the weighted average of prediction and effective proxy."""
    return filtered.filter("proxy is not null").withColumn("gap", F.abs(F.col("m") - ((1 - F.col("weight")) * F.col("m_pred") + F.col("weight") * F.col("proxy")))).filter(F.col("gap") > tolerance)


def clip_variance(total: float, mspe: Column) -> tuple[Column, Column]:
    """Explained variance within [0, total], and whether it was clipped by more than 1e-10."""
    v = F.lit(total) - mspe
    return F.greatest(F.least(v, F.lit(total)), F.lit(0.0)), (v < -1e-10) | (v > total + 1e-10)


def np_filter_smooth(mu, M, r2, obs, alpha, beta, vdelta) -> dict[str, np.ndarray]:
    """The same recursions for one series of arrays; nan: no observation."""
    n = len(mu)
    mp, pp, mf, pf = (np.empty(n) for _ in range(4))
    for t in range(n):
        mp[t], pp[t] = (mu[0], r2[0]) if t == 0 else (mu[t] + M[t] * (mf[t - 1] - mu[t - 1]), M[t] ** 2 * pf[t - 1] + r2[t])
        mf[t], pf[t] = mp[t], pp[t]
        if np.isfinite(obs[t]):
            k = pp[t] * beta[t] / (beta[t] ** 2 * pp[t] + vdelta[t])
            mf[t], pf[t] = mp[t] + k * (obs[t] - alpha[t] - beta[t] * mp[t]), max((1 - k * beta[t]) * pp[t], 0.0)
    ms, ps = mf.copy(), pf.copy()
    for t in range(n - 2, -1, -1):
        g = pf[t] * M[t + 1] / pp[t + 1] if pp[t + 1] > 0 else 0.0
        ms[t], ps[t] = mf[t] + g * (ms[t + 1] - mp[t + 1]), max(pf[t] + g * g * (ps[t + 1] - pp[t + 1]), 0.0)
    return {"m_pred": mp, "p_pred": pp, "m": mf, "p": pf, "m_smooth": ms, "p_smooth": ps}


@cache
def _hermite(nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights, which take longer to find than to use."""
    x, w = np.polynomial.hermite_e.hermegauss(nodes)
    return x, w / w.sum()


def np_measurement(total: float, explained: float, g, nodes: int = 40) -> tuple[float, float, float]:
    """alpha, beta, vdelta of g(fitted) on g(latent) by Gauss-Hermite quadrature: latent = fitted + rest, variances explained and total - explained."""
    x, w = _hermite(nodes)
    fitted = np.sqrt(max(explained, 0)) * x[:, None]
    latent = fitted + np.sqrt(max(total - explained, 0)) * x[None, :]
    a, b, ww = np.broadcast_to(g(fitted), latent.shape), g(latent), w[:, None] * w[None, :]
    ma, mb = (ww * a).sum(), (ww * b).sum()
    vb, cab = (ww * (b - mb) ** 2).sum(), (ww * (a - ma) * (b - mb)).sum()
    beta = cab / vb if vb > 0 else 0.0
    alpha = ma - beta * mb
    return float(alpha), float(beta), float(max((ww * (a - alpha - beta * b) ** 2).sum(), 1e-10))


def measurement_parameters(sites: DataFrame, maps: DataFrame, total: float) -> DataFrame:
    """site, t, alpha, beta, vdelta for sites (site, t, explained) under each site's mapping table maps (site, y, x)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for site, ts, explained, y, x in zip(*(b[c] for c in ("site", "ts", "explained", "y", "x")), strict=True):
                known = {v: np_measurement(total, v, lambda q: np.interp(q, y, x)) for v in set(explained)}  # noqa: B023
                rows += [(site, t, *known[v]) for t, v in zip(ts, explained, strict=True)]
            yield pd.DataFrame(rows, columns=["site", "t", "alpha", "beta", "vdelta"]).astype({"site": b["site"].dtype})

    steps = dealt(sites, "site").groupBy(F.col("site").alias("site")).agg(F.collect_list(F.struct(F.col("t").alias("t"), F.coalesce("explained", F.lit(float("nan"))).alias("explained"))).alias("s"))
    table = dealt(maps, "site").groupBy(F.col("site").alias("site")).agg(F.sort_array(F.collect_list(F.struct(F.col("y").alias("y"), F.col("x").alias("x")))).alias("m"))  # the points of one map
    both = steps.join(table, "site").select("site", F.col("s.t").alias("ts"), F.col("s.explained").alias("explained"), F.col("m.y").alias("y"), F.col("m.x").alias("x"))
    return both.mapInPandas(run, f"site {dict(sites.dtypes)['site']}, t int, alpha double, beta double, vdelta double")


def measurement_by_draws(sites: DataFrame, maps: DataFrame, total: float, draws: int = 1_000_000, chunks: int = 64) -> DataFrame:
    """As measurement_parameters, by random draws in place of quadrature: the co-moments of the mapped fitted and the mapped latent value.

    maps: site, y, x with y in equal steps. Sites with one explained variance share its draws; a (site, variance) case is cut into
    chunks of draws, which are dealt over the tasks, and Spark merges their moments. A draw depends on its number alone.
    """
    table = maps.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("y", "x"))).alias("m"))  # the points of one map
    table = table.select("site", F.col("m.x").alias("xs"), F.col("m")[0]["y"].alias("y0"), ((F.element_at("m", -1)["y"] - F.col("m")[0]["y"]) / (F.size("m") - 1)).alias("dy"))
    cases = sites.select("site", "explained").distinct().join(table, "site").select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    first = lambda c: F.floor(c * draws / chunks).cast("long")
    number = F.explode(F.sequence(first(F.col("chunk")), first(F.col("chunk") + 1) - 1)).alias("number")
    drawn = dealt(cases, "site", "explained", "chunk", parts=2 * chunks).select("site", "explained", "xs", "y0", "dy", number)
    fitted = F.sqrt(F.greatest("explained", F.lit(0.0))) * normal(F.col("number"), 1)
    drawn = drawn.select("*", fitted.alias("fitted"), (fitted + F.sqrt(F.greatest(total - F.col("explained"), F.lit(0.0))) * normal(F.col("number"), 2)).alias("latent"))

    def mapped(q: str) -> Column:
        last = F.size("xs") - 1
        at = F.least(F.greatest((F.col(q) - F.col("y0")) / F.col("dy"), F.lit(0.0)), last.cast("double"))
        k = F.least(F.floor(at).cast("int"), last - 1)
        return F.get("xs", k) + (at - k) * (F.get("xs", k + 1) - F.get("xs", k))

    pairs = drawn.select("site", "explained", mapped("fitted").alias("a"), mapped("latent").alias("b"))
    c = pairs.groupBy("site", "explained").agg(F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("cab"))
    beta = F.when(F.col("vb") > 0, F.col("cab") / F.col("vb")).otherwise(0.0)
    c = c.withColumn("beta", beta).select("site", "explained", (F.col("ma") - F.col("beta") * F.col("mb")).alias("alpha"), "beta", F.greatest(F.col("va") - 2 * F.col("beta") * F.col("cab") + F.col("beta") ** 2 * F.col("vb"), F.lit(1e-10)).alias("vdelta"))
    return sites.join(c, ["site", "explained"]).select("site", "t", "alpha", "beta", "vdelta")
