"""Scores of held-out predictions."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.ordinal import CUTS, LEVELS, category_probabilities
from fieldloom.operators import calibration, variogram

#: The least positive normal double.
LEAST = 2.2250738585072014e-308


def scored(predictions: DataFrame, mean: str = "yhat", sd: str = "sd", observed: str = "level") -> DataFrame:
    """Adds p1..p4, rps (first three cumulative terms), hit (first most probable category) and log_score."""
    p = category_probabilities(F.col(mean), F.col(sd))
    with_p = predictions.withColumns({f"p{i + 1}": q for i, q in enumerate(p)})
    names = [f"p{i + 1}" for i in range(len(LEVELS))]
    upto: Column = F.lit(0.0)
    rps: Column = F.lit(0.0)
    for name, level in list(zip(names, LEVELS, strict=True))[:-1]:
        upto = upto + F.col(name)
        d = upto - F.when(F.col(observed) <= level, 1.0).otherwise(0.0)
        rps = rps + d * d
    place = F.array_position(F.array(*[F.lit(v) for v in LEVELS]), F.col(observed).cast("double")).cast("int")
    array = F.array(*[F.col(n) for n in names])
    best = F.array_position(array, F.array_max(array)).cast("int")
    return with_p.withColumns({"rps": rps, "hit": best == place, "log_score": -F.log(F.greatest(F.element_at(array, place), F.lit(LEAST)))})


def bad_probability_rows(scores: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    return scores.filter(F.abs(F.col("p1") + F.col("p2") + F.col("p3") + F.col("p4") - 1) > tolerance)


def censoring_interval(observed: Column) -> tuple[Column, Column]:
    edges = [float("-inf"), *CUTS, float("inf")]
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for k, level in enumerate(LEVELS):
        lo, hi = F.when(observed == level, edges[k]).otherwise(lo), F.when(observed == level, edges[k + 1]).otherwise(hi)
    return lo, hi


def compatibility(predictions: DataFrame, levels: tuple[float, ...] = (0.95, 0.90, 0.85, 0.80), mean: str = "yhat", sd: str = "sd", observed: str = "level") -> DataFrame:
    """The rows once per coverage level, with whether the predictive interval meets the observed category's: upper >= lo and lower < hi."""
    z = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), F.lit(NormalDist().inv_cdf(0.5 + c / 2)).alias("z")) for c in levels]))
    rows = predictions.select("*", z.alias("__c")).select("*", "__c.coverage", F.col("__c.z").alias("z")).drop("__c")
    lo, hi = censoring_interval(F.col(observed))
    return rows.withColumn("compatible", (F.col(mean) + F.col("z") * F.col(sd) >= lo) & (F.col(mean) - F.col("z") * F.col(sd) < hi))


def summary(scores: DataFrame, columns: list[str], repetition: str = "repetition") -> DataFrame:
    """One row: mean over repetitions of the mean, their sd, and the pooled mean over rows."""
    per = scores.groupBy(repetition).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in columns])
    means = per.agg(F.count("*").alias("repetitions"), *[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))])
    return means.crossJoin(F.broadcast(scores.agg(*[F.avg(F.col(c).cast("double")).alias(f"{c}_pooled") for c in columns])))  # one row each


def split(records: DataFrame, site: list[str], group: str, repetitions: int, least: int = 5, seed: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per repetition the held-out site of each group with at least ``least`` sites, and the training records: all others of that repetition."""
    from fieldloom.operators.relational import first_by

    sites = records.select(*site, group).distinct()
    big = sites.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(group)
    reps = sites.join(big, group, "left_semi").select("*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    draw = F.md5(F.concat_ws("|", F.col("repetition") + F.lit(seed - 1), *[F.col(c).cast("string") for c in [*site, group]]))
    held = first_by(reps.withColumn("__draw", draw), [group, "repetition"], ["__draw", *site]).drop("__draw")
    every = records.select("*", F.explode(F.sequence(F.lit(1), F.lit(repetitions))).alias("repetition"))
    return held, every.join(held, [*site, group, "repetition"], "left_anti")


FIELDS = "pilot_nugget double, pilot_sill double, pilot_range_km double, total double, process double, nugget double, range_km double, problem string"


def recalibrated(training: DataFrame, period: str, width: float = 10.0, cutoff: float = 1200.0, by: str = "repetition", value: str = "level", held: DataFrame | None = None, repetitions: int = 0) -> DataFrame:
    """Each repetition's own variogram of its training records, and the calibration that follows from it; a row per repetition.

    What can't be fitted or calibrated is null, with the reason in ``problem``. Repetitions are fitted apart from each other. With ``held``
    (repetition, period, site) training holds the records of all repetitions once, and each of the ``repetitions`` leaves its held-out sites out.
    """
    if held is None:
        bins = variogram.period_bins(training, period, "site", width, cutoff, value=value, by=by)
    else:
        bins = variogram.period_bins_left_out(training, held, repetitions, period, "site", width, cutoff, value=value, repetition=by)
    names = [by, *(f.split()[0] for f in FIELDS.split(", "))]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pilot, latent, problem = [None] * 3, [None] * 4, None
        try:
            f = variogram.fit_exponential(pdf.sort_values("bin").to_dict("records"))
            pilot = [f["nugget"], f["sill"], f["range"]]
            c = calibration.calibrate(*pilot)
            latent = [c.total, c.process, c.nugget, c.range_km]
        except (ValueError, np.linalg.LinAlgError) as error:  # an invalid fit is a result: the reason
            problem = str(error)
        return pd.DataFrame([[pdf[by].iloc[0], *pilot, *latent, problem]], columns=names)

    parts = int(training.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bins.repartition(parts, by).groupBy(by).applyInPandas(fit, f"{by} {dict(bins.dtypes)[by]}, {FIELDS}")


def calibrations(fields: DataFrame, by: str = "repetition") -> dict[int, calibration.Calibration]:
    """The calibrations of the repetitions that have one; as many rows as repetitions."""
    return {r[by]: calibration.Calibration(r["total"], r["process"], r["nugget"], r["range_km"]) for r in fields.filter("problem IS NULL").collect()}
