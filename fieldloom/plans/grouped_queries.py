"""Queries for operators that iterate or fit: checked by properties, not by SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators import calibration, functional, glm, interpolation, kriging, mapping, mixtures, prior, relational as R, statespace, validation, variogram
from fieldloom.plans import fixtures as X
from fieldloom.plans.relational_queries import _mode
from fieldloom.plans.statistical_queries import PROCESS, TOTAL, _site_variances
from fieldloom.session import stored

QUERIES: dict = {}
FIELD = calibration.Calibration(TOTAL, PROCESS, TOTAL - PROCESS, 442.1301679)


def query(f):
    QUERIES[f.__name__] = f
    return f


def _observations(spark, d) -> DataFrame:
    sites = X.records(spark, d).select("site", "lon", "lat").distinct()
    return _mode(spark, d).join(sites, "site").select("site", F.col("day").alias("year"), "lon", "lat", F.col("level").cast("double").alias("level"))


def _targets(spark, d) -> DataFrame:
    g = X.grid(spark, d).select(F.lit("grid").alias("target_set"), F.col("cell_id").cast("long").alias("target_id"), F.col("glon").alias("lon"), F.col("glat").alias("lat"))
    cities = spark.createDataFrame([("city", 1, 114.17, 22.3), ("city", 2, 121.47, 31.23), ("city", 3, 116.4, 39.9)], "target_set string, target_id long, lon double, lat double")
    return g.unionByName(cities)


@query
def kriging_year(spark, d):
    return kriging.krige(_observations(spark, d), _targets(spark, d), FIELD)


def _pilot(spark, d) -> dict:
    o = _observations(spark, d).withColumnRenamed("level", "z")
    return variogram.period_bins(o, "year", "site", 50.0, 1500.0).orderBy("bin").collect()  # a row per bin, at most 30


@query
def pilot_variogram(spark, d):
    bins = _pilot(spark, d)
    try:
        f = variogram.fit_exponential(bins)
        row = (len(bins), f["nugget"], f["sill"], f["range"], None)
    except ValueError as error:  # an invalid fit is a result: the reason
        row = (len(bins), None, None, None, str(error))
    return spark.createDataFrame([row], "bins int, nugget double, sill double, range_km double, problem string")


@query
def calibrated_field(spark, d):
    """The latent field behind the records' own pilot variogram; an invalid fit is a result: the reason."""
    return validation.recalibrated(_observations(spark, d).withColumn("repetition", F.lit(1)), "year", 50.0, 1500.0).drop("repetition")


@query
def isotonic_inverse(spark, d):
    """The latent variance at each site's observed variance of levels, by the inverse of the monotone total curve; null outside of it."""
    x, y = calibration.total_curve(1.5, 400)
    curve = spark.sparkContext.broadcast((x, y))  # 400 points

    def inverse(v: float) -> float | None:
        try:
            return calibration.monotone_inverse(*curve.value, v)
        except calibration.CalibrationError:
            return None

    def run(batches):
        for b in batches:
            yield b.assign(latent=[inverse(v) for v in b["observed"]])

    return _site_variances(spark, d).select("site", "observed").mapInPandas(run, "site long, observed double, latent double")


def _ensemble(spark, d) -> DataFrame:
    """site, member, year (a month number), value: monthly means of every location over its months that are complete for all members."""
    m = X.cube(spark, d).groupBy(F.col("location").alias("site"), "member", ((F.col("year") - 1995) * 12 + F.col("month")).alias("year")).agg((F.avg("value") / 10000 - 3).alias("value"))
    members = m.select("member").distinct().agg(F.count("*").alias("members"))
    full = m.groupBy("site", "year").agg(F.count_distinct("member").alias("n")).join(F.broadcast(members), F.col("n") == F.col("members")).select("site", "year")
    m = m.join(full, ["site", "year"], "left_semi")
    steps = full.withColumn("t", F.row_number().over(Window.partitionBy("site").orderBy("year")))
    return m.join(steps, ["site", "year"]).select("site", "member", F.col("t").cast("int").alias("year"), "value")


@query
def prior_fit_cv(spark, d):
    scores = prior.cross_validate(stored(prior.matrices(_ensemble(spark, d))))
    scores = stored(scores)
    return prior.best_weights(scores).join(scores, ["site", "w1", "w2", "w3"]).select("site", "w1", "w2", "w3", "score")


@query
def prior_parameters(spark, d):
    return prior.fit_sites(prior.matrices(_ensemble(spark, d)), (1000.0, 10**1.5, 1000.0))


def _maps(s: DataFrame) -> DataFrame:
    s = stored(s)  # means computed twice may differ in their last bit, which may change a bandwidth
    samples = s.select("site", F.col("obs").alias("value"))
    estimates = s.select(F.col("site").alias("site"), (F.col("obs") - 1).alias("yhat"), F.lit(0.4).alias("nu"))
    return mapping.quantile_maps(samples, estimates, TOTAL, 201)


@query
def city_quantile_maps(spark, d):
    return _maps(X.series(spark, d))


@query
def measurement_params(spark, d):
    s = X.series(spark, d).select("site", F.col("day").cast("int").alias("t"), F.round(0.2 + F.col("day") % 5 / F.lit(10.0), 2).alias("explained"))
    return statespace.measurement_parameters(s, _maps(X.series(spark, d)), PROCESS)


def _fitted_prior(spark, d) -> DataFrame:
    """cell_id, t, mu, slope, r2 of every location of the ensemble, fitted at fixed penalties; the first step has no slope."""
    fitted = prior_parameters(spark, d).filter("coefficient = 'Penalized ML'").groupBy(F.col("site").alias("cell_id"), F.col("year").alias("t"))
    return fitted.pivot("parameter", ["mu", "slope", "r2"]).agg(F.first("value")).withColumn("slope", F.coalesce("slope", F.lit(0.0)))


@query
def measurement_draws(spark, d):
    """Each location's measurement equation at five explained variances, by 20,000 draws."""
    s = _location_series(spark, d)
    steps = s.select("site", F.col("day").cast("int").alias("t"), F.round(0.2 + F.col("day") % 5 / F.lit(10.0), 2).alias("explained"))
    return statespace.measurement_by_draws(steps, _maps(s), PROCESS, 20_000, 8)


@query
def assimilation(spark, d):
    """The whole chain per site: mapping, measurement equations, and from the fitted prior of the nearest location filter and smoother over all its steps."""
    s = X.series(spark, d)
    steps = s.select("site", F.col("day").cast("int").alias("t"), F.lit(0.5).alias("explained"))
    m = statespace.measurement_parameters(steps, _maps(s), PROCESS)
    fitted = stored(_fitted_prior(spark, d))
    cells = X.grid(spark, d).join(fitted.select("cell_id").distinct(), "cell_id", "left_semi")
    near = R.nearest_cell(X.records(spark, d).select("site", "lon", "lat").distinct(), cells).select("site", "cell_id")
    dense = near.join(fitted, "cell_id").drop("cell_id").join(m, ["site", "t"], "left").join(s.select("site", F.col("day").alias("t"), "obs"), ["site", "t"], "left")
    filled = {"alpha": 0.0, "beta": 1.0, "vdelta": 1.0}
    return statespace.filter_series(dense.select("site", "t", "mu", "slope", "r2", "obs", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in filled.items()]), ["site"])


def _location_series(spark, d) -> DataFrame:
    """site (a location of the ensemble), day, obs: daily means over the users nearest to it."""
    near = R.nearest_cell(X.records(spark, d).select("site", "lon", "lat").distinct(), X.grid(spark, d)).select("site", "cell_id")
    return X.series(spark, d).join(near, "site").groupBy(F.col("cell_id").cast("long").alias("site"), "day").agg(F.avg("obs").alias("obs"))


@query
def location_maps_at_zero(spark, d):
    """Each location's mapping at index 0."""
    return mapping.at_index(_maps(_location_series(spark, d)))


@query
def location_assimilation(spark, d):
    """The whole chain per location, from the prior that is fitted to the ensemble at fixed penalties to the filter and the smoother."""
    s = _location_series(spark, d)
    steps = s.select("site", F.col("day").cast("int").alias("t"), F.lit(0.5).alias("explained"))
    m = statespace.measurement_parameters(steps, _maps(s), PROCESS).join(s.select("site", F.col("day").alias("t"), "obs"), ["site", "t"])
    p = _fitted_prior(spark, d).withColumnRenamed("cell_id", "site").withColumn("site", F.col("site").cast("long")).join(m, ["site", "t"], "left")
    filled = {"alpha": 0.0, "beta": 1.0, "vdelta": 1.0}
    return statespace.filter_series(p.select("site", "t", "mu", "slope", "r2", "obs", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in filled.items()]), ["site"])


def _curves(spark, d) -> DataFrame:
    return X.records(spark, d).groupBy("site", "day").agg((F.avg("value") / 100).alias("v")).withColumn("x", F.col("day").cast("double"))


@query
def spline_smooth(spark, d):
    return functional.spline_coefficients(_curves(spark, d), "site", "x", "v", 1.0, 31.0, 8)


@query
def fpca(spark, d):
    return functional.functional_pca(spline_smooth(spark, d), "site", 1.0, 31.0, 8, 5)[0]


@query
def gmm_bic(spark, d):
    return mixtures.mixture_by_bic(fpca(spark, d), "site")[1]


@query
def cluster_labels(spark, d):
    """Clusters of the model and number that BIC chooses among all."""
    labels, _ = mixtures.mixture_by_bic(fpca(spark, d), "site")
    return functional.relabel(labels, _curves(spark, d), "site", "v", {1: 3, 3: 1})


@query
def functional_boxplot(spark, d):
    return functional.functional_boxplot(_curves(spark, d), "site", "day", "v")[0]


@query
def loess(spark, d):
    c = X.records(spark, d).groupBy("level", "day").agg(F.count("*").cast("double").alias("n")).withColumn("x", F.col("day").cast("double"))
    return functional.loess(c, ["level"], "x", "n", 0.5)


def _panel(spark, d) -> DataFrame:
    rec = X.records(spark, d)
    near = R.nearest_cell(rec.select("site", "lon", "lat").distinct(), X.grid(spark, d)).select("site", "cell_id")
    hits = rec.filter("level > -1").join(near, "site").groupBy("cell_id", "day").agg(F.count_distinct("site").alias("n"))
    days = spark.range(1, 31).select(F.col("id").cast("int").alias("day"))
    p = R.dense_panel(X.grid(spark, d).select("cell_id", "glon", "glat"), days, hits, ["cell_id", "day"], "n")
    return p.select("cell_id", (F.col("n") > 0).cast("double").alias("r"), F.col("glon").alias("lon"), F.col("glat").alias("lat"), F.col("day").cast("double").alias("year"), F.log1p(F.col("cell_id") * 7 % 11).alias("population"), (F.col("cell_id") * 3 % 5).cast("double").alias("climate"))


def _models(spark, d) -> dict:
    p = _panel(spark, d)
    knots = np.asarray([(r["glon"], r["glat"]) for r in X.grid(spark, d).orderBy("cell_id").collect()])  # the grid is a parameter
    base, population, climate = [glm.surface("lon", "lat", knots), glm.smooth("year", 1.0, 30.0, 10)], glm.linear("population"), glm.linear("climate")
    return {name: glm.fit_logistic(p, "r", base + more) for name, more in (("space_time", []), ("population", [population]), ("climate", [climate]), ("both", [population, climate]))}


@query
def model_table(spark, d):
    return glm.model_table(spark, _models(spark, d))


@query
def nested_tests(spark, d):
    return glm.nested_tests(spark, _models(spark, d), [("space_time", "population"), ("space_time", "climate"), ("population", "both"), ("climate", "both")])


@query
def logistic_gam(spark, d):
    return glm.coefficient_table(spark, _models(spark, d), ["(Intercept)", "climate", "population"])


@query
def thin_plate_cities(spark, d):
    points = [(r["cell_id"], r["glon"], r["glat"]) for r in X.grid(spark, d).orderBy("cell_id").collect()]  # the grid is a parameter
    w = interpolation.weight_table(spark, points, [(1, 114.17, 22.3), (2, 121.47, 31.23), (3, 116.4, 39.9)])
    return interpolation.apply_weights(X.annual(spark, d).withColumn("location", F.col("location").cast("long")), w, ["member", "year"], "location", "temp")


@query
def within_polygon(spark, d):
    sites = X.records(spark, d).select("site", "lon", "lat").distinct()
    return R.within_polygons(sites, [[(100.0, 20.0), (112.0, 20.0), (112.0, 32.0), (100.0, 32.0)]], 150.0)


def _validated(spark, d, field) -> DataFrame:
    """Scores of 30 repetitions, each with one site held out of every day; ``field`` gives calibrations from all records and what is held out."""
    obs = stored(_observations(spark, d))
    held = stored(validation.split(obs, ["site"], "year", 30)[0])
    c = field(obs, held)
    p = kriging.krige_left_out(obs, held, c)
    nugget = F.lit(c.nugget) if not isinstance(c, dict) else F.create_map(*[F.lit(v) for k, x in c.items() for v in (k, x.nugget)])[F.col("repetition")] if c else F.lit(0.0)
    scores = validation.scored(p.withColumn("sd", F.sqrt(F.col("mspe") + nugget)))
    return validation.summary(stored(scores), ["rps", "hit", "log_score"])


@query
def repeated_validation(spark, d):
    """Under one given field."""
    return _validated(spark, d, lambda obs, held: FIELD)


@query
def recalibrated_validation(spark, d):
    """Each repetition under the field of its own training records; repetitions without a valid one are not scored."""
    return _validated(spark, d, lambda obs, held: validation.calibrations(stored(validation.recalibrated(obs, "year", 50.0, 1500.0, held=held, repetitions=30))))


@query
def recalibrated_fields(spark, d):
    """The variogram and calibration of each of 30 repetitions, from its own training records."""
    obs = stored(_observations(spark, d))
    held = validation.split(obs, ["site"], "year", 30)[0]
    return validation.recalibrated(obs, "year", 50.0, 1500.0, held=held, repetitions=30)
