"""Queries for the statistical operators that SQL expresses, each with its SQL."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import geo, ordinal
from fieldloom.functions.normal import bivariate_cdf, bivariate_cdf_sql, norm_cdf, norm_cdf_sql, norm_quantile, norm_quantile_sql
from fieldloom.functions.scalar import fixed, fixed_sql
from fieldloom.operators import calibration, mapping, relational as R, roots, statespace, validation, variogram
from fieldloom.plans import fixtures as X
from fieldloom.plans.relational_queries import MODE, _mode

QUERIES: dict = {}
ORACLES: dict = {}
TOTAL = 0.9880268170
PROCESS = 0.7948861045


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


VARIANCES = X.RECORDS + ", sites AS (SELECT site, min(lon) AS lon, min(lat) AS lat, var_pop(level) AS observed, 0.1 + var_pop(level) AS v, 0.05 + 0.35 * var_pop(level) AS nugget FROM records GROUP BY site)"


def _site_variances(spark, d) -> DataFrame:
    """site, lon, lat, observed (variance of the site's levels), and a latent variance v and nugget that grow with it."""
    spread = F.var_pop("level")
    return X.records(spark, d).groupBy("site").agg(F.min("lon").alias("lon"), F.min("lat").alias("lat"), spread.alias("observed"), (0.1 + spread).alias("v"), (0.05 + 0.35 * spread).alias("nugget"))


#: The correlation of each site with a field's value at one city.
_CITY, _RANGE = (116.4, 39.9), 442.1301679
_RHO = f"{PROCESS / TOTAL!r} * exp(-({geo.ellipsoid_km_sql('lon', 'lat', str(_CITY[0]) + '::DOUBLE', str(_CITY[1]) + '::DOUBLE')}) / {_RANGE})"


def _site_correlations(spark, d) -> DataFrame:
    km = geo.ellipsoid_km(F.col("lon"), F.col("lat"), F.lit(_CITY[0]), F.lit(_CITY[1]))
    return _site_variances(spark, d).select("site", (PROCESS / TOTAL * F.exp(-km / _RANGE)).alias("rho"))


def _moments_sql(v: str) -> tuple[str, str]:
    p = ordinal.category_probabilities_sql("0.0", f"sqrt({v})")
    return f"(-2 * {p[0]} - {p[1]} + {p[3]})", f"(4 * {p[0]} + {p[1]} + {p[3]})"


_M, _S = _moments_sql("v")


@query(f"WITH {VARIANCES} SELECT site, {fixed_sql('m', 9)} AS mean, {fixed_sql('s - m * m', 9)} AS variance FROM (SELECT site, {_M} AS m, {_S} AS s FROM sites)")
def ordinal_moments(spark, d):
    m, var = ordinal.moments(F.col("v"))
    return _site_variances(spark, d).select("site", fixed(m, 9).alias("mean"), fixed(var, 9).alias("variance"))


@query(f"WITH {VARIANCES}, c AS (SELECT site, {_RHO} AS rho FROM sites) SELECT site, {fixed_sql(ordinal.covariance_sql('rho', repr(TOTAL)), 9)} AS covariance FROM c")
def ordinal_covariance_lookup(spark, d):
    return _site_correlations(spark, d).select("site", fixed(ordinal.covariance(F.col("rho"), F.lit(TOTAL)), 9).alias("covariance"))


@query(f"WITH {VARIANCES}, c AS (SELECT site, {_RHO} AS rho FROM sites) SELECT site, {fixed_sql(ordinal.covariance_sql('rho', repr(TOTAL)), 7)} AS covariance FROM c")
def covariance_spline(spark, d):
    """The tabulated covariance at each site's correlation; the SQL has the integral itself."""
    table = spark.sparkContext.broadcast(calibration.SplineCovarianceTable(TOTAL, PROCESS))  # 1501 knots

    def look_up(batches):
        for b in batches:
            yield b[["site"]].assign(v=table.value(b["rho"].to_numpy()))

    return _site_correlations(spark, d).mapInPandas(look_up, "site long, v double").select("site", fixed(F.col("v"), 7).alias("covariance"))


@query(f"WITH {VARIANCES} SELECT site, {fixed_sql('v', 9)} AS latent, {fixed_sql(f'({_S}) - ({_M}) * ({_M})', 9)} AS observed FROM sites")
def f1_curve(spark, d):
    return _site_variances(spark, d).select("site", fixed(F.col("v"), 9).alias("latent"), fixed(ordinal.moments(F.col("v"))[1], 9).alias("observed"))


_TM, _TS = _moments_sql(repr(TOTAL))


@query(f"WITH {VARIANCES} SELECT site, {fixed_sql('nugget', 9)} AS nugget, {fixed_sql(f'({_TS}) - ({_TM}) * ({_TM}) - {ordinal.covariance_sql(f"(1 - nugget / {TOTAL!r})", repr(TOTAL))}', 9)} AS observed FROM sites")
def f2_curve(spark, d):
    cov = ordinal.covariance(1 - F.col("nugget") / TOTAL, F.lit(TOTAL))
    return _site_variances(spark, d).select("site", fixed(F.col("nugget"), 9).alias("nugget"), fixed(ordinal.moments(F.lit(TOTAL))[1] - cov, 9).alias("observed"))


PRED = MODE + ", pred AS (SELECT 1 + day % 3 AS repetition, site, day, level, (site * 7 % 13) / 6.0 - 1.2 AS yhat, 0.3 + (day % 5) / 10.0 AS sd FROM mode)"


def _pred(spark, d) -> DataFrame:
    m = _mode(spark, d)
    return m.select((1 + F.col("day") % 3).alias("repetition"), "site", "day", "level", ((F.col("site") * 7 % 13) / F.lit(6.0) - 1.2).alias("yhat"), (F.lit(0.3) + (F.col("day") % 5) / F.lit(10.0)).alias("sd"))


_P = ordinal.category_probabilities_sql("yhat", "sd")
PROB = PRED + f", prob AS (SELECT *, {_P[0]} AS p1, {_P[1]} AS p2, {_P[2]} AS p3, {_P[3]} AS p4 FROM pred)"


@query(f"WITH {PROB} SELECT site, day, {', '.join(f'{fixed_sql(f"p{i}", 9)} AS p{i}' for i in (1, 2, 3, 4))} FROM prob")
def category_probabilities(spark, d):
    s = validation.scored(_pred(spark, d))
    return s.select("site", "day", *[fixed(F.col(f"p{i}"), 9).alias(f"p{i}") for i in (1, 2, 3, 4)])


_RPS = "pow(p1 - CASE WHEN level <= -2 THEN 1 ELSE 0 END, 2) + pow(p1 + p2 - CASE WHEN level <= -1 THEN 1 ELSE 0 END, 2) + pow(p1 + p2 + p3 - CASE WHEN level <= 0 THEN 1 ELSE 0 END, 2)"


@query(f"""WITH {PROB} SELECT repetition, {fixed_sql(f'avg({_RPS})')} AS rps, {fixed_sql("avg(CASE WHEN list_position([p1, p2, p3, p4], greatest(p1, p2, p3, p4)) - 3 = level THEN 1.0 ELSE 0.0 END)")} AS accuracy,
{fixed_sql(f'avg(-ln(greatest(list_extract([p1, p2, p3, p4], level + 3), {validation.LEAST!r})))')} AS log_score FROM prob GROUP BY repetition""")
def ranked_probability_score(spark, d):
    s = validation.scored(_pred(spark, d))
    return s.groupBy("repetition").agg(fixed(F.avg("rps")).alias("rps"), fixed(R.share(F.col("hit"))).alias("accuracy"), fixed(F.avg("log_score")).alias("log_score"))


_Z = {c: NormalDist().inv_cdf(0.5 + c / 2) for c in (0.95, 0.90, 0.85, 0.80)}


@query(f"""WITH {PRED} SELECT repetition, coverage, {fixed_sql("avg(CASE WHEN yhat + z * sd >= lo AND yhat - z * sd < hi THEN 1.0 ELSE 0.0 END)")} AS compatible FROM pred,
(SELECT c::DOUBLE AS coverage, z::DOUBLE AS z FROM (VALUES {', '.join(f'({c}, {z!r})' for c, z in _Z.items())}) v(c, z)),
(SELECT l AS lev, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM (VALUES (-2, '-inf', '-1.5'), (-1, '-1.5', '-0.5'), (0, '-0.5', '0.5'), (1, '0.5', 'inf')) b(l, lo, hi)) WHERE lev = level GROUP BY ALL""")
def interval_compatibility(spark, d):
    c = validation.compatibility(_pred(spark, d))
    return c.groupBy("repetition", "coverage").agg(fixed(R.share(F.col("compatible"))).alias("compatible"))


@query(f"""WITH {PROB}, s AS (SELECT repetition, {_RPS} AS rps FROM prob), per AS (SELECT repetition, avg(rps) AS m FROM s GROUP BY 1)
SELECT CAST(count(*) AS BIGINT) AS repetitions, {fixed_sql('avg(m)')} AS rps_mean, {fixed_sql('stddev_samp(m)')} AS rps_sd, {fixed_sql('min(m)')} AS rps_min, {fixed_sql('max(m)')} AS rps_max, {fixed_sql('(SELECT avg(rps) FROM s)')} AS rps_pooled FROM per""")
def validation_summary(spark, d):
    s = validation.summary(validation.scored(_pred(spark, d)), ["rps"])
    return s.select("repetitions", *[fixed(F.col(c)).alias(c) for c in s.columns[1:]])


@query(f"""WITH {MODE}, o AS (SELECT m.day, m.site, m.level AS z, r.lon, r.lat FROM mode m JOIN (SELECT DISTINCT site, lon, lat FROM records) r USING (site)),
p AS (SELECT {geo.ellipsoid_km_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')} AS km, (a.z - b.z) * (a.z - b.z) AS sq FROM o a JOIN o b ON a.day = b.day AND a.site < b.site)
SELECT CAST(floor(km / 100) AS INT) AS bin, count(*) AS np, {fixed_sql('avg(km)', 4)} AS dist, {fixed_sql('avg(sq) / 2')} AS gamma FROM p WHERE km > 1 GROUP BY 1""")
def variogram_bins(spark, d):
    """Over the pairs of all sites of each day."""
    sites = X.records(spark, d).select("site", "lon", "lat").distinct()
    o = _mode(spark, d).join(sites, "site").withColumnRenamed("level", "z")
    b = variogram.period_bins(o, "day", "site", 100.0)
    return b.select("bin", "np", fixed(F.col("dist"), 4).alias("dist"), fixed(F.col("gamma")).alias("gamma"))


@query(f"WITH {X.SERIES} SELECT site, q, {fixed_sql(f'avg({norm_cdf_sql("((q - obs) / greatest(0.2 + day / 100.0, 1e-8))")})', 9)} AS p FROM series, (SELECT unnest([-1.0, 0.0, 0.5, 1.0, 1.5, 2.0])::DOUBLE AS q) GROUP BY site, q")
def mixture_cdf(spark, d):
    s = X.series(spark, d).withColumn("nu", F.lit(0.2) + F.col("day") / F.lit(100.0))
    return mapping.mixture_cdf(s, ["site"], "obs", "nu", [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0]).withColumn("p", fixed(F.col("p"), 9))


@query(f"WITH {X.ANNUAL} SELECT location, q, {fixed_sql(f'avg({norm_cdf_sql("((q - temp) / 2.5)")})', 9)} AS p FROM annual, (SELECT unnest([20.0, 25.0, 30.0, 35.0, 40.0])::DOUBLE AS q) GROUP BY location, q")
def kernel_cdf(spark, d):
    return mapping.kernel_cdf(X.annual(spark, d), ["location"], "temp", [20.0, 25.0, 30.0, 35.0, 40.0], 2.5).withColumn("p", fixed(F.col("p"), 9))


_GRID = [round(0.05 * i - 1, 2) for i in range(121)]


@query(f"""WITH {X.SERIES}, g AS (SELECT unnest({_GRID})::DOUBLE AS q), fx AS (SELECT q, avg({norm_cdf_sql("((q - obs) / 0.1)")}) AS p FROM series, g GROUP BY q),
mono AS (SELECT q, max(p) OVER (ORDER BY q) AS p FROM fx), lev AS (SELECT p, min(q) AS q FROM mono GROUP BY p), seg AS (SELECT p AS p0, lead(p) OVER (ORDER BY p) AS p1, q AS q0, lead(q) OVER (ORDER BY p) AS q1 FROM lev),
t AS (SELECT site, y AS q, greatest(least(avg({norm_cdf_sql("((y - obs) / 0.3)")}), 1 - 1e-12), 1e-12) AS u FROM series, (SELECT unnest([0.2, 0.6, 1.0, 1.4, 1.8])::DOUBLE AS y) GROUP BY site, y),
c AS (SELECT site, q, greatest(least(u, (SELECT max(p) FROM lev)), (SELECT min(p) FROM lev)) AS u FROM t)
SELECT site, q, {fixed_sql('CASE WHEN p1 IS NULL THEN q0 ELSE q0 + (u - p0) * (q1 - q0) / (p1 - p0) END', 7)} AS x FROM c JOIN seg ON u >= p0 AND (u < p1 OR p1 IS NULL)""")
def quantile_map(spark, d):
    s = X.series(spark, d)
    sites = s.select("site").distinct()
    source = mapping.kernel_cdf(s, [], "obs", _GRID, 0.1)
    target = mapping.mixture_cdf(s.withColumn("nu", F.lit(0.3)), ["site"], "obs", "nu", [0.2, 0.6, 1.0, 1.4, 1.8])
    table = sites.crossJoin(F.broadcast(source))  # as many rows as grid points
    return mapping.quantile_map(target, table, ["site"]).withColumn("x", fixed(F.col("x"), 7))


def _bisected_sql(targets: str, h: float) -> str:
    """roots (location, u, x) of targets (location, u) by 60 bisections over the annual means of each location that has more than one value."""
    return f"""r AS (SELECT DISTINCT t.location, greatest(least(t.u, 1 - 1e-8), 1e-8) AS u, e.lo, e.hi, 0 AS i FROM {targets} t JOIN (SELECT location, min(temp) - 200 AS lo, max(temp) + 200 AS hi FROM annual GROUP BY location HAVING max(temp) > min(temp)) e USING (location)
UNION ALL SELECT location, u, CASE WHEN p < u THEN mid ELSE lo END, CASE WHEN p < u THEN hi ELSE mid END, i + 1 FROM
(SELECT r.location, r.u, r.lo, r.hi, r.i, (r.lo + r.hi) / 2 AS mid, avg({norm_cdf_sql(f"(((r.lo + r.hi) / 2 - temp) / {h!r})")}) AS p FROM r JOIN annual ON annual.location = r.location WHERE r.i < 60 GROUP BY ALL)),
roots AS (SELECT location, u, (lo + hi) / 2 AS x FROM r WHERE i = 60)"""


_U = [0.0, 0.001, 0.1, 0.5, 0.9, 0.999]


@query(f"WITH RECURSIVE {X.ANNUAL}, t AS (SELECT location, u FROM (SELECT DISTINCT location FROM annual), (SELECT unnest({_U})::DOUBLE AS u)), {_bisected_sql('t', 2.5)} SELECT t.location, round(t.u, 4) AS u, {fixed_sql('x', 5)} AS x FROM t LEFT JOIN roots ON roots.location = t.location AND roots.u = greatest(least(t.u, 1 - 1e-8), 1e-8)")
def kernel_inverse(spark, d):
    """By bracketed root finding; the SQL bisects."""
    a = X.annual(spark, d)
    t = a.select("location").distinct().select("location", F.explode(F.array(*[F.lit(u) for u in _U])).alias("u"))
    found = roots.kernel_inverse(t, a, ["location"], "temp", 2.5, tol=1e-9)
    return found.select("location", F.round("u", 4).alias("u"), fixed(F.col("x"), 5).alias("x"))


_INDEX = X.ANNUAL + ", est AS (SELECT location, year, avg(temp) / 20 - 2 AS yhat, 0.2 + year % 5 / 20.0 AS sd FROM annual GROUP BY ALL)"
_INDEX_U = f"avg({norm_cdf_sql('((w.y - est.yhat) / est.sd)')})"


def _index_map(spark, d) -> tuple[DataFrame, DataFrame]:
    a = X.annual(spark, d)
    est = a.groupBy("location", "year").agg((F.avg("temp") / 20 - 2).alias("yhat")).withColumn("sd", F.lit(0.2) + F.col("year") % 5 / F.lit(20.0))
    return roots.map_index(est, a, ["location"], "year", "temp", 2.5, tol=1e-9)


@query(f"""WITH RECURSIVE {_INDEX}, w AS (SELECT location, i, -2 + 3 * i / 149.0::DOUBLE AS y FROM (SELECT DISTINCT location FROM est), (SELECT unnest(range(0, 150)) AS i)),
t AS (SELECT location, i, any_value(w.y) AS y, greatest(least({_INDEX_U}, 1 - 1e-8), 1e-8) AS u FROM w JOIN est USING (location) GROUP BY location, i), {_bisected_sql('t', 2.5)}
SELECT location, CAST(i AS BIGINT) AS place, {fixed_sql('x', 5)} AS x FROM t LEFT JOIN roots USING (location, u)""")
def index_map_curve(spark, d):
    """The map of each location's index to the scale of its ensemble, at 150 places from -2 to 1."""
    curve = _index_map(spark, d)[0]
    return curve.select("location", F.round((F.col("y") + 2) * 149 / 3).cast("long").alias("place"), fixed(F.col("x"), 5).alias("x"))


@query(f"""WITH RECURSIVE {_INDEX}, w AS (SELECT location, year, k, yhat + k * sd AS y FROM est, (SELECT unnest([-1, 0, 1]) AS k)),
t AS (SELECT w.location, w.year, w.k, greatest(least({_INDEX_U}, 1 - 1e-8), 1e-8) AS u FROM w JOIN est ON est.location = w.location GROUP BY ALL), {_bisected_sql('t', 2.5)},
m AS (SELECT location, year, max(x) FILTER (k = 0) AS x, max(x) FILTER (k = -1) AS a, max(x) FILTER (k = 1) AS b FROM t LEFT JOIN roots USING (location, u) GROUP BY ALL)
SELECT location, year, {fixed_sql('x', 5)} AS x, {fixed_sql('least(a, b)', 5)} AS lower, {fixed_sql('greatest(a, b)', 5)} AS upper FROM m""")
def index_map_band(spark, d):
    """Each year's index on the scale of the ensemble, with the band of one standard deviation."""
    band = _index_map(spark, d)[1]
    return band.select("location", "year", *[fixed(F.col(c), 5).alias(c) for c in ("x", "lower", "upper")])


DENSE = X.SERIES + """, days AS (SELECT unnest(range(1, 31))::INTEGER AS day), dense AS (SELECT s.site, days.day AS t, CAST(s.site % 7 AS DOUBLE) / 10 + 0.8 AS mu, 0.5 + (days.day % 4) / 10.0 AS slope, 0.2 + (s.site % 3) / 10.0 AS r2, series.obs,
0.1::DOUBLE AS alpha, 0.9::DOUBLE AS beta, 0.3::DOUBLE AS v FROM (SELECT DISTINCT site FROM records) s CROSS JOIN days LEFT JOIN series ON series.site = s.site AND series.day = days.day)"""


def _dense(spark, d) -> DataFrame:
    s = X.series(spark, d)
    days = spark.range(1, 31).select(F.col("id").cast("int").alias("day"))
    grid = s.select("site").distinct().crossJoin(F.broadcast(days)).join(s, ["site", "day"], "left")
    return grid.select(
        "site", F.col("day").alias("t"), (F.col("site") % 7 / F.lit(10.0) + 0.8).alias("mu"), (F.lit(0.5) + F.col("day") % 4 / F.lit(10.0)).alias("slope"), (F.lit(0.2) + F.col("site") % 3 / F.lit(10.0)).alias("r2"), "obs",
        F.lit(0.1).alias("alpha"), F.lit(0.9).alias("beta"), F.lit(0.3).alias("vdelta"),
    )


FILTER = DENSE + """, f AS (SELECT site, t, mu, slope, r2, mu AS mp, r2 AS pp, CASE WHEN obs IS NULL THEN mu ELSE mu + r2 * beta / (beta * beta * r2 + v) * (obs - alpha - beta * mu) END AS m,
CASE WHEN obs IS NULL THEN r2 ELSE greatest((1 - r2 * beta / (beta * beta * r2 + v) * beta) * r2, 0.0) END AS p FROM dense WHERE t = 1
UNION ALL SELECT site, t, mu, slope, r2, mp, pp, CASE WHEN obs IS NULL THEN mp ELSE mp + pp * beta / (beta * beta * pp + v) * (obs - alpha - beta * mp) END, CASE WHEN obs IS NULL THEN pp ELSE greatest((1 - pp * beta / (beta * beta * pp + v) * beta) * pp, 0.0) END
FROM (SELECT n.*, n.mu + n.slope * (f.m - f.mu) AS mp, n.slope * n.slope * f.p + n.r2 AS pp FROM f JOIN dense n ON n.site = f.site AND n.t = f.t + 1))"""


@query(f"WITH RECURSIVE {FILTER} SELECT site, t, {fixed_sql('mp')} AS m_pred, {fixed_sql('pp')} AS p_pred, {fixed_sql('m')} AS m, {fixed_sql('p')} AS p FROM f")
def kalman_filter(spark, d):
    f = statespace.filter_series(_dense(spark, d), ["site"])
    return f.select("site", "t", *[fixed(F.col(c)).alias(c) for c in ("m_pred", "p_pred", "m", "p")])


@query(f"""WITH RECURSIVE {FILTER}, s AS (SELECT site, t, m AS ms, p AS ps FROM f WHERE t = 30 UNION ALL SELECT c.site, c.t, c.m + g * (s.ms - c.nmp), greatest(c.p + g * g * (s.ps - c.npp), 0.0)
FROM s JOIN (SELECT a.site, a.t, a.m, a.p, b.mp AS nmp, b.pp AS npp, CASE WHEN b.pp > 0 THEN a.p * b.slope / b.pp ELSE 0.0 END AS g FROM f a JOIN f b ON b.site = a.site AND b.t = a.t + 1) c ON c.site = s.site AND c.t = s.t - 1)
SELECT site, t, {fixed_sql('ms')} AS m_smooth, {fixed_sql('ps')} AS p_smooth FROM s""")
def rts_smoother(spark, d):
    f = statespace.filter_series(_dense(spark, d), ["site"])
    return f.select("site", "t", fixed(F.col("m_smooth")).alias("m_smooth"), fixed(F.col("p_smooth")).alias("p_smooth"))


_HOURS = """hourly AS (SELECT event_type, CAST((day(ts) - 1) * 24 + hour(ts) AS INT) AS t, avg(value) / 100 AS obs FROM events GROUP BY ALL),
h AS (SELECT e.event_type, g.t, 1.0::DOUBLE + g.t % 24 / 24.0::DOUBLE AS mu, 0.6::DOUBLE AS slope, 0.3::DOUBLE AS r2, obs, 0.1::DOUBLE AS alpha, 0.9::DOUBLE AS beta, 0.2::DOUBLE AS v
FROM (SELECT DISTINCT event_type FROM events) e CROSS JOIN (SELECT CAST(unnest(range(0, 720)) AS INT) AS t) g LEFT JOIN hourly o ON o.event_type = e.event_type AND o.t = g.t),
f AS (SELECT event_type, t, mu, slope, r2, mu AS mp, r2 AS pp, CASE WHEN obs IS NULL THEN mu ELSE mu + r2 * beta / (beta * beta * r2 + v) * (obs - alpha - beta * mu) END AS m,
CASE WHEN obs IS NULL THEN r2 ELSE greatest((1 - r2 * beta / (beta * beta * r2 + v) * beta) * r2, 0.0) END AS p FROM h WHERE t = 0
UNION ALL SELECT event_type, t, mu, slope, r2, mp, pp, CASE WHEN obs IS NULL THEN mp ELSE mp + pp * beta / (beta * beta * pp + v) * (obs - alpha - beta * mp) END, CASE WHEN obs IS NULL THEN pp ELSE greatest((1 - pp * beta / (beta * beta * pp + v) * beta) * pp, 0.0) END
FROM (SELECT n.*, n.mu + n.slope * (f.m - f.mu) AS mp, n.slope * n.slope * f.p + n.r2 AS pp FROM f JOIN h n ON n.event_type = f.event_type AND n.t = f.t + 1)),
s AS (SELECT event_type, t, m AS ms, p AS ps FROM f WHERE t = 719 UNION ALL SELECT c.event_type, c.t, c.m + g * (s.ms - c.nmp), greatest(c.p + g * g * (s.ps - c.npp), 0.0)
FROM s JOIN (SELECT a.event_type, a.t, a.m, a.p, b.mp AS nmp, b.pp AS npp, CASE WHEN b.pp > 0 THEN a.p * b.slope / b.pp ELSE 0.0 END AS g FROM f a JOIN f b ON b.event_type = a.event_type AND b.t = a.t + 1) c ON c.event_type = s.event_type AND c.t = s.t - 1)"""


@query(f"WITH RECURSIVE {_HOURS} SELECT event_type, t, {fixed_sql('m')} AS m, {fixed_sql('p')} AS p, {fixed_sql('ms')} AS m_smooth, {fixed_sql('ps')} AS p_smooth FROM f JOIN s USING (event_type, t)")
def long_series_filter(spark, d):
    """The filter and smoother of each event type's hours, in blocks of 64."""
    from fieldloom.operators.longseries import filter_long_series

    e = X.read(spark, d, "events")
    hourly = e.groupBy("event_type", ((F.dayofmonth("ts") - 1) * 24 + F.hour("ts")).alias("t")).agg((F.avg("value") / 100).alias("obs"))
    hours = e.select("event_type").distinct().crossJoin(F.broadcast(spark.range(720).select(F.col("id").cast("int").alias("t"))))
    fixed_values = {"slope": 0.6, "r2": 0.3, "alpha": 0.1, "beta": 0.9, "vdelta": 0.2}
    rows = hours.join(hourly, ["event_type", "t"], "left").select("event_type", "t", (1 + F.col("t") % 24 / F.lit(24.0)).alias("mu"), "obs", *[F.lit(v).alias(k) for k, v in fixed_values.items()])
    f = filter_long_series(rows, ["event_type"], 64)
    return f.select("event_type", "t", *[fixed(F.col(c)).alias(c) for c in ("m", "p", "m_smooth", "p_smooth")])


@query("SELECT 0::BIGINT AS violations")
def filter_identity(spark, d):
    return statespace.identity_violations(statespace.filter_series(_dense(spark, d), ["site"])).agg(F.count("*").alias("violations"))


LAG = X.ANNUAL + ", lagged AS (SELECT location, member, year, temp / 10 - 3 AS x, lag(temp / 10 - 3) OVER (PARTITION BY location, member ORDER BY year) AS before FROM annual)"


def _lagged(spark, d) -> DataFrame:
    a = X.annual(spark, d).withColumn("x", F.col("temp") / 10 - 3)
    return a.withColumn("before", F.lag("x").over(Window.partitionBy("location", "member").orderBy("year")))


@query(f"WITH {LAG} SELECT location, member, {fixed_sql('sum(CASE WHEN before IS NULL THEN (ln(0.3) + x * x / 0.3) / 2 ELSE (ln(0.2) + (x - 0.4 * before) * (x - 0.4 * before) / 0.2) / 2 END)')} AS loss FROM lagged GROUP BY location, member")
def ar1_loglik(spark, d):
    r = F.col("x") - 0.4 * F.col("before")
    loss = F.when(F.col("before").isNull(), (math.log(0.3) + F.col("x") * F.col("x") / 0.3) / 2).otherwise((math.log(0.2) + r * r / 0.2) / 2)
    return _lagged(spark, d).groupBy("location", "member").agg(fixed(F.sum(loss)).alias("loss"))


@query(f"WITH {LAG} SELECT location, year, {fixed_sql('avg((x - 0.4 * coalesce(before, 0)) * (x - 0.4 * coalesce(before, 0)))')} AS s FROM lagged GROUP BY location, year")
def innovation_moments(spark, d):
    r = F.col("x") - 0.4 * F.coalesce("before", F.lit(0.0))
    return _lagged(spark, d).groupBy("location", "year").agg(fixed(F.avg(r * r)).alias("s"))


@query(f"WITH {X.SERIES} SELECT site, day, {fixed_sql('obs - 1.96 * sqrt(0.04 + day / 1000.0)')} AS lower, {fixed_sql('obs + 1.96 * sqrt(0.04 + day / 1000.0)')} AS upper, greatest(least({PROCESS} - day / 20.0, {PROCESS}), 0.0) AS explained FROM series")
def confidence_ribbon(spark, d):
    half = 1.96 * F.sqrt(F.lit(0.04) + F.col("day") / F.lit(1000.0))
    return X.series(spark, d).select("site", "day", fixed(F.col("obs") - half).alias("lower"), fixed(F.col("obs") + half).alias("upper"), statespace.clip_variance(PROCESS, F.col("day") / F.lit(20.0))[0].alias("explained"))


@query(f"SELECT event_id, {fixed_sql(norm_cdf_sql('x'), 12)} AS p FROM (SELECT event_id, value / 50.0 - 3 AS x FROM events)")
def normal_cdf(spark, d):
    return X.read(spark, d, "events").select("event_id", fixed(norm_cdf(F.col("value") / 50.0 - 3), 12).alias("p"))


@query(f"SELECT event_id, {fixed_sql(norm_quantile_sql('p'), 9)} AS x FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN pow(10.0::DOUBLE, -1 - event_id % 13) ELSE value / (value + 100.0) END AS p FROM events)")
def normal_quantile(spark, d):
    """At probabilities that follow the values, and for every tenth event far into the tail."""
    far = F.pow(F.lit(10.0), (-1 - F.col("event_id") % 13).cast("double"))
    p = F.when(F.col("event_id") % 10 == 0, far).otherwise(F.col("value") / (F.col("value") + 100.0))
    return X.read(spark, d, "events").select("event_id", fixed(norm_quantile(p), 9).alias("x"))


_MBD = X.ANNUAL + """, full_loc AS (SELECT location, year, avg(temp) AS v FROM annual GROUP BY ALL), yrs AS (SELECT year FROM full_loc GROUP BY year HAVING count(*) = (SELECT max(n) FROM (SELECT count(*) AS n FROM full_loc GROUP BY year))),
c AS (SELECT f.* FROM full_loc f JOIN yrs USING (year)), r AS (SELECT location, year, v, rank() OVER (PARTITION BY year ORDER BY v) AS lo, rank() OVER (PARTITION BY year ORDER BY v DESC) AS hi, count(*) OVER (PARTITION BY year) AS n FROM c)"""


@query(f"WITH {_MBD} SELECT location, {fixed_sql('avg(CASE WHEN n > 1 THEN ((lo - 1.0) * (hi - 1.0) + n - 1) / (n * (n - 1) / 2.0) ELSE 1.0 END)')} AS depth FROM r GROUP BY location")
def band_depth(spark, d):
    from fieldloom.operators.functional import modified_band_depth

    return modified_band_depth(_location_curves(spark, d), "location", "year", "v").withColumn("depth", fixed(F.col("depth")))


def _location_curves(spark, d) -> DataFrame:
    """location, year, v: the members' mean in the years that the most locations have."""
    a = X.annual(spark, d).groupBy("location", "year").agg(F.avg("temp").alias("v"))
    n = a.groupBy("year").agg(F.count("*").alias("n"))
    most = n.agg(F.max("n").alias("m"))
    return a.join(n.join(F.broadcast(most), n["n"] == most["m"]).select("year"), "year", "left_semi")


@query(
    f"""WITH {_MBD}, dep AS (SELECT location, avg(CASE WHEN n > 1 THEN ((lo - 1.0) * (hi - 1.0) + n - 1) / (n * (n - 1) / 2.0) ELSE 1.0 END) AS depth FROM r GROUP BY location),
rk AS (SELECT location, row_number() OVER (ORDER BY round(depth, 9) DESC, location) AS place, count(*) OVER () AS n FROM dep), j AS (SELECT year, v, place, place <= (n + 1) // 2 AS central FROM c JOIN rk USING (location)),
b AS (SELECT year, min(v) FILTER (central) AS lower, max(v) FILTER (central) AS upper, max(v) FILTER (place = 1) AS median FROM j GROUP BY year)
SELECT year, {fixed_sql('lower')} AS lower, {fixed_sql('upper')} AS upper, {fixed_sql('median')} AS median, {fixed_sql('lower - 1.5 * (upper - lower)')} AS low_fence, {fixed_sql('upper + 1.5 * (upper - lower)')} AS high_fence FROM b"""
)
def location_boxplot(spark, d):
    from fieldloom.operators.functional import functional_boxplot

    box = functional_boxplot(_location_curves(spark, d), "location", "year", "v")[0]
    return box.select("year", *[fixed(F.col(c)).alias(c) for c in ("lower", "upper", "median", "low_fence", "high_fence")])


@query(f"WITH {VARIANCES}, l AS (SELECT site, avg(level) AS m, avg(value) / 60 - 2 AS x FROM records GROUP BY site) SELECT site, {fixed_sql(bivariate_cdf_sql('x', 'y', 'r'), 10)} AS p FROM (SELECT site, x, 0.5 * m AS y, 0.45 * m AS r FROM l)")
def bivariate_normal_cdf(spark, d):
    """At two means of each site, with a correlation that follows its level."""
    m = F.avg("level")
    t = X.records(spark, d).groupBy("site").agg((F.avg("value") / 60 - 2).alias("x"), (0.5 * m).alias("y"), (0.45 * m).alias("r"))
    return t.select("site", fixed(bivariate_cdf(F.col("x"), F.col("y"), F.col("r")), 10).alias("p"))
