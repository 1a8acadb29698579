"""Draws as column expressions, the measurement equation from them, nearest cells on the sphere, and the inverse of the total curve."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import draws
from fieldloom.functions.ordinal import np_moments
from fieldloom.operators import calibration, relational, statespace


def test_draws_depend_on_their_number_alone(spark):
    frame = spark.range(200_000).select("id", draws.normal(F.col("id"), 1).alias("a"), draws.normal(F.col("id"), 2).alias("b"))
    m = frame.agg(F.avg("a"), F.var_pop("a"), F.corr("a", "b"), F.skewness("a"), F.kurtosis("a"), F.count_distinct("a")).first()
    assert abs(m[0]) < 0.01 and abs(m[1] - 1) < 0.015 and abs(m[2]) < 0.01 and abs(m[3]) < 0.02 and abs(m[4]) < 0.05 and m[5] > 199_990
    again = spark.range(3, 9, numPartitions=3).select("id", draws.normal(F.col("id"), 1).alias("a"))
    assert sorted(again.collect()) == sorted(frame.filter("id >= 3 and id < 9").select("id", "a").collect())


def test_a_million_draws_agree_with_quadrature(spark):
    y = np.linspace(-6, 6, 201)
    curves = {1: 0.8 * y + 0.1 * y**2, 2: np.tanh(y) * 2}
    maps = spark.createDataFrame([(s, float(a), float(b)) for s, x in curves.items() for a, b in zip(y, x, strict=True)], "site int, y double, x double")
    steps = spark.createDataFrame([(s, t, 0.2 + 0.2 * (t % 2)) for s in (1, 2) for t in (1, 2, 3)], "site int, t int, explained double")
    got = {(r.site, r.t): (r.alpha, r.beta, r.vdelta) for r in statespace.measurement_by_draws(steps, maps, 0.8).collect()}
    want = {(r.site, r.t): (r.alpha, r.beta, r.vdelta) for r in statespace.measurement_parameters(steps, maps, 0.8).collect()}
    assert got.keys() == want.keys() and len(got) == 6
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=0.004), k
    other = {(r.site, r.t): (r.alpha, r.beta, r.vdelta) for r in statespace.measurement_by_draws(steps.repartition(3), maps, 0.8, chunks=7).collect()}
    assert all(other[k] == pytest.approx(got[k], rel=1e-9) for k in got)


def test_nearest_on_sphere_beyond_the_broadcast_limit(spark):
    rng = np.random.default_rng(3)
    n = 50_000
    cells = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(rng.uniform(-180, 180, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n))), strict=True)) if not (-60 < a < 40 and -40 < b < 40)]
    grid = spark.createDataFrame(cells, "cell_id int, glon double, glat double")
    places = [(179.99, 0.0), (-179.99, 0.0), (0.0, 90.0), (123.0, -90.0), (-10.0, 0.0), (5.0, -3.0), *zip(rng.uniform(-180, 180, 60).tolist(), rng.uniform(-90, 90, 60).tolist(), strict=True)]
    points = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(places)] + [(99, None, 1.0)], "id int, lon double, lat double")
    got = {r.id: (r.cell_id, r.km) for r in relational.nearest_on_sphere(points, grid).collect()}
    assert got.pop(99) == (None, None) and len(got) == len(places)
    a, b = np.radians(np.array(cells)[:, 1:].T)
    for k, (lon, lat) in enumerate(places):
        x, y = np.radians([lon, lat])
        h = np.sin((b - y) / 2) ** 2 + np.cos(b) * np.cos(y) * np.sin((a - x) / 2) ** 2
        assert got[k][0] == cells[int(np.argmin(h))][0] and got[k][1] == pytest.approx(2 * 6371.0088 * np.arcsin(np.sqrt(h.min())), rel=1e-9)


def test_the_total_curve_is_inverted(spark):
    x, y = calibration.total_curve(1.5, 400)
    for observed in (0.3, 0.7, 1.2, 1.5):
        assert np_moments(calibration.monotone_inverse(x, y, observed))[1] == pytest.approx(observed, abs=2e-3)
