"""Repetitions of a validation, each with the variogram and the calibration of its own training records."""

import numpy as np
import pandas as pd
import pytest

from fieldloom.functions.geo import np_ellipsoid_matrix
from fieldloom.operators import calibration, kriging, validation, variogram


@pytest.fixture(scope="module")
def records(spark):
    rng = np.random.default_rng(11)
    lon, lat = rng.uniform(105, 118, 60), rng.uniform(24, 36, 60)
    root = np.linalg.cholesky(0.8 * np.exp(-np_ellipsoid_matrix(lon, lat, lon, lat) / 400) + 1e-9 * np.eye(60))
    rows = []
    for year in range(40):
        level = np.clip(np.rint(root @ rng.standard_normal(60) + np.sqrt(0.2) * rng.standard_normal(60)), -2, 1)
        rows += [(site, year, lon[site], lat[site], level[site]) for site in range(60)]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["site", "year", "lon", "lat", "level"]))


def test_each_repetition_has_its_own_field(spark, records):
    held, training = validation.split(records, ["site"], "year", 3)
    fields = validation.recalibrated(training, "year", 50.0, 1200.0)
    found = {r["repetition"]: r for r in fields.collect()}
    assert sorted(found) == [1, 2, 3] and all(r["problem"] is None for r in found.values())
    assert len({r["total"] for r in found.values()}) == 3
    one = variogram.period_bins(training.filter("repetition = 2"), "year", "site", 50.0, 1200.0, value="level").orderBy("bin").collect()
    f = variogram.fit_exponential(one)
    c = calibration.calibrate(f["nugget"], f["sill"], f["range"])
    assert found[2]["pilot_range_km"] == pytest.approx(f["range"], rel=1e-6) and found[2]["range_km"] == pytest.approx(c.range_km, rel=1e-4)
    assert found[2]["total"] == pytest.approx(1.0, abs=0.2) and found[2]["process"] == pytest.approx(0.8, abs=0.25)
    held = held.join(records, ["site", "year"])
    own = validation.calibrations(fields)
    got = kriging.krige_held_out(training, held, {k: own[k] for k in (1, 2)}, ["repetition", "year"]).toPandas()
    assert sorted(got["repetition"].unique()) == [1, 2] and len(got) == 80
    alone = kriging.krige_held_out(training.filter("repetition = 2"), held.filter("repetition = 2"), own[2], ["repetition", "year"]).toPandas()
    assert np.allclose(got[got["repetition"] == 2].sort_values("year")["yhat"], alone.sort_values("year")["yhat"])


def test_an_invalid_fit_gives_its_reason(spark, records):
    flat = records.filter("year < 2 AND site < 4").selectExpr("*", "1 AS repetition")
    (row,) = validation.recalibrated(flat, "year", 5000.0, 6000.0).collect()
    assert row["total"] is None and "three bins" in row["problem"]


def test_left_out_sites_agree_with_training_without_them(spark, records):
    """One factor of all records and a rank-one correction, against a factor for each repetition's own training records."""
    held, training = validation.split(records, ["site"], "year", 3)
    fields = {k: calibration.Calibration(1.0, 0.8 - k / 20, 0.2 + k / 20, 300.0 + 50 * k) for k in (1, 3)}
    levels = held.join(records, ["site", "year"])
    order = ["repetition", "year"]
    for c in (fields, fields[1]):
        want = kriging.krige_held_out(training, levels, c, order).toPandas().sort_values(order)
        for chunk in (1, 10):
            got = kriging.krige_left_out(records, held, c, chunk=chunk).toPandas().sort_values(order)
            assert len(got) == len(want) == (80 if c is fields else 120)
            for k in ("site", "level", "yhat", "mspe"):
                assert np.allclose(got[k], want[k], rtol=1e-9, atol=1e-9), k


def test_factor_solves_by_substitution():
    rng = np.random.default_rng(2)
    for n in (1, 127, 128, 300):
        root = rng.standard_normal((n, n))
        m = root @ root.T + n * np.eye(n)
        f, b = kriging.factorise(m), rng.standard_normal((n, 3))
        assert np.allclose(m @ f.solve(b), b) and np.allclose(f.lower @ f.forward(b[:, 0]), b[:, 0])


def test_near_calibrations_share_a_factor(monkeypatch):
    """30 repetitions of a period with their own calibrations: one factor, and what 30 factors give; a calibration far from the others is left to its own."""
    rng = np.random.default_rng(9)
    lon, lat, n, level = rng.uniform(105, 118, 600), rng.uniform(24, 36, 600), rng.integers(1, 3, 600).astype(float), rng.integers(-2, 2, 600).astype(float)
    several = [kriging.Predictor(calibration.Calibration(1.0 + k / 900, 0.6 + k / 700, 0.4 + k / 900 - k / 700, 400.0 + k)) for k in range(30)]
    several.append(kriging.Predictor(calibration.Calibration(1.0, 0.1, 0.9, 30.0)))
    places, own = [rng.integers(0, 600, 1 + k % 2) for k in range(31)], [np.zeros(1 + k % 2) for k in range(31)]
    right = [p.right(lon, lat, level, at) for p, at in zip(several, places)]
    factors, made = [], kriging.Tiles._factorise
    monkeypatch.setattr(kriging.Tiles, "_factorise", lambda self, tile: (factors.append(1), made(self, tile))[1])
    sums = kriging.near_sums(several, several[15], lon, lat, n, right)
    assert len(factors) == 1 and [s is None for s in sums] == [False] * 30 + [True]
    for k in range(30):
        want = several[k].left_out(lon, lat, level, n, several[k].factor(lon, lat, n), places[k], own[k])
        assert np.allclose(several[k].without(sums[k], level, n, places[k], own[k]), want, rtol=1e-10, atol=1e-11)
