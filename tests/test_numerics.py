"""Property checks of the numerical operators."""

import math

import numpy as np
import pytest

from fieldloom.functions import geo, normal, ordinal
from fieldloom.operators import calibration as C, functional, glm, interpolation, kriging, mapping, prior, statespace, variogram

TOTAL, PROCESS, NUGGET, RANGE = 0.9880268170, 0.7948861045, 0.1931407125, 442.1301679


def test_normal_and_bivariate():
    x = np.linspace(-9, 9, 181)
    exact = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(normal.np_cdf(x) - exact).max() < 1e-14
    assert normal.np_bivariate_cdf(0.0, 0.0, 0.5) == pytest.approx(0.25 + math.asin(0.5) / (2 * math.pi), abs=1e-12)
    assert normal.np_rectangle(-math.inf, math.inf, -math.inf, 0.0, 0.3) == pytest.approx(0.5, abs=1e-9)


def test_ordinal_anchors():
    s = C.level_summary(TOTAL)
    assert [round(s[f"p_{k}"], 8) for k in (-2, -1, 0, 1)] == [0.06564155, 0.24183339, 0.38505010, 0.30747495]
    assert s["mean"] == pytest.approx(-0.06564155, abs=1e-8) and s["variance"] == pytest.approx(0.80756575, abs=1e-8)
    assert s["slope"] == pytest.approx(0.82583990, abs=1e-7)
    got = ordinal.np_covariance(np.array([0.1, 0.4, 0.8]), TOTAL)
    assert np.allclose(got, [0.06923543, 0.28051800, 0.57662871], atol=1e-8)
    a, b = C.simulate_levels(0.8, TOTAL, 400_000)
    assert np.cov(a, b)[0, 1] == pytest.approx(got[2], abs=0.01)


def test_calibration_finds_its_parameters_again():
    table = C.CovarianceTable(TOTAL, PROCESS)
    observed_nugget = ordinal.np_moments(TOTAL)[1] - float(table(PROCESS / TOTAL))
    assert observed_nugget == pytest.approx(0.22743779, abs=1e-6)
    sill = ordinal.np_moments(TOTAL)[1] - observed_nugget
    got = C.calibrate(observed_nugget, sill, 400.0, grid=(100.0, 1000.0, 50.0))
    assert got.total == pytest.approx(TOTAL, rel=2e-3) and got.nugget == pytest.approx(NUGGET, rel=2e-2) and 100 <= got.range_km <= 1000
    with pytest.raises(C.CalibrationError):
        C.total_curve(5.0)
    x, y = C.nugget_curve(TOTAL, 20, "monte_carlo")
    assert np.abs(y - C.nugget_curve(TOTAL, 20)[1]).max() < 0.02


def test_isotonic_and_inverse():
    assert C.isotonic([1, 3, 2, 2, 5]).tolist() == pytest.approx([1, 7 / 3, 7 / 3, 7 / 3, 5])
    assert C.monotone_inverse([0, 1, 2], [0, 10, 20], 15) == pytest.approx(1.5)
    with pytest.raises(C.CalibrationError):
        C.monotone_inverse([0, 1], [0, 1], 2)


def test_kriging_bounds_and_limits():
    p = kriging.Predictor(C.Calibration(TOTAL, PROCESS, NUGGET, RANGE))
    rng = np.random.default_rng(0)
    lon, lat, z = rng.uniform(100, 120, 40), rng.uniform(20, 40, 40), rng.integers(-2, 2, 40).astype(float)
    mean, var, jitter = p.predict(lon, lat, z, np.r_[lon[:5], 0.0], np.r_[lat[:5], -60.0])
    assert (var >= 0).all() and (var <= PROCESS + 1e-12).all() and jitter == 0
    assert abs(mean[-1]) < 1e-6 and var[-1] == pytest.approx(PROCESS, abs=1e-9)
    # direct covariance instead of the table
    km = geo.np_ellipsoid_km(lon[:, None], lat[:, None], lon[None], lat[None])
    s = ordinal.np_covariance(PROCESS / TOTAL * np.exp(-km / RANGE), TOTAL)
    np.fill_diagonal(s, p.variance)
    c = PROCESS * np.exp(-geo.np_ellipsoid_km(lon, lat, lon[0], lat[0]) / RANGE) * p.slope / TOTAL
    assert mean[0] == pytest.approx(c @ np.linalg.solve(s, z - p.mean), abs=1e-6)
    twin = kriging.factorise(np.ones((3, 3)))
    assert twin.jitter > 0


def test_distance_matrix():
    rng = np.random.default_rng(6)
    a, b, c, d = rng.uniform(90, 125, 30), rng.uniform(15, 45, 30), rng.uniform(-180, 180, 20), rng.uniform(-80, 80, 20)
    got = geo.np_ellipsoid_matrix(np.r_[a, c], np.r_[b, d], np.r_[a, c], np.r_[b, d])
    want = geo.np_ellipsoid_km(np.r_[a, c][:, None], np.r_[b, d][:, None], np.r_[a, c][None], np.r_[b, d][None])
    assert np.abs(got - want).max() < 1e-6 and np.abs(np.diag(got)).max() < 1e-6


def test_prior_updates():
    rng = np.random.default_rng(1)
    x = np.zeros((8, 60))
    for t in range(1, 60):
        x[:, t] = 0.6 * x[:, t - 1] + rng.normal(0, 0.5, 8)
    f = prior.fit(x, 1000.0, 10.0, 10.0)
    assert abs(f["slope"].mean() - 0.6) < 0.2 and (f["r2"] > 0).all()
    assert prior.variance_root(0.04, [0.03, 0.05], 1000, 13) == pytest.approx(0.04, abs=1e-9)
    n = 7
    low, dia, up, b = rng.normal(size=n), rng.normal(size=n) + 5, rng.normal(size=n), rng.normal(size=n)
    dense = np.diag(dia) + np.diag(low[1:], -1) + np.diag(up[:-1], 1)
    assert np.allclose(prior.tridiagonal(low, dia, up, b), np.linalg.solve(dense, b))
    start = (x.mean(axis=0), np.zeros(59), np.maximum(x.var(axis=0), 1e-10))
    assert prior.objective(x, f["mu"], f["slope"], f["r2"], 1000, 10, 10) < prior.objective(x, *start, 1000, 10, 10)
    assert prior.member_loss(x[0], *start[:2], np.zeros(60)) == math.inf


def test_state_space_arrays_and_measurement():
    n = 40
    rng = np.random.default_rng(2)
    obs = rng.normal(size=n)
    obs[5:9] = np.nan
    r = statespace.np_filter_smooth(np.zeros(n), np.full(n, 0.7), np.full(n, 0.3), obs, np.zeros(n), np.ones(n), np.full(n, 0.2))
    assert np.allclose(r["m"][5:9], r["m_pred"][5:9]) and (r["p_smooth"] <= r["p"] + 1e-12).all()
    a, b, v = statespace.np_measurement(1.0, 0.6, lambda q: 2 * q + 1)
    assert b == pytest.approx(0.6, abs=1e-6) and a == pytest.approx(0.4, abs=1e-6) and v == pytest.approx(4 * 0.6 * 0.4, abs=1e-6)


def test_spline_covariance():
    table = C.SplineCovarianceTable(TOTAL, PROCESS)
    between = (table.rho[1:] + table.rho[:-1]) / 2
    assert np.allclose(table(between), ordinal.np_covariance(between, TOTAL), atol=1e-8) and np.allclose(table(table.rho), table.value)
    assert table(-1.0) == table.value[0] and table(2.0) == pytest.approx(table.value[-1])
    table.value = np.repeat(table.value[::100], 100)[: len(table.rho)]  # steps: flat pieces and jumps
    table.slope = C.monotone_slopes(table.rho, table.value)
    assert (np.diff(table(np.linspace(0, PROCESS / TOTAL, 20_001))) >= -1e-12).all()
    cube = np.linspace(0, 2, 9)
    assert C.monotone_slopes(cube, cube) == pytest.approx(np.ones(9))


def test_mapping_is_monotone():
    rng = np.random.default_rng(3)
    y, x = mapping.np_map(rng.normal(15, 2, 500), rng.normal(0, 0.6, 300), np.full(300, 0.3), 1.0, 201, 801)
    assert (np.diff(x) >= -1e-12).all() and abs(np.interp(0.0, y, x) - 15) < 0.5


def test_interpolation_operator():
    rng = np.random.default_rng(4)
    p, q, v = rng.uniform(0, 10, (30, 2)), rng.uniform(0, 10, (5, 2)), rng.normal(size=30)
    assert interpolation.self_check(p, q, v) < 1e-6
    plane = 2 + 3 * p[:, 0] - p[:, 1]
    assert np.allclose(interpolation.weights(p, q) @ plane, 2 + 3 * q[:, 0] - q[:, 1], atol=1e-5)
    lam = interpolation.penalty_for_df(p, 10)
    assert np.trace(interpolation.weights(p, p, lam, 0.0)) == pytest.approx(10, abs=1e-3)


def test_curves():
    b = functional.bspline_basis(np.linspace(0, 1, 50), 0, 1, 8)
    assert np.allclose(b.sum(axis=1), 1)


def test_chi2_and_variogram_fit():
    assert glm.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert glm.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-10)
    h = np.arange(5, 1000, 10.0)
    fit = variogram.fit_exponential([{"dist": d, "gamma": g, "np": 100} for d, g in zip(h, variogram.exponential(h, 0.2, 0.6, 300.0))])
    assert fit["range"] == pytest.approx(300, rel=1e-3) and fit["nugget"] == pytest.approx(0.2, rel=1e-3)
