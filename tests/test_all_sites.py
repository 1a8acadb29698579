"""The mapping, measurement and assimilation queries hold every site of the table."""

from collections import defaultdict

import numpy as np
import pytest

from fieldloom.operators import mapping, statespace
from fieldloom.plans import fixtures as X, grouped_queries as G
from fieldloom.plans.statistical_queries import PROCESS, TOTAL

DIR = "/root/testdata/sf0.001"


def test_chain_covers_every_site(spark):
    series = defaultdict(dict)
    for r in X.series(spark, DIR).collect():
        series[r.site][r.day] = r.obs
    assert len(series) > 12 and all(len(v) > 1 for v in series.values())
    maps = defaultdict(list)
    for r in G.city_quantile_maps(spark, DIR).collect():
        maps[r.site].append((r.y, r.x))
    params, filtered = defaultdict(dict), defaultdict(dict)
    for r in G.measurement_params(spark, DIR).collect():
        params[r.site][r.t] = (r.alpha, r.beta, r.vdelta)
    for r in G.assimilation(spark, DIR).collect():
        filtered[r.site][r.t] = (r.m, r.p, r.m_smooth, r.p_smooth)
    assert maps.keys() == params.keys() == filtered.keys() == series.keys()
    prior, cells = defaultdict(dict), {r.cell_id: (r.glon, r.glat) for r in X.grid(spark, DIR).collect()}
    for r in G._fitted_prior(spark, DIR).filter("t <= 30").collect():
        prior[r.cell_id][r.t] = (r.mu, r.slope, r.r2)
    near = {r.site: min(prior, key=lambda c: ((cells[c][0] - r.lon) ** 2 + (cells[c][1] - r.lat) ** 2, c)) for r in X.records(spark, DIR).select("site", "lon", "lat").distinct().collect()}  # noqa: B023
    for site, by_day in series.items():
        obs = np.array(list(by_day.values()))
        y, x = mapping.np_map(obs, obs - 1, np.full(len(obs), 0.4), TOTAL, 201, 2001)
        assert np.allclose(sorted(maps[site]), np.stack((y, x), axis=1))
        g = lambda q: np.interp(q, y, x)  # noqa: B023, E731
        for day in by_day:
            assert params[site][day] == pytest.approx(statespace.np_measurement(PROCESS, round(0.2 + day % 5 / 10.0, 2), g), rel=1e-6, abs=1e-9)
        at, none = statespace.np_measurement(PROCESS, 0.5, g), (0.0, 1.0, 1.0)
        days = sorted(prior[near[site]])
        alpha, beta, vdelta = np.array([at if t in by_day else none for t in days]).T
        mu, slope, r2 = np.array([prior[near[site]][t] for t in days]).T
        want = statespace.np_filter_smooth(mu, slope, r2, np.array([by_day.get(t, np.nan) for t in days]), alpha, beta, vdelta)
        assert sorted(filtered[site]) == days and len(days) > 1
        assert np.allclose([filtered[site][t] for t in days], np.stack([want[c] for c in ("m", "p", "m_smooth", "p_smooth")], axis=1), atol=1e-6)


def test_location_chain_uses_the_fitted_prior(spark):
    DIR = "/root/testdata/sf0.01"
    series, prior = defaultdict(dict), defaultdict(lambda: defaultdict(dict))
    for r in G._location_series(spark, DIR).collect():
        series[r.site][r.day] = r.obs
    for r in G.prior_parameters(spark, DIR).filter("coefficient = 'Penalized ML'").collect():
        prior[r.site][r.year][r.parameter] = r.value
    got, zero = defaultdict(dict), {r.site: r.x for r in G.location_maps_at_zero(spark, DIR).collect()}
    for r in G.location_assimilation(spark, DIR).collect():
        got[r.site][r.t] = (r.m, r.p, r.m_smooth, r.p_smooth)
    assert got.keys() == prior.keys() and len(got) > 10
    for site, steps in prior.items():
        obs = np.array(list(series[site].values()))
        at, none = (0.0, 1.0, 1.0), (0.0, 1.0, 1.0)
        if len(obs) > 1:
            y, x = mapping.np_map(obs, obs - 1, np.full(len(obs), 0.4), TOTAL, 201, 2001)
            at = statespace.np_measurement(PROCESS, 0.5, lambda q: np.interp(q, y, x))  # noqa: B023
            assert zero[site] == pytest.approx(np.interp(0.0, y, x), abs=1e-9)
        ts, seen = sorted(steps), lambda t: len(obs) > 1 and t in series[site]  # noqa: B023
        alpha, beta, vdelta = np.array([at if seen(t) else none for t in ts]).T
        of = lambda c: np.array([steps[t].get(c, 0.0) for t in ts])  # noqa: B023, E731
        want = statespace.np_filter_smooth(of("mu"), of("slope"), of("r2"), np.array([series[site][t] if seen(t) else np.nan for t in ts]), alpha, beta, vdelta)
        assert np.allclose([got[site][t] for t in ts], np.stack([want[c] for c in ("m", "p", "m_smooth", "p_smooth")], axis=1), atol=1e-6)
