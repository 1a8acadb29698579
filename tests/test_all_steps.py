"""The assimilation of sites goes through every step of the prior, those after the last observation too."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import relational as R
from fieldloom.plans import fixtures as X, grouped_queries as G

DIR = "/root/testdata/sf0.01"


def test_every_step_of_the_prior_is_filtered(spark):
    prior = defaultdict(dict)
    for r in G._fitted_prior(spark, DIR).collect():
        prior[r.cell_id][r.t] = (r.mu, r.slope, r.r2)
    cells = X.grid(spark, DIR).filter(F.col("cell_id").isin(*prior))
    near = {r.site: r.cell_id for r in R.nearest_cell(X.records(spark, DIR).select("site", "lon", "lat").distinct(), cells).collect()}
    got = defaultdict(dict)
    for r in G.assimilation(spark, DIR).collect():
        got[r.site][r.t] = r
    assert got.keys() == near.keys() and max(len(v) for v in prior.values()) > 30
    for site, steps in got.items():
        mine = prior[near[site]]
        assert sorted(steps) == sorted(mine)
        last = max(t for t in steps if steps[t].obs is not None)
        for t in (t for t in steps if t > last):  # predictions only, from the step before
            (mu, slope, r2), before = mine[t], steps[t - 1]
            assert steps[t].m == pytest.approx(mu + slope * (before.m - mine[t - 1][0]), abs=1e-9)
            assert steps[t].p == pytest.approx(slope**2 * before.p + r2, rel=1e-9)
