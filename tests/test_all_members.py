"""The prior's ensemble and the boxplot hold every location, member and step of the table."""

from collections import defaultdict

import numpy as np

from fieldloom.operators import prior
from fieldloom.plans import fixtures as X, grouped_queries as G

DIR = "/root/testdata/sf0.01"


def test_prior_has_all_locations_members_and_months(spark):
    cells = defaultdict(list)
    for r in X.cube(spark, DIR).collect():
        cells[r.location, (r.year - 1995) * 12 + r.month, r.member].append(r.value)
    members = sorted({m for _, _, m in cells})
    months = {s: sorted(y for y in {y for k, y, _ in cells if k == s} if all((s, y, m) in cells for m in members)) for s in {s for s, _, _ in cells}}
    want = {s: np.array([[np.mean(cells[s, y, m]) / 10000 - 3 for y in ys] for m in members]) for s, ys in months.items() if ys}
    assert len(want) == 25 and len(members) == 7 and max(max(v) for v in months.values()) > 60
    got = {r.site: np.array(r.x) for r in prior.matrices(G._ensemble(spark, DIR)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[s], want[s]) for s in want)
    assert {r.site for r in G.prior_parameters(spark, DIR).select("site").distinct().collect()} == set(want)
    assert {r.site for r in G.prior_fit_cv(spark, DIR).collect()} == set(want)


def test_boxplot_has_all_days(spark):
    days = {r.day for r in X.records(spark, DIR).select("day").distinct().collect()}
    assert max(days) > 20 and {r.day for r in G.functional_boxplot(spark, DIR).collect()} == days
