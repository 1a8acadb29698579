"""The variogram over all sites against pairs taken one by one."""

from collections import defaultdict
from itertools import combinations

import pandas as pd
import pytest

from fieldloom.functions import geo
from fieldloom.plans import catalog, fixtures as X
from fieldloom.plans.relational_queries import _mode

from .sqlcheck import connection

DIR = "/root/testdata/sf0.01"


def test_variogram_has_the_pairs_of_all_sites(spark):
    con = connection()
    at = {r.site: (r.lon, r.lat) for r in X.records(spark, DIR).select("site", "lon", "lat").distinct().collect()}
    days = defaultdict(list)
    for r in _mode(spark, DIR).collect():
        days[r.day].append((r.site, r.level))
    pairs = [(*at[s], *at[t], (a - b) ** 2) for rows in days.values() for (s, a), (t, b) in combinations(rows, 2)]
    assert len(at) > 60
    frame = pd.DataFrame(pairs, columns=["x1", "y1", "x2", "y2", "sq"])
    con.register("frame", frame)
    want = {b: (n, km, g) for b, n, km, g in con.execute(f"SELECT CAST(floor(km / 100) AS INT), count(*), avg(km), avg(sq) / 2 FROM (SELECT {geo.ellipsoid_km_sql('x1', 'y1', 'x2', 'y2')} AS km, sq FROM frame) WHERE km > 1 GROUP BY 1").fetchall()}
    got = {r["bin"]: (r["np"], float(r.dist), float(r.gamma)) for r in catalog.QUERIES["variogram_bins"](spark, DIR).collect()}
    assert got.keys() == want.keys()
    for b in want:
        assert got[b][0] == want[b][0] and got[b][1] == pytest.approx(want[b][1], abs=1e-3) and got[b][2] == pytest.approx(want[b][2], abs=1e-5)
