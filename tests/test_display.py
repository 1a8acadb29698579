import numpy as np
import pytest

from fieldloom.operators import interpolation


def test_smoothed_fields_match_a_direct_solve(spark):
    draw = np.random.default_rng(4)
    points = [(k, float(a), float(b)) for k, (a, b) in enumerate(draw.uniform(0, 10, (20, 2)))]
    targets = interpolation.display_grid(points, 4, 3)
    assert [t[0] for t in targets] == list(range(12)) and targets[0][1:] == (min(p[1] for p in points), min(p[2] for p in points))
    z = draw.normal(size=20)
    rows = [(y, k, float(z[k]) * y) for y in (1, 2) for k in range(20)] + [(1, 77, 5.0)]
    rows += [(3, k, 1.0) for k in range(19)] + [(4, k, 1.0 if k else None) for k in range(20)] + [(5, k % 19, 1.0) for k in range(20)]
    frame = spark.createDataFrame(rows, "year int, location long, value double")
    got = {(r["year"], r["target"]): r["value"] for r in interpolation.smoothed_fields(frame, points, targets, ["year"], 8.0).collect()}
    assert set(got) == {(y, t) for y in (1, 2) for t in range(12)}
    p, q = (np.asarray([x[1:] for x in v]) for v in (points, targets))
    u, v = ((x - p.mean(axis=0)) / p.std() for x in (p, q))
    lam = interpolation.penalty_for_df(p, 8.0)
    kernel = lambda a, b: np.array([[0.5 * d * np.log(d) if d else 0.0 for d in ((x - b) ** 2).sum(axis=1)] for x in a])
    t = np.column_stack((np.ones(20), u))
    system = np.block([[kernel(u, u) + lam * np.eye(20), t], [t.T, np.zeros((3, 3))]])
    direct = np.column_stack((kernel(v, u), np.ones(12), v)) @ np.linalg.solve(system, np.concatenate((z, np.zeros(3))))
    for (year, target), value in got.items():
        assert value == pytest.approx(year * direct[target], abs=1e-8)
    assert np.trace(interpolation.weights(p, p, lam)) == pytest.approx(8.0, abs=1e-6)
    assert interpolation.smoothed_fields(frame.limit(0), points, targets, ["year"], 8.0).count() == 0
