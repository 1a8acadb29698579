"""Variograms by places: sums over the sites of a place and over periods, and repetitions that leave sites out."""

import numpy as np
import pandas as pd
import pytest

from fieldloom.functions.geo import np_ellipsoid_matrix
from fieldloom.operators import calibration, kriging, validation, variogram


@pytest.fixture(scope="module")
def crowded(spark):
    """240 sites on 40 places, a few without a level, one that moves within a period."""
    rng = np.random.default_rng(4)
    lon, lat = rng.uniform(105, 118, 40).round(1).tolist(), rng.uniform(24, 36, 40).round(1).tolist()
    rows = [(y, s, lon[s % 40], lat[s % 40], float(rng.integers(-2, 2)) if rng.random() > 0.02 else None) for y in range(5) for s in range(240) if rng.random() > 0.2]
    rows += [(1, 999, 106.0, 30.0, 1.0), (1, 999, 109.0, 31.0, -2.0)]
    return spark.createDataFrame(rows, "year int, site int, lon double, lat double, z double").repartition(3).cache()


def _same(got, want, keys):
    got, want = (f.toPandas().sort_values(keys).reset_index(drop=True) for f in (got, want))
    assert len(got) == len(want) > 5 and (got[[*keys, "np"]].to_numpy() == want[[*keys, "np"]].to_numpy()).all()
    for c in ("dist", "gamma"):
        assert np.allclose(got[c], want[c], rtol=1e-11)


@pytest.mark.parametrize(("cutoff", "rows"), [(None, 2048), (400.0, 7), (None, 16)])
def test_bins_by_place_are_those_of_all_pairs(spark, crowded, cutoff, rows):
    want = variogram.binned(variogram.period_pairs(crowded, "year", "site"), 50.0, cutoff)
    _same(variogram.period_bins(crowded, "year", "site", 50.0, cutoff, block_rows=rows), want, ["bin"])
    alone = crowded.withColumn("site", crowded["site"] * 7 + crowded["year"]).withColumn("lon", crowded["lon"] + crowded["year"])  # periods share few places
    _same(variogram.period_bins(alone, "year", "site", 50.0, cutoff, block_rows=rows), variogram.binned(variogram.period_pairs(alone, "year", "site"), 50.0, cutoff), ["bin"])


def test_work_does_not_grow_with_the_sites_of_a_place(crowded):
    """What tasks receive is a row per place, period and pair of blocks, however many sites stand there."""
    places = variogram._places(variogram._observed(crowded, "year", "site", "lon", "lat", "z", None))
    assert places.count() <= 5 * 42 < crowded.count() / 4


def test_repetitions_leave_their_held_out_sites_out(spark, crowded):
    levels = crowded.filter("site < 999 AND z IS NOT NULL").withColumnRenamed("z", "level")
    held, training = validation.split(levels, ["site"], "year", 3)
    second = held.withColumn("site", (held["site"] + 80) % 240)  # two of a period, at one place
    both = held.unionByName(second).distinct().cache()
    rest = training.join(both, ["site", "year", "repetition"], "left_anti")
    want = variogram.period_bins(rest, "year", "site", 50.0, 900.0, value="level", by="repetition")
    got = variogram.period_bins_left_out(levels, both, 3, "year", "site", 50.0, 900.0, value="level")
    _same(got, want, ["repetition", "bin"])
    one = validation.recalibrated(training, "year", 50.0, 900.0).toPandas().sort_values("repetition")
    two = validation.recalibrated(levels, "year", 50.0, 900.0, held=held, repetitions=3).toPandas().sort_values("repetition")
    assert one["repetition"].tolist() == two["repetition"].tolist() == [1, 2, 3] and one["problem"].isna().tolist() == two["problem"].isna().tolist()


def test_observations_of_a_place_are_one_row_of_the_system(spark, crowded):
    """Against the whole matrix of all observations, without any grouping."""
    c = calibration.Calibration(0.99, 0.79, 0.2, 300.0)
    p = kriging.Predictor(c)
    pdf = crowded.filter("year = 2 AND site < 999 AND z IS NOT NULL").toPandas()
    tlon, tlat = np.array([110.0, 112.0, pdf["lon"][0]]), np.array([30.0, 27.0, pdf["lat"][0]])
    whole = p.covariance(pdf["lon"].to_numpy(), pdf["lat"].to_numpy())
    cross = p.cross(np_ellipsoid_matrix(pdf["lon"], pdf["lat"], tlon, tlat))
    weight = np.linalg.solve(whole, cross)
    mean, variance, jitter = p.predict(pdf["lon"], pdf["lat"], pdf["z"], tlon, tlat)
    assert jitter == 0 and np.allclose(mean, weight.T @ (pdf["z"].to_numpy() - p.mean), rtol=1e-9) and np.allclose(variance, c.process - (weight * cross).sum(axis=0), rtol=1e-9)
    targets = spark.createDataFrame([("t", k, float(x), float(y)) for k, (x, y) in enumerate(zip(tlon, tlat, strict=True))], "target_set string, target_id long, lon double, lat double")
    got = kriging.krige(crowded.filter("year = 2 AND site < 999 AND z IS NOT NULL").withColumnRenamed("z", "level"), targets, c).toPandas().sort_values("target_id")
    assert np.allclose(got["mean"], mean, rtol=1e-9) and (got["n_obs"] == len(pdf)).all()
    x, y, level, n, first = kriging.by_place(pdf["lon"], pdf["lat"], pdf["z"])
    assert len(x) < len(pdf) / 3
    f = p.factor(x, y, n)
    assert sum(slab.size for slab in f.slabs) <= len(x) ** 2
    mean, variance = p.left_out(x, y, level, n, f, first[:50], pdf["z"].to_numpy()[:50])
    for i in range(50):
        rest = np.arange(len(pdf)) != i
        cross = p.cross(np_ellipsoid_matrix(pdf["lon"][rest], pdf["lat"][rest], pdf["lon"][i : i + 1].to_numpy(), pdf["lat"][i : i + 1].to_numpy()))[:, 0]
        weight = np.linalg.solve(whole[np.ix_(rest, rest)], cross)
        assert mean[i] == pytest.approx(weight @ (pdf["z"].to_numpy()[rest] - p.mean), rel=1e-9, abs=1e-9) and variance[i] == pytest.approx(c.process - weight @ cross, rel=1e-9)


def test_a_factor_in_tiles_is_the_factor():
    rng = np.random.default_rng(6)
    for n in (1, 7, 8, 30):
        root = rng.standard_normal((n, n))
        m = root @ root.T + n * np.eye(n)
        f, b = kriging.Tiles(n, lambda r, c: m[r, c].copy(), 8), rng.standard_normal((n, 2))  # noqa: B023
        assert np.allclose(np.linalg.cholesky(m) @ f.forward(b), b) and f.jitter == 0
        assert max(s.shape[0] for s in f.slabs) <= 8
    assert kriging.Tiles(3, lambda r, c: np.ones((3, 3))[r, c].copy(), 2).jitter > 0
