"""The batch of fits against single fits, and the grid of all 343 triples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import prior, prior_batch


@pytest.fixture(scope="module")
def members():
    rng = np.random.default_rng(4)
    x = np.zeros((6, 40))
    for t in range(1, 40):
        x[:, t] = 0.5 * x[:, t - 1] + (0.3 + t / 80) * rng.standard_normal(6)
    return x + np.sin(np.arange(40) / 6) + 20


WEIGHTS = [(1.0, 1.0, 1.0), (1000.0, 1.0, 10**1.5), (1.0, 1000.0, 1000.0), (0.0, 0.0, 0.0), (100.0, 10.0, 0.0)]


def test_cases_agree_with_single_fits(members):
    cases = [(w, j) for w in WEIGHTS for j in range(-1, 6)]
    got = prior_batch.fit_cases(members, np.array([w for w, _ in cases]), np.array([j for _, j in cases]))
    for k, (w, j) in enumerate(cases):
        want = prior.fit(members if j < 0 else np.delete(members, j, axis=0), *w)
        assert got["rounds"][k] == want["rounds"]
        for name in ("mu", "slope", "r2"):
            assert np.allclose(got[name][k], want[name], rtol=1e-6, atol=1e-8), (w, j, name)


def test_variance_roots_agree_where_there_are_three(members):
    rng = np.random.default_rng(0)
    for count in (1, 2):
        s, q = 10 ** rng.uniform(-12, 1, 3000), count * 10 ** rng.uniform(-6, 2, 3000)
        w, j = 10 ** rng.uniform(-3, 5, 3000) * (rng.random(3000) > 0.1), rng.integers(1, 14, 3000)
        got = prior_batch.variance_roots(s, q, count, w, j)
        want = [max(prior.variance_root(a, [b / count] * count, c, d), prior.FLOOR) for a, b, c, d in zip(s, q, w, j.tolist(), strict=True)]
        assert np.allclose(got, want, rtol=1e-7)


def test_scores_are_the_mean_losses_of_members_left_out(members):
    w = (31.6, 10.0, 100.0)
    fits = [prior.fit(np.delete(members, j, axis=0), *w) for j in range(6)]
    want = np.mean([prior.member_loss(members[j], f["mu"], f["slope"], f["r2"]) for j, f in enumerate(fits)])
    assert prior_batch.held_out_scores(members, np.array([w]))[0] == pytest.approx(want, rel=1e-9)


def test_two_steps(members):
    got = prior_batch.fit_cases(members[:, :2], np.array([(1.0, 1.0, 1.0)]), np.array([-1]))
    want = prior.fit(members[:, :2], 1.0, 1.0, 1.0)
    assert np.allclose(got["r2"][0], want["r2"]) and np.allclose(got["slope"][0], want["slope"])


def test_all_343_triples_of_each_site_in_several_tasks(spark, members):
    rows = [(s, list(range(12)), (members[:, s : s + 12] + s).tolist()) for s in range(2)] + [(9, [1], [[1.0]] * 6)]
    sites = spark.createDataFrame(rows, "site int, years array<int>, x array<array<double>>")
    scores = prior.cross_validate(sites, rounds=20)
    assert scores.rdd.getNumPartitions() == 64
    found = {(r.site, r.w1, r.w2, r.w3): r.score for r in scores.collect()}
    assert len(found) == 2 * 343 and {k[0] for k in found} == {0, 1}
    key = (1, prior.WEIGHTS[3], prior.WEIGHTS[0], prior.WEIGHTS[6])
    x = np.asarray(rows[1][2])
    want = np.mean([prior.member_loss(x[j], f["mu"], f["slope"], f["r2"]) for j in range(6) for f in [prior.fit(np.delete(x, j, axis=0), *key[1:], rounds=20)]])
    assert found[key] == pytest.approx(want, rel=1e-8)
    best = {r.site: (r.w1, r.w2, r.w3) for r in prior.best_weights(scores).collect()}
    assert all(found[(s, *w)] == min(v for k, v in found.items() if k[0] == s) for s, w in best.items())


def test_grouped_fits_keep_their_partitions(spark):
    """Small groups of much work stay dealt, with adaptive execution on."""
    from fieldloom.plans import grouped_queries as G

    for query in (G.city_quantile_maps, G.measurement_params, G.prior_parameters):
        parts = query(spark, "/root/testdata/sf0.01").select(F.spark_partition_id().alias("p")).distinct().count()
        assert parts >= 6, query.__name__
