"""Mixtures: covariance families against their defining properties, EM against a direct one, and rows that take no part."""

import numpy as np
import pytest

from fieldloom.operators import mixtures as M


def _scatters(k=3, d=3):
    rng = np.random.default_rng(8)
    w = np.array([40.0, 70.0, 25.0])[:k]
    return w, np.stack([(lambda a: a.T @ a)(rng.normal(size=(int(n), d)) @ rng.normal(size=(d, d))) for n in w])


def _fit(model, w, scatter):
    """The part of the log likelihood that covariances change."""
    c = M.covariances(model, w, scatter)
    return -0.5 * sum(n * np.linalg.slogdet(s)[1] + np.trace(np.linalg.solve(s, x)) for n, s, x in zip(w, c, scatter))


def test_wider_models_fit_no_worse():
    w, scatter = _scatters()
    fit = {m: _fit(m, w, scatter) for m in M.MODELS}
    wider = {"EII": "VII EEI", "VII": "VEI", "EEI": "VEI EVI EEE", "VEI": "VVI VEE", "EVI": "VVI EVE", "VVI": "VVE", "EEE": "VEE EVE EEV", "VEE": "VVE VEV", "EVE": "VVE EVV", "VVE": "VVV", "EEV": "VEV EVV", "VEV": "VVV", "EVV": "VVV"}
    for narrow, names in wider.items():
        for name in names.split():
            assert fit[name] >= fit[narrow] - 1e-6, (narrow, name)


def test_families_share_what_their_letters_say():
    w, scatter = _scatters()
    size = lambda c: np.linalg.det(c) ** (1 / 3)
    for model in M.MODELS:
        c = M.covariances(model, w, scatter)
        unit = np.linalg.eigvalsh(c) / size(c)[:, None]
        assert (np.ptp(size(c)) < 1e-8 * size(c).max()) == (model[0] == "E")
        assert np.allclose(unit, unit[0], rtol=1e-6) == (model[1] != "V")
        if model[2] == "E":  # common axes: the covariances commute
            assert np.abs(c[0] @ c[1] - c[1] @ c[0]).max() < 1e-6 * np.abs(c[0] @ c[1]).max()


def test_parameters():
    assert [M.parameters_of(m, 2, 3) for m in ("EII", "VVI", "EEE", "EVE", "VVV")] == [8, 13, 13, 15, 19]


def _direct(x, means, covs, weights, rounds=400):
    """Plain EM with free covariances, on one array."""
    for _ in range(rounds):
        dens = np.stack([w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(2 * np.pi * c)) for w, m, c in zip(weights, means, covs)])
        r = dens / dens.sum(axis=0)
        n = r.sum(axis=1)
        weights, means = n / len(x), r @ x / n[:, None]
        covs = [((x - m).T * q) @ (x - m) / s for m, q, s in zip(means, r, n)]
    return float(np.log(dens.sum(axis=0)).sum())


def _table(spark, x, parts=5):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "curve int, scores array<double>").repartition(parts)


def test_em_agrees_with_a_direct_one(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(0, 1, (150, 2)), rng.normal(3, 0.7, (100, 2)) @ np.array([[1, 0.4], [0, 1]])))
    labels, table = M.mixture_by_bic(_table(spark, x), "curve", models=("VVV",), fixed_k=2, tol=1e-9)
    row = table.first()
    exact = _direct(x, x[[0, 249]], [np.eye(2)] * 2, np.array([0.5, 0.5]))
    assert row["loglik"] == pytest.approx(exact, abs=0.02) and row["bic"] == pytest.approx(2 * row["loglik"] - 11 * np.log(250))
    got = {r["curve"]: r["component"] for r in labels.collect()}
    assert len(got) == 250 and len({got[i] for i in range(150, 250)} - {got[0]}) >= 1


def test_bic_finds_number_and_model(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.5, (80, 2)) for c in ((0, 0), (5, 0), (0, 6))])
    labels, table = M.mixture_by_bic(_table(spark, x), "curve", most=4)
    best = max(table.collect(), key=lambda r: r["bic"])
    assert (best["k"], best["model"]) == (3, "EII") and table.count() == 3 + 3 * 14
    got = {r["curve"]: r["component"] for r in labels.collect()}
    assert [len({got[i] for i in range(a, a + 80)}) for a in (0, 80, 160)] == [1, 1, 1] and len(set(got.values())) == 3


def test_odd_rows(spark):
    rows = [(1, None), (2, [1.0, float("nan")]), (3, [float("inf"), 0.0]), (4, [None, 1.0])]
    odd = spark.createDataFrame(rows, "curve int, scores array<double>")
    labels, table = M.mixture_by_bic(odd, "curve")
    assert labels.count() == 0 and table.count() == 0 and labels.columns == ["curve", "component", "membership"]
    same = spark.createDataFrame([(i, [2.0, 2.0]) for i in range(6)], "curve int, scores array<double>")
    labels, _ = M.mixture_by_bic(same.unionByName(odd), "curve", most=2)
    assert sorted(r["curve"] for r in labels.collect()) == list(range(6))
    with pytest.raises(ValueError):
        M.mixture_by_bic(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "curve int, scores array<double>"), "curve")


def test_many_candidates_at_once_give_what_each_gives(spark):
    """Shares and likelihoods of all candidates by one product; rows far from every component keep a share."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(700, 3)), [[300.0, -200.0, 100.0]]))
    candidates = {}
    for i, k in enumerate((1, 4, 2, 8)):
        a = rng.normal(size=(k, 3, 3))
        candidates[3 * i] = {"weights": rng.dirichlet(np.ones(k)), "means": rng.normal(size=(k, 3)), "covs": a @ a.transpose(0, 2, 1) + 1e-3 * np.eye(3)}
    alone = {i: M._memberships(x, c) for i, c in candidates.items()}
    share, logs = M._many_memberships(candidates)(x)
    assert np.allclose(share, np.concatenate([s for s, _ in alone.values()]), rtol=1e-9, atol=1e-12)
    assert np.allclose(logs, [v.sum() for _, v in alone.values()], rtol=1e-11)
    sums = M.component_sums(_table(spark, x), candidates | {1: {"weights": None, "means": x[:2], "covs": None}}, np.zeros(3))
    for i, (s, v) in alone.items():
        assert np.allclose(sums[i][0], s.sum(axis=1), rtol=1e-9) and np.allclose(sums[i][1], s @ x, rtol=1e-9, atol=1e-9) and sums[i][3] == pytest.approx(v.sum(), rel=1e-11)
    assert sums[1][0].sum() == 701
