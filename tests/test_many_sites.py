"""What sites share is found once, and what many of them need takes few calls."""

import numpy as np
import pytest

from fieldloom.operators import mapping, statespace


def test_nodes_are_found_once(monkeypatch):
    calls, real = [], np.polynomial.hermite_e.hermegauss
    monkeypatch.setattr(np.polynomial.hermite_e, "hermegauss", lambda n: calls.append(n) or real(n))
    got = [statespace.np_measurement(0.8, v, lambda q: 2 * q + 1, 37) for v in (0.2, 0.3, 0.4)]
    assert calls == [37] and all(a == pytest.approx(got[0][0] + 0, abs=2) for a, _, _ in got)


def test_bandwidths_of_a_small_sample_are_tried_at_once(monkeypatch):
    calls, real = [], mapping.np_cdf
    x = np.random.default_rng(3).normal(2, 1, 30)
    slow = mapping.np_bandwidth(np.tile(x, 1), 7)
    monkeypatch.setattr(mapping, "np_cdf", lambda z: calls.append(z.size) or real(z))
    assert mapping.np_bandwidth(x) == slow and len(calls) == 1
    grid, sd, n = np.quantile(x, np.linspace(0.02, 0.98, 40)), x.std(ddof=1), len(x)
    hs, errors = sd * n ** (-1 / 3) * np.geomspace(0.2, 3, 15), []
    for h in hs:
        own = real((grid[None, :] - x[:, None]) / h)
        errors.append((((x[:, None] <= grid[None, :]) - (own.sum(axis=0) - own) / (n - 1)) ** 2).sum())
    assert mapping.np_bandwidth(x) == pytest.approx(hs[int(np.argmin(errors))], rel=1e-12)
