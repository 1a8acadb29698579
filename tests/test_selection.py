"""Exact quantiles against NumPy's, on distributions that histograms find hard."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import selection

PROBS = [0.0, 0.1, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double").repartition(4)


RNG = np.random.default_rng(7)
CASES = {
    "normal": RNG.normal(size=3000),
    "heavy": np.exp(RNG.normal(0, 40, 3000)) * RNG.choice([-1, 1], 3000),
    "ties": RNG.integers(0, 5, 3000) * 1.5,
    "one": [2.5],
    "two": [1.0, 4.0],
    "constant": [3.0] * 500,
    "wide": np.concatenate((RNG.normal(size=500), [-1.7e308, 1.7e308])),
    "cluster": np.concatenate(([0.0], 1e9 + np.arange(2000) * 2.0**-22, [1e18])),
    "zeros": [-0.0, 0.0, 0.0, 1.0],
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize(("bins", "hold"), [(16, 8), (2048, 2048)])
def test_quantiles_are_exact(spark, name, bins, hold):
    values = np.asarray(CASES[name], float)
    got = selection.exact_quantiles(column(spark, values), "x", PROBS, bins, hold)
    ordered = np.sort(values)
    for p, g in zip(PROBS, got, strict=True):
        low, high, share = selection._places(len(values), p)
        want = ordered[low] if share == 0 else ordered[low] + share * (ordered[high] - ordered[low])
        assert g == want, (name, p)


def test_nulls_nan_and_infinities(spark):
    frame = spark.createDataFrame([(v,) for v in [None, float("nan"), float("-inf"), 1.0, 2.0, float("inf")]], "x double")
    assert selection.exact_quantiles(frame, "x", [0.0, 1 / 3, 2 / 3, 1.0]) == [float("-inf"), 1.0, 2.0, float("inf")]
    assert selection.exact_quantiles(frame.filter("x is null"), "x", [0.5]) == [None]


def test_agrees_with_percentile_over_a_million_rows_in_bounded_rounds(spark, monkeypatch):
    frame = spark.range(1_000_000).select((F.pow(F.rand(3), 3) * 100 + F.round(F.rand(5))).alias("x"))
    rows = []
    whole = selection._refined

    def counted(values, intervals, bins):
        out = whole(values, intervals, bins)
        rows.append(len(out))
        return out

    monkeypatch.setattr(selection, "_refined", counted)
    probs = [0.1, 0.5, 0.9]
    assert selection.exact_quantiles(frame, "x", probs) == pytest.approx(frame.agg(F.percentile("x", F.array(*map(F.lit, probs)))).first()[0], rel=1e-15)
    assert len(rows) <= 3 and max(rows) <= 6 * 2048
