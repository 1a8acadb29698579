import math
import random

import numpy as np
import pytest

from fieldloom.functions.normal import np_cdf
from fieldloom.operators import mapping, roots

SAMPLE = {1: [0.0, 0.4, 0.4, 1.3, 2.2, 5.0], 2: [-3.0, -2.5], 3: [7.0, 7.0], 4: [math.nan, None]}


def distribution(values, x, h):
    return np.mean([np_cdf(np.array((x - v) / h)) for v in values])


def bisected(values, u, h):
    u, lo, hi = min(max(u, 1e-8), 1 - 1e-8), min(values) - 40, max(values) + 40
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if distribution(values, mid, h) < u else (lo, mid)
    return lo


def test_roots_match_bisection(spark):
    sample = spark.createDataFrame([(k, v, "other") for k, vs in SAMPLE.items() for v in vs], "site int, value double, u string")
    asked = [0.0, 1e-9, 0.001, 0.25, 0.5, 0.5, 0.9, 0.999999, 1.0, None, math.nan]
    targets = spark.createDataFrame([(k, u, f"row{i}") for k in (1, 2, 3, 4, 9, None) for i, u in enumerate(asked)], "site int, u double, value string")
    for parts, salts in ((1, 1), (8, 16)):
        rows = roots.kernel_inverse(targets.repartition(parts), sample.repartition(parts), ["site"], "value", 0.3, tol=1e-9, salts=salts).collect()
        assert len(rows) == 6 * len(asked)
        for r in rows:
            if r["site"] in (1, 2) and r["u"] is not None and not math.isnan(r["u"]):
                assert r["x"] == pytest.approx(bisected(SAMPLE[r["site"]], r["u"], 0.3), abs=1e-6)
            else:
                assert r["x"] is None


def test_roots_agree_with_the_table(spark):
    draw = random.Random(3)
    sample = spark.createDataFrame([(k, draw.gauss(k, 1 + k)) for k in (0, 1) for _ in range(400)], "site int, value double")
    places = [-10 + 25 * i / 2000 for i in range(2001)]
    targets = spark.createDataFrame([(k, i / 20, i / 20) for k in (0, 1) for i in range(1, 20)], "site int, q double, p double")
    table = mapping.quantile_map(targets, mapping.kernel_cdf(sample, ["site"], "value", places, 0.5), ["site"])
    found = roots.kernel_inverse(targets, sample, ["site"], "value", 0.5, u="p").join(table.withColumnRenamed("x", "t"), ["site", "q"]).collect()
    assert len(found) == 38 and max(abs(r["x"] - r["t"]) for r in found) < 1e-3


def test_empty_inputs(spark):
    sample = spark.createDataFrame([], "site int, value double")
    targets = spark.createDataFrame([(1, 0.5)], "site int, u double")
    assert roots.kernel_inverse(targets, sample, ["site"], "value", 0.5).collect() == [(1, 0.5, None)]
    assert roots.kernel_inverse(targets.limit(0), sample, ["site"], "value", 0.5).count() == 0


def test_band_holds_the_estimate_in_order(spark):
    estimates = spark.createDataFrame([(1, t, math.sin(t), 0.3 if t != 4 else None) for t in range(12)] + [(1, 99, None, 0.2)], "site int, year int, yhat double, sd double")
    sample = spark.createDataFrame([(1, 10 + math.cos(3 * t)) for t in range(40)], "site int, temp double")
    curve, rows = roots.map_index(estimates, sample, ["site"], "year", "temp", 0.4)
    c = [r["x"] for r in curve.orderBy("y").collect()]
    assert len(c) == 150 and all(a <= b + 1e-6 for a, b in zip(c, c[1:]))
    rows = {r["year"]: r for r in rows.collect()}
    assert len(rows) == 13 and rows[99]["x"] is None and rows[4]["lower"] is None and rows[4]["x"] is not None
    held = [t for t in range(12) if t != 4]
    for t in held:
        assert rows[t]["lower"] <= rows[t]["x"] <= rows[t]["upper"]
    u = np.mean([np_cdf(np.array((math.sin(3) - math.sin(t)) / 0.3)) for t in held])
    assert rows[3]["x"] == pytest.approx(bisected([10 + math.cos(3 * t) for t in range(40)], float(u), 0.4), abs=1e-5)
