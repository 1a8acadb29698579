"""Roots of targets whose values differ, in their last bits or wholly, each time they are computed."""

import numpy as np

from fieldloom.operators import roots


def test_targets_are_computed_once(spark):
    sample = spark.createDataFrame([(k, float(k + i % 9)) for k in (0, 1) for i in range(40)], "site int, value double")

    def drawn(batches):
        for b in batches:
            yield b.assign(u=np.random.default_rng().uniform(0.1, 0.9, len(b)), site=b["id"] % 2)[["id", "site", "u"]]

    targets = spark.range(30).mapInPandas(drawn, "id long, site int, u double")
    found = roots.kernel_inverse(targets, sample, ["site"], "value", 0.5).collect()
    assert len(found) == 30 and all(r["x"] is not None for r in found)


def test_estimates_are_computed_once(spark):
    sample = spark.createDataFrame([(1, float(i % 9)) for i in range(40)], "site int, temp double")

    def drawn(batches):
        for b in batches:
            yield b.assign(site=1, year=b["id"], yhat=np.random.default_rng().uniform(-1, 1, len(b)), sd=0.3)[["site", "year", "yhat", "sd"]]

    curve, rows = roots.map_index(spark.range(12).mapInPandas(drawn, "site int, year long, yhat double, sd double"), sample, ["site"], "year", "temp", 0.5)
    assert all(None not in tuple(r) for r in rows.collect()) and all(r["x"] is not None for r in curve.collect())
