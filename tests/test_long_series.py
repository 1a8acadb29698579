"""The filter and smoother in blocks against the plain recursions, and one key of a million steps."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import longseries, statespace

COLUMNS = ("m_pred", "p_pred", "m", "p", "m_smooth", "p_smooth")


def series(n, seed, gaps=0.3):
    rng = np.random.default_rng(seed)
    out = pd.DataFrame({"t": np.arange(n, dtype=np.int32), "mu": rng.normal(10, 1, n), "slope": rng.uniform(-0.2, 0.98, n), "r2": rng.uniform(0.05, 1, n)})
    out["alpha"], out["beta"], out["vdelta"] = rng.normal(0, 1, n), rng.normal(1, 0.5, n), rng.uniform(0.05, 1, n)
    out["obs"] = np.where(rng.random(n) < gaps, np.nan, rng.normal(10, 2, n))
    return out


def expected(s):
    return statespace.np_filter_smooth(s["mu"].to_numpy(), s["slope"].to_numpy()[:], s["r2"].to_numpy(), *[s[c].to_numpy() for c in ("obs", "alpha", "beta", "vdelta")])


def frame(spark, parts):
    out = pd.concat([s.assign(site=k) for k, s in parts.items()])
    return spark.createDataFrame(out).withColumn("obs", F.when(~F.isnan("obs"), F.col("obs"))).withColumn("t", F.col("t").cast("int"))


@pytest.mark.parametrize("size", [2, 3, 7, 64])
def test_blocks_agree_with_the_plain_recursion(spark, size):
    parts = {"a": series(40, 1), "b": series(1, 2), "c": series(13, 3, gaps=1.0), "d": series(29, 4, gaps=0.0)}
    got = longseries.filter_long_series(frame(spark, parts), ["site"], size).toPandas()
    for site, s in parts.items():
        mine, want = got[got["site"] == site].sort_values("t"), expected(s)
        assert len(mine) == len(s)
        for c in COLUMNS:
            assert np.allclose(mine[c], want[c], rtol=1e-9, atol=1e-9), (site, c)


def test_all_columns_agree_with_the_array_form(spark):
    rows = frame(spark, {1: series(30, 8), 2: series(17, 9)}).filter("t <> 5 and (t < 9 or t > 20)")  # a step and whole blocks are absent
    order = ["site", "t"]
    names = statespace.filter_series(rows, ["site"]).columns
    want = statespace.filter_series(rows, ["site"]).orderBy(*order).toPandas()
    got = longseries.filter_long_series(rows, ["site"], 3).select(*names).orderBy(*order).toPandas()
    assert np.allclose(got.astype(float), want.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_null_keys_and_no_rows(spark):
    rows = frame(spark, {1: series(10, 5)}).withColumn("site", F.lit(None).cast("int"))
    assert longseries.filter_long_series(rows, ["site"], 4).filter("m_smooth is not null").count() == 10
    assert longseries.filter_long_series(rows.filter("false"), ["site"], 4).count() == 0


def test_one_key_of_a_million_steps_over_several_tasks(spark):
    n = 1_000_000
    t = F.col("id").cast("int")
    steps = spark.range(n).select(
        F.lit(1).alias("site"), t.alias("t"), F.sin(t / 1000.0).alias("mu"), (0.5 + 0.4 * F.sin(t / 37.0)).alias("slope"), (0.3 + (t % 7) / 10.0).alias("r2"),
        F.when(t % 3 > 0, F.sin(t / 11.0)).alias("obs"), F.lit(0.1).alias("alpha"), (0.8 + (t % 5) / 10.0).alias("beta"), F.lit(0.4).alias("vdelta"),
    )
    got = longseries.filter_long_series(steps, ["site"])
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 4
    k = np.arange(n)
    want = statespace.np_filter_smooth(np.sin(k / 1000), 0.5 + 0.4 * np.sin(k / 37), 0.3 + (k % 7) / 10, np.where(k % 3 > 0, np.sin(k / 11), np.nan), np.full(n, 0.1), 0.8 + (k % 5) / 10, np.full(n, 0.4))
    mine = got.filter("t % 97 = 0 or t > 999900").select("t", *COLUMNS).toPandas().sort_values("t")
    for c in COLUMNS:
        assert np.allclose(mine[c], want[c][mine["t"]], rtol=1e-9, atol=1e-9), c
