"""The causal filter uses every observation of a step."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldloom.plans import streaming_queries as S

DIR = "/root/testdata/sf0.001"


def test_causal_filter_uses_all_observations(spark):
    days = defaultdict(lambda: defaultdict(list))
    for r in spark.read.parquet(f"{DIR}/events.parquet").select("user_id", F.dayofyear("ts").alias("t"), (F.col("value") / 100).alias("obs")).collect():
        days[r.user_id][r.t].append(r.obs)
    assert any(len(v) > 1 for u in days.values() for v in u.values())
    want = {}
    for user, by_day in days.items():
        last, m, p = None, 1.0, 0.3
        for t in sorted(by_day):
            for _ in range(0 if last is None else t - last):
                m, p = 1.0 + 0.6 * (m - 1.0), 0.36 * p + 0.3
            # n updates at once: precisions add
            n, total = len(by_day[t]), sum(by_day[t])
            m, p = (m / p + total / 0.2) / (1 / p + n / 0.2), 1 / (1 / p + n / 0.2)
            last = t
            want[user, t] = (m, p)
    rows = S.stream_causal_filter(spark, DIR).collect()
    got = {(r.user_id, r.t): (r.m, r.p) for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
