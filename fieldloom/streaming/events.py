"""Streaming forms: windowed summaries with late data, sessions, deduplication, and the causal filter with state per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, time: str, value: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """keys, start, end, n, total and mean per window; rows later than the watermark are left out."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "total", "mean")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "1 day") -> DataFrame:
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_seen(events: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def causal_filter(observations: DataFrame, key: str, mu: float, slope: float, r2: float, alpha: float, beta: float, vdelta: float) -> DataFrame:
    """key, t, m, p: the forward pass as observations (key, t, obs) come in order of t; steps between are predicted through.

    State per key is (t, m, p). Every observation of a step is one more update of it; a batch gives a step one row, after its
    last observation there, and a later batch that holds the same step another one. Observations before the last step are
    left out, as the pass is causal.
    """
    kind = dict(observations.dtypes)[key]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, m, p = state.get if state.exists else (None, mu, r2)
        rows = []
        for row in pd.concat(list(batches)).sort_values(["t", "obs"]).itertuples():
            if last is not None and row.t < last:
                continue
            for _ in range(0 if last is None else int(row.t - last)):
                m, p = mu + slope * (m - mu), slope * slope * p + r2
            if row.obs == row.obs:
                gain = p * beta / (beta * beta * p + vdelta)
                m, p = m + gain * (row.obs - alpha - beta * m), max((1 - gain * beta) * p, 0.0)
            if rows and rows[-1][1] == row.t:
                rows.pop()
            last = int(row.t)
            rows.append((group[0], last, m, p))
        if last is not None:
            state.update((last, m, p))
        yield pd.DataFrame(rows, columns=[key, "t", "m", "p"])

    return observations.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, t int, m double, p double", "t int, m double, p double", "append", GroupStateTimeout.NoTimeout)
