"""Exact quantiles of a whole column by rounds of refined histograms.

A quantile of n values lies between the two values of neighbouring ranks. Each round counts the values of the intervals that still
hold a wanted rank in equal bins, with the least and greatest value of each bin, and keeps the bins that hold the ranks. An interval is
settled when it is a single value, or when it has few values, which are then taken as they are. Tasks hold a histogram, never the values;
what comes to the driver in a round is at most ``bins`` rows for each wanted rank. Bins are cut between actual values, so every
round either ends an interval or cuts its span by the number of bins, whatever the distribution; repeated values cost nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.session import discard, stored


@dataclass(frozen=True)
class Interval:
    """Values from lo to hi: ``before`` values are less than lo, ``n`` lie within."""

    lo: float
    hi: float
    before: int
    n: int

    def holds(self, rank: int) -> bool:
        return self.before <= rank < self.before + self.n


def _places(n: int, prob: float) -> tuple[int, int, float]:
    """The two ranks (from 0) around a quantile and the share of the way between them: linear between order statistics (type 7)."""
    at = (n - 1) * prob
    low = min(math.floor(at), n - 1)
    return low, min(low + 1, n - 1), at - low


def _refined(values: DataFrame, intervals: list[Interval], bins: int) -> list[Interval]:
    """The intervals' bins that have values, in order."""
    v = F.col("v")
    inside = [(v >= i.lo) & (v <= i.hi) for i in intervals]
    number, place = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, (i, within) in enumerate(zip(intervals, inside, strict=True)):
        half = i.hi / 2 - i.lo / 2  # a span may pass the largest double
        bin_of = F.least(F.floor((v / 2 - i.lo / 2) / half * bins), F.lit(bins - 1)) if half > 0 else F.when(v == i.lo, 0).otherwise(1)
        number, place = F.when(within, k).otherwise(number), F.when(within, bin_of.cast("int")).otherwise(place)
    counts = values.select("v", number.alias("interval"), place.alias("place")).filter("interval is not null")
    rows = counts.groupBy("interval", "place").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("interval", "place").collect()
    out, before = [], {k: i.before for k, i in enumerate(intervals)}
    for r in rows:
        out.append(Interval(r["lo"], r["hi"], before[r["interval"]], r["n"]))
        before[r["interval"]] += r["n"]
    return out


def order_statistics(values: DataFrame, ranks: list[int], n: int, lo: float, hi: float, bins: int = 2048, hold: int = 2048) -> dict[int, float]:
    """The values at ranks (from 0) of the finite column v, of n values from lo to hi."""
    found: dict[int, float] = {}
    intervals = [Interval(lo, hi, 0, n)]
    held = None
    while True:
        kept = []
        for i in intervals:
            mine = [r for r in ranks if r not in found and i.holds(r)]
            if not mine:
                continue
            if i.lo == i.hi:
                found.update(dict.fromkeys(mine, i.lo))
            elif i.n <= hold:
                few = sorted(r["v"] for r in (held or values).filter((F.col("v") >= i.lo) & (F.col("v") <= i.hi)).select("v").collect())
                found.update({r: few[r - i.before] for r in mine})
            else:
                kept.append(i)
        if not kept:
            break
        intervals = _refined(held or values, kept, bins)
        wanted = [i for i in intervals if any(i.holds(r) for r in ranks if r not in found)]
        if held is None and sum(i.n for i in wanted) * 4 < n:  # from now on only what lies in the bins that are kept is read
            within = F.lit(False)
            for i in wanted:
                within = within | ((F.col("v") >= i.lo) & (F.col("v") <= i.hi))
            held = stored(values.filter(within))
    if held is not None:
        discard(held)
    return found


def exact_quantiles(frame: DataFrame, value: str | Column, probs: list[float], bins: int = 2048, hold: int = 2048) -> list[float | None]:
    """The quantiles of all values of a column, as ``percentile`` and R's type 7 give them. Nulls and NaN are left out; infinite values
    stand at the ends; without values the quantiles are null."""
    column = F.col(value) if isinstance(value, str) else value
    values = frame.select((column.cast("double") + 0.0).alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    inf = float("inf")
    finite = F.abs("v") < inf
    one = values.agg(F.count("*"), F.count(F.when(F.col("v") == -inf, 1)), F.count(F.when(finite, 1)), F.min(F.when(finite, F.col("v"))), F.max(F.when(finite, F.col("v")))).first()
    n, below, inner, lo, hi = one
    if not n:
        return [None] * len(probs)
    places = [_places(n, p) for p in probs]
    ranks = sorted({r for low, high, _ in places for r in (low, high)})
    at = {r: -inf if r < below else inf for r in ranks}
    wanted = [r - below for r in ranks if below <= r < below + inner]
    if wanted:
        at |= {r + below: v for r, v in order_statistics(values.filter(finite), wanted, inner, lo, hi, bins, hold).items()}
    return [at[low] if share == 0 or at[low] == at[high] else at[low] + share * (at[high] - at[low]) for low, high, share in places]
