"""Filter and smoother of long series: blocks of steps are summarised in parallel, scanned, and finished in parallel.

The state is kept as its distance z_t = x_t - mu_t, so a step needs nothing of its neighbours: z_t = M_t z_{t-1} + e_t. What a run
of steps does to a Gaussian state is five numbers, and two runs in a row combine to one such run (associative elements of the filter:
Saerkkae and Garcia-Fernandez, 2021); what it does to a smoothed state, going back, is three. So

1. each block of a key's steps is folded to one element, with no more memory than the block;
2. the elements of a key are scanned from the state before its first step; where a key has more than ``size`` blocks, blocks are
   combined to blocks of blocks first, which are scanned alike, to any height;
3. each block runs the plain recursion from the state it is entered with.

The smoother does the same from the last block to the first. Rows meet by key and block alone, so one key's steps are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.statespace import STEP
from fieldloom.session import stored

#: What a run of steps does to a state: (m, p) becomes (a d (m + p eta) + b, a^2 d p + c) with d = 1 / (1 + p j).
RUN = "struct<a:double,b:double,c:double,eta:double,j:double>"
#: What it does, going back, to the smoothed state after it: (m, p) becomes (e m + g, e^2 p + l).
BACK = "struct<e:double,g:double,l:double>"
GAUSS = "struct<m:double,p:double>"
STATE = "struct<t:int,mu:double,slope:double,r2:double,obs:double,m_pred:double,p_pred:double,gain:double,innovation:double,proxy:double,weight:double,m:double,p:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _struct(kind: str, **fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(kind)


def _element(s: Column) -> Column:
    """One step as a run."""
    one, none = F.lit(1.0), F.lit(0.0)
    total = s["beta"] * s["beta"] * s["r2"] + s["vdelta"]
    off = s["obs"] - s["alpha"] - s["beta"] * s["mu"]
    rest = one - s["r2"] * s["beta"] * s["beta"] / total
    seen = s["obs"].isNotNull()
    given = lambda x, y: F.when(seen, x).otherwise(y)
    return _struct(
        RUN,
        a=given(rest * s["slope"], s["slope"]),
        b=given(s["r2"] * s["beta"] / total * off, none),
        c=given(rest * s["r2"], s["r2"]),
        eta=given(s["slope"] * s["beta"] / total * off, none),
        j=given(s["slope"] * s["slope"] * s["beta"] * s["beta"] / total, none),
    )


def _combined(x: Column, y: Column) -> Column:
    """Run x, then run y."""
    d = 1 / (1 + x["c"] * y["j"])
    return _struct(
        RUN,
        a=y["a"] * d * x["a"],
        b=y["a"] * d * (x["b"] + x["c"] * y["eta"]) + y["b"],
        c=y["a"] * y["a"] * d * x["c"] + y["c"],
        eta=x["a"] * d * (y["eta"] - y["j"] * x["b"]) + x["eta"],
        j=x["a"] * x["a"] * d * y["j"] + x["j"],
    )


def _after(state: Column, run: Column) -> Column:
    d = 1 / (1 + state["p"] * run["j"])
    return _struct(GAUSS, m=run["a"] * d * (state["m"] + state["p"] * run["eta"]) + run["b"], p=run["a"] * run["a"] * d * state["p"] + run["c"])


def _combined_back(x: Column, y: Column) -> Column:
    """Going back: run x, then run y, which lies before it."""
    return _struct(BACK, e=y["e"] * x["e"], g=y["e"] * x["g"] + y["g"], l=y["e"] * y["e"] * x["l"] + y["l"])


def _after_back(state: Column, run: Column) -> Column:
    return _struct(GAUSS, m=run["e"] * state["m"] + run["g"], p=run["e"] * run["e"] * state["p"] + run["l"])


def _folded(runs: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """A non-empty array of runs as one."""
    return F.reduce(F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.element_at(runs, 1), combine)


def _entries(runs: DataFrame, keys: list[str], size: int, combine: Callable, after: Callable, backwards: bool) -> DataFrame:
    """keys, block, entry: the state that each block is entered with, for runs (keys, block, run); the first one is entered with 0, 0."""
    order = F.array_sort(F.collect_list(F.struct("block", "run")))  # at most ``size`` blocks
    runs = runs.withColumn("above", F.floor(F.col("block") / size).cast("long"))
    blocks = runs.groupBy(*keys, "above").agg((F.reverse(order) if backwards else order).alias("blocks"))
    start = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("p")).cast(GAUSS)
    if runs.agg(F.max("above"), F.min("above")).first() in ((0, 0), (None, None)):
        blocks = blocks.withColumn("entry", start)
    else:
        upper = blocks.select(*keys, F.col("above").alias("block"), _folded(F.col("blocks.run"), combine).alias("run"))
        upper = _entries(stored(upper), keys, size, combine, after, backwards)
        blocks = _joined(blocks, upper.withColumnRenamed("block", "above"), [*keys, "above"])
    seat = f"array<struct<block:bigint,entry:{GAUSS},next:{GAUSS}>>"

    def step(done: Column, b: Column) -> Column:
        entry = F.coalesce(F.get(done, F.size(done) - 1)["next"], F.col("entry"))
        return F.concat(done, F.array(_let(entry, lambda e: F.struct(b["block"].alias("block"), e.alias("entry"), after(e, b["run"]).alias("next")))))

    seats = F.aggregate("blocks", F.array().cast(seat), step)
    return blocks.select(*keys, F.explode(seats).alias("z")).select(*keys, "z.block", "z.entry")


def _joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join on columns that may be null."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return left.join(other, same).drop(*[f"__{c}" for c in on])


def _forward(steps: Column, entry: Column) -> Column:
    """The filter over a block's steps."""

    def step(done: Column, s: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        m0, p0 = F.coalesce(last["m"] - last["mu"], entry["m"]), F.coalesce(last["p"], entry["p"])

        def update(q: Column) -> Column:
            seen = s["obs"].isNotNull()
            total = s["beta"] * s["beta"] * q["p"] + s["vdelta"]
            gain = F.when(seen, q["p"] * s["beta"] / total)
            innovation = F.when(seen, s["obs"] - s["alpha"] - s["beta"] * q["m"])
            return _struct(
                STATE,
                **{c: s[c] for c in ("t", "mu", "slope", "r2", "obs")},
                m_pred=q["m"],
                p_pred=q["p"],
                gain=gain,
                innovation=innovation,
                proxy=F.when(seen & (F.abs(s["beta"]) > 1e-10), (s["obs"] - s["alpha"]) / s["beta"]),
                weight=F.when(seen, s["beta"] * s["beta"] * q["p"] / total),
                m=F.when(seen, q["m"] + gain * innovation).otherwise(q["m"]),
                p=F.when(seen, F.greatest((1 - gain * s["beta"]) * q["p"], F.lit(0.0))).otherwise(q["p"]),
            )

        predicted = _struct(GAUSS, m=s["mu"] + s["slope"] * m0, p=s["slope"] * s["slope"] * p0 + s["r2"])
        return F.concat(done, F.array(_let(predicted, update)))

    return F.aggregate(steps, F.array().cast(f"array<{STATE}>"), step)


def _backs(states: Column, following: Column) -> Column:
    """The steps of a block as runs back, last first; ``following`` has slope and r2 of the step after the block (null: none)."""

    def back(s: Column, i: Column) -> Column:
        inner = i < F.size(states) - 1
        after = F.get(states, i + 1)
        slope, r2 = F.when(inner, after["slope"]).otherwise(following["slope"]), F.when(inner, after["r2"]).otherwise(following["r2"])
        ahead = slope * slope * s["p"] + r2
        e = F.when(ahead > 0, s["p"] * slope / ahead).otherwise(0.0)
        z = s["m"] - s["mu"]
        return _let(e, lambda g: _struct(BACK, e=g, g=z - g * F.coalesce(slope, F.lit(0.0)) * z, l=s["p"] - g * g * F.coalesce(ahead, F.lit(0.0))))

    return F.reverse(F.transform(states, back))


def _smoothed(backs: Column, entry: Column) -> Column:
    """The smoothed distance and variance of a block's steps, in order."""

    def step(done: Column, b: Column) -> Column:
        last = F.coalesce(F.get(done, F.size(done) - 1), entry)
        return F.concat(done, F.array(_let(_after_back(last, b), lambda s: _struct(GAUSS, m=s["m"], p=F.greatest(s["p"], F.lit(0.0))))))

    return F.reverse(F.aggregate(backs, F.array().cast(f"array<{GAUSS}>"), step))


def filter_long_series(series: DataFrame, keys: list[str], size: int = 512) -> DataFrame:
    """As ``statespace.filter_series``, for series of any length. Steps t are whole numbers from 0 on, near to dense: a block holds the
    steps of ``size`` numbers in a row."""
    fields = ["t", "mu", "slope", "r2", "obs", "alpha", "beta", "vdelta"]
    steps = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in fields]).cast(STEP)))
    blocks = series.groupBy(*keys, F.floor(F.col("t") / size).cast("long").alias("block")).agg(steps.alias("steps"))
    blocks = stored(blocks)
    runs = blocks.select(*keys, "block", _folded(F.transform("steps", _element), _combined).alias("run"))
    forward = _joined(blocks, _entries(runs, keys, size, _combined, _after, backwards=False), [*keys, "block"])
    states = stored(forward.select(*keys, "block", _forward(F.col("steps"), F.col("entry")).alias("states")))
    # the first step of the next block: blocks without steps may lie between
    firsts = states.select(*keys, "block", F.col("states")[0]["slope"].alias("slope"), F.col("states")[0]["r2"].alias("r2"))
    states = _joined(states, _following(firsts, keys), [*keys, "block"]).withColumn("backs", _backs(F.col("states"), F.col("following")))
    runs = states.select(*keys, "block", _folded(F.col("backs"), _combined_back).alias("run"))
    back = _joined(states, _entries(runs, keys, size, _combined_back, _after_back, backwards=True), [*keys, "block"])
    z = back.select(*keys, F.explode(F.arrays_zip("states", _smoothed(F.col("backs"), F.col("entry")).alias("smooth"))).alias("z"))
    names = ["t", "mu", "slope", "r2", "obs", "m_pred", "p_pred", "gain", "innovation", "proxy", "weight", "m", "p"]
    return z.select(*keys, *[F.col(f"z.states.{c}").alias(c) for c in names], (F.col("z.states.mu") + F.col("z.smooth.m")).alias("m_smooth"), F.col("z.smooth.p").alias("p_smooth"))


def _following(firsts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, block, following: slope and r2 of the next block's first step, null for the last block."""
    w = Window.partitionBy(*keys).orderBy("block")  # a row for ``size`` steps, read in order
    return firsts.select(*keys, "block", F.lead(F.struct("slope", "r2")).over(w).alias("following"))
