"""Inverse of a kernel distribution function by bracketed root finding, and the quantile map of an index with its band.

A round is one pass over the sample: it evaluates the distribution and its density at a few places of every bracket as sums
that tasks combine before they are shuffled, then narrows each bracket to at most an eighth and takes Newton's step where that
stays inside. No task holds a key's sample, and a hot key's rows are dealt by salts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.normal import norm_cdf, norm_pdf
from fieldloom.session import discard, stored

_PLACE = "struct(at, miss, density)"


def kernel_inverse(
    targets: DataFrame, sample: DataFrame, keys: list[str], value: str, bandwidth: Column | float, u: str = "u",
    tol: float = 1e-6, clip: float = 1e-8, sds: float = 8.0, salts: int = 16,
) -> DataFrame:
    """The rows of targets (keys, u and others) with x, at which the kernel distribution function of the key's sample reaches u.

    u is clipped to clip and 1 - clip; the bracket reaches sds standard deviations of the sample, or sds bandwidths if that is
    more, beyond its ends. Null, NaN and infinite sample values take no part. x is null where u is null or NaN, where a key is
    null, and where the key's sample is empty or does not vary (its inverse would be a step).
    """
    h = bandwidth if isinstance(bandwidth, Column) else F.lit(float(bandwidth))
    valid = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")) & (F.col("h") > 0)
    values = sample.select(*keys, F.col(value).cast("double").alias("v"), h.alias("h")).filter(valid)
    values = stored(values.groupBy(*keys, "v", "h").agg(F.count("*").alias("n")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")))
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("v")) / F.sum("n")
    ends = values.groupBy(*keys).agg(total.alias("total"), mean.alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"), F.max("h").alias("width"))
    spread = values.join(ends, keys).groupBy(*keys).agg(F.sum(F.col("n") * F.pow(F.col("v") - F.col("mean"), F.lit(2.0))).alias("squares"))
    far = sds * F.greatest(F.sqrt(F.try_divide(F.col("squares"), F.col("total") - 1)), F.col("width"))
    ends = ends.join(spread, keys).filter("most > least").select(*keys, "total", (F.col("least") - far).alias("lo"), (F.col("most") + far).alias("hi"))

    targets = stored(targets)  # read twice below: sums computed twice may differ in their last bit, and their roots would not be found
    asked = F.when(F.col(u).isNotNull() & ~F.isnan(u), F.greatest(F.least(F.col(u).cast("double"), F.lit(1 - clip)), F.lit(clip)))
    places = targets.select(*keys, asked.alias("u")).filter("u is not null").distinct().join(ends, keys)
    state = stored(places.withColumns({"x": (F.col("lo") + F.col("hi")) / 2, "step": F.col("hi") - F.col("lo")}))
    open_ = F.least("step", F.col("hi") - F.col("lo")) > tol
    while not state.filter(open_).isEmpty():
        state, old = stored(_narrowed(state.filter(open_), values, keys, salts).unionByName(state.filter(~open_))), state
        discard(old)
    discard(values)
    roots = state.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("u").alias("__u"), F.col("x"))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in keys], asked == F.col("__u"))
    return targets.join(roots, same, "left").drop("__u", *[f"__{k}" for k in keys])


def _narrowed(state: DataFrame, values: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """The brackets after one pass: their ends, the next place x and how far that is from the last one."""
    part = (F.col("hi") - F.col("lo")) / 8
    tried = F.array_distinct(F.array("x", *[F.col("lo") + part * k for k in range(1, 8)]))
    asked = state.select(*keys, "u", "total", "lo", "hi", F.explode(tried).alias("at")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    z = (F.col("at") - F.col("v")) / F.col("h")
    seen = asked.join(values, [*keys, "salt"]).groupBy(*keys, "u", "total", "lo", "hi", "at").agg(
        (F.sum(F.col("n") * norm_cdf(z)) / F.col("total") - F.col("u")).alias("miss"), (F.sum(F.col("n") * norm_pdf(z) / F.col("h")) / F.col("total")).alias("density")
    )
    ends = seen.groupBy(*keys, "u", "total", "lo", "hi").agg(
        F.max(F.when(F.col("miss") < 0, F.expr(_PLACE))).alias("a"), F.min(F.when(F.col("miss") >= 0, F.expr(_PLACE))).alias("b")
    )
    left = F.coalesce(-F.col("a.miss"), F.lit(2.0)) < F.coalesce("b.miss", F.lit(2.0))  # the end that misses by less
    near = {c: F.when(left, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")) for c in ("at", "miss", "density")}
    newton = near["at"] - F.try_divide(near["miss"], near["density"])
    found = ends.select(*keys, "u", "total", F.coalesce("a.at", "lo").alias("lo"), F.coalesce("b.at", "hi").alias("hi"), near["at"].alias("at"), newton.alias("newton"))
    inside = (F.col("newton") >= F.col("lo")) & (F.col("newton") <= F.col("hi"))
    x = F.when(inside, F.col("newton")).otherwise((F.col("lo") + F.col("hi")) / 2)
    step = F.when(inside, F.abs(F.col("newton") - F.col("at"))).otherwise(F.col("hi") - F.col("lo"))
    return found.withColumns({"x": x, "step": step}).drop("at", "newton")


def index_probability(at: DataFrame, estimates: DataFrame, keys: list[str], y: str, mean: str = "yhat", sd: str = "sd", floor: float = 1e-8) -> DataFrame:
    """The distinct (keys, y) of at with u: the mean over the key's estimates of Phi((y - mean) / sd)."""
    z = (F.col(y) - F.col("__m")) / F.greatest(F.col("__s"), F.lit(floor))
    e = estimates.select(*keys, F.col(mean).alias("__m"), F.col(sd).alias("__s"))
    return at.select(*keys, y).distinct().join(e, keys).groupBy(*keys, y).agg(F.avg(norm_cdf(z)).alias("u"))


def map_index(
    estimates: DataFrame, sample: DataFrame, keys: list[str], time: str, value: str, bandwidth: Column | float,
    curve: tuple[float, float, int] = (-2.0, 1.0, 150), mean: str = "yhat", sd: str = "sd", **how,
) -> tuple[DataFrame, DataFrame]:
    """An index (keys, time, mean, sd) on the scale of a sample (keys, value): the curve of the map at evenly spaced places
    (keys, y, x), and the mapped estimates with their band of one standard deviation, in order (keys, time, x, lower, upper).

    A null mean gives null results, a null sd a null band.
    """
    lo, hi, n = curve
    estimates = stored(estimates.select(*keys, time, mean, sd))  # read several times, and joined by places that follow from it
    places = F.array(*[F.lit(lo + (hi - lo) * i / (n - 1)) for i in range(n)])
    grid = estimates.select(*keys).distinct().select(*keys, F.explode(places).alias("y"))
    rows = estimates.select(*keys, time, F.col(mean).alias("yhat"), F.col(sd).alias("sd"))
    three = rows.select(*keys, time, F.posexplode(F.array(F.col("yhat"), F.col("yhat") - F.col("sd"), F.col("yhat") + F.col("sd"))).alias("part", "y"))
    whole = estimates.filter(F.col(mean).isNotNull() & F.col(sd).isNotNull())
    asked = index_probability(grid.unionByName(three.select(*keys, "y")), whole, keys, "y", mean, sd)
    mapped = stored(kernel_inverse(asked, sample, keys, value, bandwidth, **how).select(*keys, "y", "x"))
    part = lambda k: F.max(F.when(F.col("part") == k, F.col("x")))
    rows = three.join(mapped, [*keys, "y"], "left").groupBy(*keys, time).agg(part(0).alias("x"), part(1).alias("__a"), part(2).alias("__b"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    band = {"lower": F.when(both, F.least("__a", "__b")), "upper": F.when(both, F.greatest("__a", "__b"))}
    return grid.join(mapped, [*keys, "y"], "left"), rows.withColumns(band).drop("__a", "__b")
