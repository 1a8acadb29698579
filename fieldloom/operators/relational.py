"""Relational operators: keyed modes, dense panels, nearest joins, summaries, metrics and reshaping."""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions.geo import SPHERE, np_polygon_km, planar_d2, point_in_degrees, sphere_km
from fieldloom.functions.scalar import is_finite
from fieldloom.session import stored

# keyed reductions


def mode_first(records: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value, n_records: the most frequent value of each key; ties go to the value that occurs first by ``order``."""
    counts = records.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "first")).alias(value), F.sum("n").alias("n_records"))
    return best


def first_by(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the least by ``order``."""
    rest = [c for c in frame.columns if c not in keys]
    picked = frame.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return picked.select(*keys, *[F.col(f"row.{c}").alias(c) for c in rest])


def pick_one(frame: DataFrame, keys: list[str], identity: list[str], seed: str) -> DataFrame:
    """One row per key, drawn by the md5 of its identity and a seed: the same on every engine and run."""
    keyed = frame.withColumn("__draw", F.md5(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in identity])))
    return first_by(keyed, keys, ["__draw", *identity]).drop("__draw")


def first_appearance_ids(records: DataFrame, keys: list[str], order: str, name: str = "id") -> DataFrame:
    """Each distinct key with a dense number from 1 in order of first appearance."""
    firsts = records.groupBy(*keys).agg(F.min(order).alias("__first"))
    return firsts.withColumn(name, F.row_number().over(Window.orderBy("__first", *keys))).drop("__first")


def with_row_ids(frame: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Rows numbered from 1 in a total order. The numbers come from sorted ranges: each task counts its own rows, and starts after the
    sum of the counts of the ranges before it (a row per task)."""
    parts = stored(frame.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    return parts.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") - F.col("__first") + 1).drop("__part", "__at", "__first", "__before", "__n")


def duplicate_keys(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


# dense panels and set operations


def dense_panel(keys: DataFrame, periods: DataFrame, counts: DataFrame, on: list[str], value: str) -> DataFrame:
    """Every key in every period, with the count where there is one and 0 elsewhere."""
    panel = keys.crossJoin(F.broadcast(periods))
    return panel.join(counts, on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0).cast("long")))


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that occur in every frame."""
    union = None
    for k, f in enumerate(frames):
        mine = f.select(key).distinct().withColumn("__from", F.lit(k))
        union = mine if union is None else union.unionByName(mine)
    return union.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") == len(frames)).select(key)


def bind_rows(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def zero_filled_counts(frame: DataFrame, column: str, levels: list) -> DataFrame:
    fixed = frame.sparkSession.createDataFrame([(v,) for v in levels], f"{column} {dict(frame.dtypes)[column]}")
    return fixed.join(frame.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# nearest joins


def nearest_cell(points: DataFrame, grid: DataFrame, small: int = 20_000) -> DataFrame:
    """points (lon, lat, ...) with cell_id and d2 of the planar nearest of grid (cell_id, glon, glat); ties go to the smaller cell_id.
    Points without finite coordinates get null.

    Distinct coordinates are searched once. A grid of at most ``small`` rows, which is counted, is sent to every task;
    a larger one is met by equal lattice squares, whose side doubles until every point's nearest cell is certain, however far.
    """
    sites = points.select("lon", "lat").filter(is_finite(F.col("lon")) & is_finite(F.col("lat"))).distinct()
    n = grid.limit(small + 1).count()
    if n <= small:
        near = _nearest(sites.crossJoin(F.broadcast(grid)))
    else:
        box = grid.agg((F.max("glon") - F.min("glon")).alias("w"), (F.max("glat") - F.min("glat")).alias("h"), F.count("*").alias("n")).first()
        side, near, open_ = max(box["w"], box["h"], 1e-9) / max(1.0, box["n"] ** 0.5) * 2, None, stored(sites)
        while True:
            found = _lattice(open_, grid, side)
            sure = stored(found.filter(F.col("d2") <= side * side))
            near = sure if near is None else near.unionByName(sure)
            open_ = stored(open_.join(sure.select("lon", "lat"), ["lon", "lat"], "left_anti"))
            if open_.isEmpty():
                break
            side *= 2
    return points.join(near, ["lon", "lat"], "left")


def zonal_means(cells: DataFrame, grid: DataFrame, values: list[str], small: int = 20_000) -> DataFrame:
    """cell_id and the mean of each value over the rows of cells (lon, lat, values) that are nearest to that cell; null where none has the value."""
    near = nearest_cell(cells, grid, small).filter("cell_id is not null")
    return near.groupBy("cell_id").agg(*[F.avg(v).alias(v) for v in values])


def nearest_year_value(frame: DataFrame, year: str, columns: dict[int, str]) -> DataFrame:
    """The frame with reference (the year of columns nearest to its own, the earlier of two) and value (that column's)."""
    f = frame.withColumn("reference", nearest_value(F.col(year), sorted(columns)))
    value = F.coalesce(*[F.when(F.col("reference") == y, F.col(c)) for y, c in columns.items()])
    return f.withColumn("value", value)


def nearest_on_sphere(points: DataFrame, grid: DataFrame, small: int = 20_000) -> DataFrame:
    """As nearest_cell, by great-circle distance (km), also across the date line and the poles. A larger grid is met by equal cubes of
    unit vectors: a cell no farther than a cube's side lies in the cubes around the point's own, and the side doubles until all are certain."""
    sites = points.select("lon", "lat").filter(is_finite(F.col("lon")) & is_finite(F.col("lat"))).distinct()
    n = grid.limit(small + 1).count()
    if n <= small:
        near = _nearest_km(sites.crossJoin(F.broadcast(grid)))
    else:
        side, near, open_ = 2 * math.sqrt(4 * math.pi / grid.count()), None, stored(sites)
        while True:
            found = _cubes(open_, grid, side)
            sure = stored(found if side >= 2 else found.filter(2 * F.sin(F.col("km") / (2 * SPHERE)) <= side))  # chords are at most 2
            near = sure if near is None else near.unionByName(sure)
            open_ = stored(open_.join(sure.select("lon", "lat"), ["lon", "lat"], "left_anti"))
            if open_.isEmpty():
                break
            side *= 2
    return points.join(near, ["lon", "lat"], "left")


def _nearest_km(pairs: DataFrame) -> DataFrame:
    km = sphere_km(F.col("lon"), F.col("lat"), F.col("glon"), F.col("glat"))
    best = pairs.groupBy("lon", "lat").agg(F.min(F.struct(km.alias("km"), "cell_id")).alias("best"))
    return best.select("lon", "lat", F.col("best.cell_id").alias("cell_id"), F.col("best.km").alias("km"))


def _cubes(sites: DataFrame, grid: DataFrame, side: float) -> DataFrame:
    """The nearest cell among those in the cubes around each site's unit vector."""

    def cube(lon: str, lat: str) -> list[Column]:
        a, b = F.radians(lat), F.radians(lon)
        vector = (F.cos(a) * F.cos(b), F.cos(a) * F.sin(b), F.sin(a))
        return [F.floor(v / side).alias(k) for v, k in zip(vector, ("cx", "cy", "cz"), strict=True)]

    steps = F.array(*[F.struct(*[F.lit(v).alias(k) for v, k in zip(o, ("ox", "oy", "oz"), strict=True)]) for o in product((-1, 0, 1), repeat=3)])
    spread = sites.select("lon", "lat", *cube("lon", "lat"), F.explode(steps).alias("o"))
    spread = spread.select("lon", "lat", *[(F.col(f"c{k}") + F.col(f"o.o{k}")).alias(f"c{k}") for k in "xyz"])
    return _nearest_km(spread.join(grid.select("cell_id", "glon", "glat", *cube("glon", "glat")), ["cx", "cy", "cz"]))


def without_positions(frame: DataFrame, keys: list[str], order: str, positions: list[int]) -> DataFrame:
    """Rows but those at the given places (from 1) of each key's order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return frame.withColumn("__place", F.row_number().over(w)).filter(~F.col("__place").isin(positions)).drop("__place")


def within_windows(frame: DataFrame, windows: list[tuple], key: str, step: str) -> DataFrame:
    """Rows with start < step <= end of their key's window; windows: (key, start, end), a table of parameters."""
    table = frame.sparkSession.createDataFrame(windows, f"__key {dict(frame.dtypes)[key]}, __start int, __end int")
    return frame.join(F.broadcast(table), F.col(key) == F.col("__key")).filter((F.col(step) > F.col("__start")) & (F.col(step) <= F.col("__end"))).drop("__key", "__start", "__end")


def first_argmax(*columns: str) -> Column:
    """Place (from 1) of the greatest of the columns, the first of equals."""
    a = F.array(*[F.col(c) for c in columns])
    return F.array_position(a, F.array_max(a)).cast("int")


def square_limits(frame: DataFrame, columns: list[str], padding: float = 0.05) -> DataFrame:
    """lo and hi over all columns, widened by a share of their span."""
    lo, hi = F.least(*[F.min(c) for c in columns]), F.greatest(*[F.max(c) for c in columns])
    one = frame.agg(lo.alias("a"), hi.alias("b"))
    return one.select((F.col("a") - padding * (F.col("b") - F.col("a"))).alias("lo"), (F.col("b") + padding * (F.col("b") - F.col("a"))).alias("hi"))


def joined_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """An inner join that must keep every row of both sides once."""
    out = left.join(right, on)
    n = [f.count() for f in (left, right, out)]
    if len(set(n)) != 1:
        raise ValueError(f"not one to one: {n[0]} and {n[1]} rows give {n[2]}")
    return out


def report(rows: DataFrame, title: str, most: int = 200) -> str:
    """A text report of a small table (a summary), one line per row; a table of more than ``most`` rows is no summary."""
    lines, found = [title, "=" * len(title)], rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report takes at most {most} rows")
    for r in found:
        lines.append("; ".join(f"{k} = {v:.6g}" if isinstance(v, float) else f"{k} = {v}" for k, v in r.asDict().items()))
    return "\n".join(lines) + "\n"


def _nearest(pairs: DataFrame) -> DataFrame:
    d2 = planar_d2(F.col("lon"), F.col("lat"), F.col("glon"), F.col("glat"))
    best = pairs.groupBy("lon", "lat").agg(F.min(F.struct(d2.alias("d2"), "cell_id")).alias("best"))
    return best.select("lon", "lat", F.col("best.cell_id").alias("cell_id"), F.col("best.d2").alias("d2"))


def _lattice(sites: DataFrame, grid: DataFrame, side: float) -> DataFrame:
    square = lambda a, b: (F.floor(F.col(a) / side).alias("sx"), F.floor(F.col(b) / side).alias("sy"))
    around = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    spread = sites.select("lon", "lat", *square("lon", "lat"), around.alias("o")).select("lon", "lat", (F.col("sx") + F.col("o.dx")).alias("sx"), (F.col("sy") + F.col("o.dy")).alias("sy"))
    return _nearest(spread.join(grid.select("cell_id", "glon", "glat", *square("glon", "glat")), ["sx", "sy"]))


def nearest_value(x: Column, values: list[int]) -> Column:
    """The nearest of a fixed list; ties go to the smaller."""
    best = F.array_min(F.transform(F.array(*[F.lit(v) for v in sorted(values)]), lambda v: F.struct(F.abs(v - x).alias("d"), v.alias("v"))))
    return F.when(x.isNotNull(), best["v"])


def within_polygons(points: DataFrame, rings: list, km: float) -> DataFrame:
    """Points (lon, lat, ...) at most km from a union of polygons; rings: lists of (lon, lat), bounded and sent to the tasks."""
    shapes = [np.asarray(r, dtype=float) for r in rings]
    every, pad = np.concatenate(shapes), point_in_degrees(km)
    top = min(89.0, float(np.abs(every[:, 1]).max()) + pad)
    wide = pad / float(np.cos(np.radians(top)))

    @F.pandas_udf("boolean")
    def near(lon: pd.Series, lat: pd.Series) -> pd.Series:
        return pd.Series(np_polygon_km(lon.to_numpy(float), lat.to_numpy(float), shapes) <= km)

    box = F.col("lon").between(float(every[:, 0].min()) - wide, float(every[:, 0].max()) + wide) & F.col("lat").between(float(every[:, 1].min()) - pad, float(every[:, 1].max()) + pad)
    return points.filter(box).filter(near("lon", "lat"))


# windows


def centred(frame: DataFrame, keys: list[str], value: str, name: str = "anomaly") -> DataFrame:
    """value minus its mean by key, by a sum and an equal join, so that no key's rows must fit a task."""
    means = frame.groupBy(*keys).agg(F.avg(value).alias("__mean"))
    return frame.join(means, keys).withColumn(name, F.col(value) - F.col("__mean")).drop("__mean")


def running_max(frame: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn(value, F.max(value).over(w))


def first_of_levels(table: DataFrame, keys: list[str], x: str, p: str) -> DataFrame:
    """Of a monotone table, the least x of each level p: what an inverse needs."""
    return running_max(table, keys, x, p).groupBy(*keys, p).agg(F.min(x).alias(x))


def spacing(frame: DataFrame, column: str) -> DataFrame:
    """The least positive step between distinct values."""
    d = frame.select(column).filter(F.col(column).isNotNull()).distinct()
    step = F.col(column) - F.lag(column).over(Window.orderBy(column))
    return d.select(step.alias("step")).filter("step > 0").agg(F.min("step").alias("step"))


# summaries and metrics


def stats(columns: list[str], which: tuple[str, ...] = ("mean", "sd", "min", "max")) -> list[Column]:
    """Aggregates named column_stat."""
    known = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max, "median": F.median, "var": F.var_samp}
    return [known[s](c).alias(f"{c}_{s}") for c in columns for s in which]


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def pair_metrics(frame: DataFrame, keys: list[str], reference: str, estimate: str) -> DataFrame:
    """n, correlation, bias (estimate minus reference), rmse, anomaly_correlation and anomaly_rmse over rows where both are finite; null below two rows."""
    r, e = F.col(reference).cast("double"), F.col(estimate).cast("double")
    d = e - r
    two = lambda c: F.when(F.count("*") >= 2, c)
    return frame.filter(is_finite(r) & is_finite(e)).groupBy(*keys).agg(
        F.count("*").alias("n"),
        two(F.corr(r, e)).alias("correlation"),
        two(F.avg(d)).alias("bias"),
        two(F.sqrt(F.avg(d * d))).alias("rmse"),
        two(F.corr(r, e)).alias("anomaly_correlation"),
        two(F.sqrt(F.var_pop(d))).alias("anomaly_rmse"),
    )


def displacement(estimate: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """Shares of rows below both and above both."""
    return share(estimate < F.least(a, b)), share(estimate > F.greatest(a, b))


def complete_mean(frame: DataFrame, keys: list[str], part: str, value: str, parts: int = 12, scale: float = 1.0, name: str = "mean") -> DataFrame:
    """The mean over parts (months) of each key that has all of them, divided by scale."""
    one = frame.groupBy(*keys, part).agg(F.avg(value).alias("__v"))
    return one.groupBy(*keys).agg(F.count("__v").alias("__n"), (F.avg("__v") / scale).alias(name)).filter(F.col("__n") == parts).drop("__n")


def histogram(frame: DataFrame, value: str, lo: float, width: float, bins: int, keys: list[str] | None = None) -> DataFrame:
    """bin, n and density of values in [lo, lo + bins * width]; the last bin is closed."""
    keys = keys or []
    k = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("int")
    inside = frame.filter((F.col(value) >= lo) & (F.col(value) <= lo + bins * width))
    counts = inside.groupBy(*keys, k.alias("bin")).agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("__all")) if keys else counts.agg(F.sum("n").alias("__all"))
    joined = counts.join(total, keys) if keys else counts.crossJoin(F.broadcast(total))
    return joined.select(*keys, "bin", "n", (F.col("n") / (F.col("__all") * F.lit(width))).alias("density"))


def kernel_density(frame: DataFrame, value: str, at: list[float], bandwidth: float, keys: list[str] | None = None) -> DataFrame:
    """Gaussian kernel density at fixed places, all in one pass: one sum for each place."""
    keys = keys or []
    kernels = [F.avg(F.exp(-((F.lit(x) - F.col(value)) / bandwidth) * ((F.lit(x) - F.col(value)) / bandwidth) / 2)).alias(f"k{i}") for i, x in enumerate(at)]
    wide = frame.groupBy(*keys).agg(*kernels)
    scale = bandwidth * 2.5066282746310002
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("x"), (F.col(f"k{i}") / scale).alias("density")) for i, x in enumerate(at)])).alias("p")).select(*keys, "p.x", "p.density")


def long_diagnostics(row: DataFrame) -> DataFrame:
    """(quantity, value) with values as text, from a one-row aggregate."""
    return row.select(*[F.col(c).cast("string").alias(c) for c in row.columns]).unpivot([], row.columns, "quantity", "value")


# reshaping


def wide_to_long(frame: DataFrame, ids: list[str], pattern: str, name: str = "name", value: str = "value") -> DataFrame:
    columns = [c for c in frame.columns if re.fullmatch(pattern, c)]
    return frame.unpivot(ids, columns, name, value)


def long_to_wide(frame: DataFrame, ids: list[str], name: str, values: list, value: str, prefix: str = "") -> DataFrame:
    wide = frame.groupBy(*ids).pivot(name, values).agg(F.first(value))
    return wide.toDF(*ids, *[f"{prefix}{v}" for v in values])


def year_columns(columns: list[str], lo: int = 1000, hi: int = 3000) -> dict[str, int]:
    """Columns such as x1850, X1850 or 1850, with their years."""
    found = {c: int(m[1]) for c in columns if (m := re.fullmatch(r"[Xx]?([0-9]{4})", c))}
    return {c: y for c, y in found.items() if lo <= y <= hi}


def with_alias(frame: DataFrame, name: str, *others: str) -> DataFrame:
    """The frame with the first of the other names that it has renamed to name, unless it has name."""
    if name in frame.columns:
        return frame
    for o in others:
        if o in frame.columns:
            return frame.withColumnRenamed(o, name)
    raise ValueError(f"none of {[name, *others]} is a column")
