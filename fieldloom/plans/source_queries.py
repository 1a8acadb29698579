"""Queries that write and read again through sources and sinks, and queries of expectations and small helpers, each with its SQL."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fieldloom.functions.geo import RADIUS, SPHERE
from fieldloom.functions.projection import to_lonlat
from fieldloom.functions.scalar import fixed, fixed_sql, is_finite
from fieldloom.operators import areas, contours, expect, relational as R, statespace
from fieldloom.plans import fixtures as X
from fieldloom.session import ensure_checkpoint_dir, stored
from fieldloom.sources import files, polygons, raster, xlsx

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared one; what a lazy result reads stays there."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/fieldloom-files-{uuid.uuid4().hex}"


# files written and read again

CUSTOMER = "c_custkey long, c_name string, c_acctbal double, c_mktsegment string"


def _customer(spark, d) -> DataFrame:
    return X.read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment")


CUSTOMER_SQL = "SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer"


@query(CUSTOMER_SQL)
def csv_scan(spark, d):
    path = _folder(spark)
    files.write_csv(_customer(spark, d), path)
    return files.read_csv(spark, path, CUSTOMER)


@query(f"SELECT CAST(c_custkey AS INTEGER) AS c_custkey, c_name, c_acctbal, c_mktsegment FROM ({CUSTOMER_SQL})")
def csv_inferred_scan(spark, d):
    path = _folder(spark)
    files.write_csv(_customer(spark, d), path)
    return files.read_csv_inferred(spark, path)


@query(f"""WITH {X.CUBE}, v AS (SELECT member, year, month, avg(value) AS value FROM cube GROUP BY ALL)
SELECT CAST(k.member AS INTEGER) AS member, k.year, CAST(m AS INTEGER) AS month, {fixed_sql('value', 4)} AS value FROM (SELECT DISTINCT member, year FROM v) k CROSS JOIN (SELECT unnest(range(1, 13)) AS m) LEFT JOIN v ON v.member = k.member AND v.year = k.year AND v.month = m""")
def workbook_triples(spark, d):
    """A workbook for each member, written by tasks, with a value and two flags for each month of a year; the values alone are read."""
    folder = _folder(spark).removeprefix("file:")
    months = X.cube(spark, d).groupBy("member", "year", "month").agg(F.avg("value").alias("value"))
    wide = months.groupBy("member", "year").pivot("month", list(range(1, 13))).agg(F.first("value"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{key[0]}.xlsx")
        lines = [[int(r[0]), int(r[1]), "id", *[x for v in r[2:] for x in (float(v), "a", "b")]] for r in rows.itertuples(index=False)]
        part = f"{path}.{uuid.uuid4().hex}"  # the file takes its name when it is whole
        xlsx.write_rows(part, lines, ["member", "year", "kind", *[x for m in range(1, 13) for x in (f"month{m}", "flag", "source")]])
        os.replace(part, path)
        return pd.DataFrame({"member": [key[0]]})

    wide.groupBy("member").applyInPandas(one, "member int").count()
    return xlsx.read_triples(spark, folder, {"member": 1, "year": 2}).select("member", "year", "month", fixed(F.col("value"), 4).alias("value"))


@query(CUSTOMER_SQL)
def csv_gzip_scan(spark, d):
    path = _folder(spark)
    files.write_csv(_customer(spark, d), path, gzip=True)
    return files.read_csv(spark, path, CUSTOMER)


@query("SELECT n_nationkey, n_name, 'n_nationkey,n_name' AS header FROM nation")
def csv_with_mark(spark, d):
    """With a byte-order mark, which the header is read without."""
    path = _folder(spark)
    files.write_csv(X.read(spark, d, "nation").select("n_nationkey", "n_name").coalesce(1), path, bom=True)
    names = files.header_of(spark, path)
    return files.read_csv(spark, path, StructType([StructField(names[0], LongType()), StructField(names[1], StringType())])).withColumn("header", F.lit(",".join(names)))


MONTHS = [(y, m) for y in (1995, 1996) for m in range(1, 13)]


@query(
    f"""WITH {X.CUBE}, v AS (SELECT location, year, month, avg(value) AS value FROM cube WHERE member = 1 AND year BETWEEN 1995 AND 1996 GROUP BY ALL),
t AS (SELECT DISTINCT location FROM v) SELECT CAST(t.location AS DOUBLE) AS lon, 0.5 AS lat, 1 AS member, CAST(y AS INT) AS year, CAST(m AS INT) AS month, {fixed_sql('value')} AS value
FROM t CROSS JOIN (SELECT unnest([1995, 1996]) AS y) CROSS JOIN (SELECT unnest(range(1, 13)) AS m) LEFT JOIN v ON v.location = t.location AND v.year = y AND v.month = m"""
)
def wide_months_scan(spark, d):
    """A gzip file with a column per month of two years, read as one row per cell and month."""
    path, c = _folder(spark), X.cube(spark, d).filter("member = 1 and year between 1995 and 1996")
    names = [f"T_{y}_{m:02d}" for y, m in MONTHS]
    wide = c.withColumn("name", F.format_string("T_%d_%02d", "year", "month")).groupBy("location").pivot("name", names).agg(F.avg("value"))
    files.write_csv(wide.select(F.col("location").cast("double").alias("lon"), F.lit(0.5).alias("lat"), *names).coalesce(1), path, gzip=True)
    long = files.read_wide_months(spark, path, 1)
    return long.select("lon", "lat", "member", "year", "month", fixed(F.col("value")).alias("value"))


@query(f"WITH {X.ANNUAL}, w AS (SELECT location, year, avg(temp) AS value FROM annual GROUP BY ALL) SELECT CAST(l.location AS BIGINT) AS location, CAST(y AS INT) AS year, {fixed_sql('value')} AS value FROM (SELECT DISTINCT location FROM w) l CROSS JOIN (SELECT unnest(range(1993, 1998)) AS y) LEFT JOIN w ON w.location = l.location AND w.year = y")
def wide_years_scan(spark, d):
    path = _folder(spark)
    a = X.annual(spark, d).groupBy("location", "year").agg(F.avg("temp").alias("value"))
    files.write_csv(files.wide_years(a, ["location"], list(range(1993, 1998))).coalesce(1), path)
    long = files.read_wide_years(spark, path, StructType([StructField("location", LongType())]))
    return long.select("location", "year", fixed(F.col("value")).alias("value"))


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def archive_scan(spark, d):
    path = _folder(spark)
    files.write_archive({"cells": X.read(spark, d, "nation"), "areas": X.read(spark, d, "region")}, path)
    a = files.read_archive(spark, path, ["cells", "areas"])
    return a["cells"].join(a["areas"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1421 ELSE 1850 END + (o_orderkey % 600) // 12 AS INT) AS year, CAST((o_orderkey % 600) % 12 + 1 AS INT) AS month FROM orders")
def member_assembly(spark, d):
    o = X.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 600).cast("int").alias("step"))
    return files.assemble_members(o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 2 <> 0"), 1421, 1850).select("o_orderkey", "year", "month")


@query("""WITH a AS (SELECT s_nationkey AS x, s_suppkey AS y, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS v FROM supplier), b AS (SELECT s_nationkey AS x, s_suppkey AS y, CASE WHEN s_acctbal > 5000 THEN s_acctbal END AS v FROM supplier WHERE s_nationkey > 3)
SELECT CAST(coalesce(a.x, b.x) AS BIGINT) AS x, CAST(coalesce(a.y, b.y) AS BIGINT) AS y, a.v AS pop_1850, b.v AS pop_1900 FROM a FULL JOIN b ON a.x = b.x AND a.y = b.y WHERE coalesce(a.v, b.v) IS NOT NULL""")
def raster_cells(spark, d):
    s = X.read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("x"), F.col("s_suppkey").cast("long").alias("y"), "s_acctbal")
    band = lambda least: s.select("x", "y", F.when(F.col("s_acctbal") > least, F.col("s_acctbal")).alias("value"))
    return files.cells_of_rasters({1850: band(0), 1900: band(5000).filter("x > 3")})


BANDS = (1776, 1820, 1851, 1880, 1910)
#: Rows, columns, left and top edge and size of a raster's cells, in metres of Mercator.
RASTER = (49, 53, 10909310.0, 5311970.0, 55000.0, 64000.0)
_PANEL = [1700, 1798, 1840, 1866, 1905]


@query(f"""WITH {X.GRID}, c AS (SELECT list_extract({list(BANDS)}, CAST(c_nationkey % 5 + 1 AS INT)) AS band, c_custkey * 53 % 245 // 5 AS y, c_custkey * 37 % 265 // 5 AS x, avg(c_acctbal) AS v FROM customer WHERE c_acctbal > 0 GROUP BY ALL),
s AS (SELECT x, y, {', '.join(f'max(v) FILTER (band = {b}) AS pop_{b}' for b in BANDS)} FROM c GROUP BY ALL),
p AS (SELECT *, degrees(({RASTER[2]} + (x + 0.5) * {RASTER[4]}) / {RADIUS * 1000!r}) AS lon, degrees(2 * atan(exp(({RASTER[3]} - (y + 0.5) * {RASTER[5]}) / {RADIUS * 1000!r})) - pi() / 2) AS lat FROM s),
near AS (SELECT p.x, p.y, arg_min(cell_id, (lon - glon) * (lon - glon) + (lat - glat) * (lat - glat)) AS cell_id FROM p CROSS JOIN grid GROUP BY ALL),
z AS (SELECT cell_id, {', '.join(f'avg(pop_{b}) AS pop_{b}' for b in BANDS)} FROM p JOIN near USING (x, y) GROUP BY cell_id),
t AS (SELECT grid.cell_id, y.year, (SELECT arg_min(r, (abs(r - y.year), r)) FROM (SELECT unnest({list(BANDS)}) AS r)) AS reference FROM grid CROSS JOIN (SELECT unnest({_PANEL}) AS year) y)
SELECT t.cell_id, CAST(year AS INT) AS year, CAST(reference AS INT) AS reference, {fixed_sql("ln(1 + CASE reference " + ' '.join(f'WHEN {b} THEN pop_{b}' for b in BANDS) + " END)")} AS population FROM t LEFT JOIN z USING (cell_id)""")
def raster_population(spark, d):
    """Balances written as five rasters and read again as a stack, projected, averaged by grid cell, and taken at the nearest year."""
    rows, columns, *place = RASTER
    band = F.element_at(F.array(*[F.lit(b) for b in BANDS]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    c = X.read(spark, d, "customer").filter("c_acctbal > 0").select(band.alias("band"), F.expr("c_custkey * 53 % 245 div 5").alias("row"), F.expr("c_custkey * 37 % 265 div 5").alias("col"), "c_acctbal")
    paths = raster.write_rasters(c.groupBy("band", "row", "col").agg(F.avg("c_acctbal").alias("value")), _folder(spark), (rows, columns), *place, crs=3857)
    lon, lat = to_lonlat(F.col("x"), F.col("y"), raster.Raster(next(iter(paths.values()))).geometry.crs)
    stack = raster.read_stack(spark, paths).select(lon.alias("lon"), lat.alias("lat"), *[f"pop_{b}" for b in paths])
    cells = R.zonal_means(stack, X.grid(spark, d), [f"pop_{b}" for b in paths])
    panel = X.grid(spark, d).select("cell_id", F.explode(F.array(*[F.lit(y) for y in _PANEL])).alias("year")).join(cells, "cell_id", "left")
    found = R.nearest_year_value(panel, "year", {b: f"pop_{b}" for b in paths})
    return found.select("cell_id", "year", "reference", fixed(F.log1p("value")).alias("population"))


@query("SELECT CAST(n_nationkey AS BIGINT) AS unit, CAST(n_nationkey * 2 + CASE WHEN n_nationkey < 10 THEN 0 ELSE 1000 END AS BIGINT) AS result FROM nation")
def resumed_work(spark, d):
    """Units under 10 are done by a first run; a second one, which would add 1000, does the others alone."""
    units = X.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("unit"))
    work = files.Checkpoint(spark, _folder(spark), {"penalty": 1000}, ["unit"])
    work.run(units.filter("unit < 10"), lambda left: left.withColumn("result", F.col("unit") * 2))
    return work.run(units, lambda left: left.withColumn("result", F.col("unit") * 2 + 1000)).select("unit", "result")


@query("SELECT * FROM (VALUES ('auto', 'precomputed', 2), ('precomputed', 'precomputed', 2), ('first folder', 'precomputed', 1)) t(mode, taken, n_files)")
def source_resolution(spark, d):
    """Of two sets the first lacks a file, so the second is taken."""
    root = _folder(spark)
    nation = X.read(spark, d, "nation")
    for name in ("generated/a", "precomputed/a", "precomputed/b"):
        nation.write.parquet(f"{root}/{name}")
    sets = {s: [f"{root}/{s}/a", f"{root}/{s}/b"] for s in ("generated", "precomputed")}
    rows = [(mode, *((r := files.resolve_set(spark, sets, mode))[0], len(r[1]))) for mode in ("auto", "precomputed")]
    rows.append(("first folder", files.first_folder_with(spark, [f"{root}/generated", f"{root}/precomputed"], ["b"]).rsplit("/", 1)[1], 1))
    return spark.createDataFrame(rows, "mode string, taken string, n_files int")


@query("SELECT * FROM (VALUES ('a', true, false), ('b', true, false), ('kept', false, true)) t(name, deleted, there)")
def deleted_outputs(spark, d):
    root = _folder(spark)
    for name in ("a", "b", "kept"):
        X.read(spark, d, "region").write.parquet(f"{root}/{name}")
    gone = files.delete_outputs(spark, root, ["a", "b", "never"])
    return spark.createDataFrame([(n, n in gone, files.exists(spark, f"{root}/{n}")) for n in ("a", "b", "kept")], "name string, deleted boolean, there boolean")


# expectations: the rows that break them


def _holes(spark, d) -> DataFrame:
    """Orders with nulls, NaN and infinite values."""
    o = X.read(spark, d, "orders")
    odd = F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).when(F.col("o_orderkey") % 11 == 0, F.lit(float("inf"))).when(F.col("o_orderkey") % 13 == 0, None)
    return o.select("o_orderkey", odd.otherwise(F.col("o_totalprice").cast("double")).alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("status"))


ODD = "(o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0)"


@query(f"SELECT 'price' AS \"column\", CAST(count(*) FILTER (WHERE {ODD}) AS BIGINT) AS n FROM orders HAVING n > 0")
def non_finite_counts(spark, d):
    return expect.not_finite(_holes(spark, d).withColumn("key", F.col("o_orderkey").cast("double")), ["price", "key"])


@query(f"SELECT o_orderkey FROM orders WHERE NOT {ODD} AND o_orderkey % 5 <> 0")
def complete_cases(spark, d):
    return _holes(spark, d).filter(is_finite(F.col("price"))).dropna(subset=["status"]).select("o_orderkey")


@query("SELECT * FROM (VALUES ('a column too many', 'not exact'), ('all there', 'missing: none'), ('one lost', 'missing: n_area')) t(what, found)")
def column_expectations(spark, d):
    n = X.read(spark, d, "nation")
    try:
        expect.require_exact_columns(n, ["n_nationkey"])
        exact = "exact"
    except expect.ExpectationError:
        exact = "not exact"
    told = lambda names: "missing: " + (", ".join(expect.missing_columns(n, names)) or "none")
    return spark.createDataFrame([("a column too many", exact), ("all there", told(["n_nationkey", "n_name"])), ("one lost", told(["n_name", "n_area"]))], "what string, found string")


@query("SELECT v AS c_mktsegment, p AS problem FROM (SELECT DISTINCT c_mktsegment AS v, 'unexpected' AS p FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'SPACE') UNION ALL SELECT 'SPACE', 'missing')")
def entity_set(spark, d):
    return expect.unexpected_entities(X.read(spark, d, "customer"), "c_mktsegment", ["BUILDING", "SPACE"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_discount - l_tax) > 0.015")
def tolerance_violations(spark, d):
    return expect.apart(X.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_discount", "l_tax", 0.015).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM (SELECT *, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders) WHERE o_totalprice < before")
def unsorted_rows(spark, d):
    return expect.unsorted(X.read(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice").select("o_orderkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, count(*) = 25 AS as_expected FROM nation")
def headline_count(spark, d):
    import warnings

    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        n = expect.headline(X.read(spark, d, "nation"), "cells", 25)
    return spark.createDataFrame([(n, not told)], "n long, as_expected boolean")


@query(f"WITH {X.GRID} SELECT CAST(cell_id AS BIGINT) AS cell_id, glon AS lon, n_name FROM grid JOIN nation ON n_nationkey = cell_id")
def aligned_grids(spark, d):
    """By the key where it is complete and unique on both sides; coordinates are verified."""
    g = X.grid(spark, d).select(F.col("cell_id").cast("long").alias("cell_id"), F.col("glon").alias("lon"), F.col("glat").alias("lat"))
    named = g.join(X.read(spark, d, "nation"), F.col("cell_id") == F.col("n_nationkey")).select("cell_id", (F.col("lon") + 1e-9).alias("lon"), "lat", "n_name")
    return expect.aligned(g, named, "cell_id").select("l.cell_id", "l.lon", "r.n_name")


@query("SELECT problem, n FROM (SELECT 'product' AS problem, CAST(count(*) FILTER (WHERE abs(l_extendedprice / 1e5 * (1 - l_discount) - l_extendedprice * (1 - l_discount) / 1e5 - CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END) > 1e-8) AS BIGINT) AS n FROM lineitem UNION ALL SELECT 'scale', CAST(count(*) FILTER (WHERE l_extendedprice / 1e4 > 5) AS BIGINT) FROM lineitem) WHERE n > 0")
def index_guards(spark, d):
    l = X.read(spark, d, "lineitem").select((F.col("l_extendedprice") / 1e4).alias("scaled"), (F.col("l_extendedprice") / 1e5).alias("a"), (1 - F.col("l_discount")).alias("b"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1e5 + F.when(F.col("l_linenumber") == 2, 1).otherwise(0)).alias("ab"))
    return expect.index_problems(l, ["scaled"], [("a", "b", "ab")], most=5.0)


# small helpers


@query("SELECT c_custkey, arg_min(o_orderkey, o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def first_match_lookup(spark, d):
    """The first order of each customer, null where there is none."""
    first = R.first_by(X.read(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    return X.read(spark, d, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("first_order"))


@query("SELECT n_nationkey AS id, n_name AS label FROM nation")
def alias_tolerant_rename(spark, d):
    n = R.with_alias(X.read(spark, d, "nation"), "id", "location_id", "n_nationkey")
    return R.with_alias(n, "label", "n_name").select("id", "label")


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS source_order FROM orders")
def source_order(spark, d):
    return R.with_row_ids(X.read(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "source_order").select("o_orderkey", "source_order")


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 END AS place FROM customer")
def explicit_order(spark, d):
    from fieldloom.functions.scalar import ranked_by

    return X.read(spark, d, "customer").select("c_custkey", ranked_by(F.col("c_mktsegment"), ["MACHINERY", "BUILDING"]).alias("place"))


@query(f"WITH {X.ANNUAL} SELECT location, {fixed_sql('avg(temp)')} AS mean, {fixed_sql('max(temp)')} AS top, CAST(n AS BIGINT) AS customers FROM annual JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON c_nationkey = location GROUP BY location, n")
def bound_columns(spark, d):
    """Columns of two tables side by side, by key and never by position."""
    a = X.annual(spark, d).groupBy("location").agg(F.avg("temp").alias("mean"), F.max("temp").alias("top"))
    c = X.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("location")).agg(F.count("*").alias("customers"))
    return a.join(c, "location").select("location", fixed(F.col("mean")).alias("mean"), fixed(F.col("top")).alias("top"), "customers")


@query(f"WITH {X.ANNUAL} SELECT year, count(*) AS n, {fixed_sql('avg(temp)')} AS mean, {fixed_sql('median(temp)')} AS median, {fixed_sql('min(temp)')} AS lo, {fixed_sql('max(temp)')} AS hi, {fixed_sql('avg(CASE WHEN temp > 38 THEN 1.0 ELSE 0.0 END)')} AS above, {fixed_sql('avg(CASE WHEN temp < 36 THEN 1.0 ELSE 0.0 END)')} AS below FROM annual GROUP BY year")
def year_summaries(spark, d):
    """Mean, median, least, greatest and shares over all locations, year by year."""
    t = F.col("temp")
    s = X.annual(spark, d).groupBy("year").agg(F.count("*").alias("n"), F.avg(t).alias("mean"), F.median(t).alias("median"), F.min(t).alias("lo"), F.max(t).alias("hi"), R.share(t > 38).alias("above"), R.share(t < 36).alias("below"))
    return s.select("year", "n", *[fixed(F.col(c)).alias(c) for c in ("mean", "median", "lo", "hi", "above", "below")])


@query(f"WITH {X.SERIES}, v AS (SELECT site, day, 0.8 - abs(obs) AS v FROM series) SELECT site, CAST(day AS INT) AS day, {fixed_sql('greatest(least(v, 0.8), 0.0)')} AS explained, v < -1e-10 OR v > 0.8 + 1e-10 AS clipped FROM v")
def clipped_variance(spark, d):
    explained, clipped = statespace.clip_variance(0.8, F.abs(F.col("obs")))
    return X.series(spark, d).select("site", F.col("day").cast("int").alias("day"), fixed(explained).alias("explained"), clipped.alias("clipped"))


@query(f"WITH {X.ANNUAL}, e AS (SELECT location, year, avg(temp) AS m FROM annual GROUP BY ALL), f AS (SELECT location, year, temp AS t FROM annual WHERE member = 1) SELECT year, {fixed_sql('sqrt(avg((t - m) * (t - m)))')} AS rmse, {fixed_sql('max(abs(t - m))')} AS largest, CASE WHEN year < 1995 THEN 'before' ELSE 'after' END AS part FROM e JOIN f USING (location, year) GROUP BY year")
def fit_diagnostics(spark, d):
    """Gaps between a fit (here the members' mean) and a curve, year by year, parted in two spans."""
    a = X.annual(spark, d)
    fit = a.groupBy("location", "year").agg(F.avg("temp").alias("m"))
    gap = F.col("temp") - F.col("m")
    s = a.filter("member = 1").join(fit, ["location", "year"]).groupBy("year").agg(F.sqrt(F.avg(gap * gap)).alias("rmse"), F.max(F.abs(gap)).alias("largest"))
    return s.select("year", fixed(F.col("rmse")).alias("rmse"), fixed(F.col("largest")).alias("largest"), F.when(F.col("year") < 1995, "before").otherwise("after").alias("part"))


@query(f"WITH {X.SERIES}, a AS (SELECT site, day, obs FROM series WHERE site % 2 = 0), b AS (SELECT site + 1 AS site, day, obs FROM series WHERE site % 2 = 1) SELECT a.site, a.day FROM a JOIN b USING (site, day)")
def finite_in_all(spark, d):
    """Sites and days at which two series both have a finite value."""
    s = X.series(spark, d)
    both = s.filter("site % 2 = 0").join(s.filter("site % 2 = 1").select((F.col("site") + 1).alias("site"), "day", F.col("obs").alias("other")), ["site", "day"])
    return both.filter(is_finite(F.col("obs")) & is_finite(F.col("other"))).select("site", "day")


# areas


@query(
    f"""WITH {X.RECORDS}, {X.GRID}, a AS (SELECT glon, glat FROM grid JOIN nation ON n_nationkey = cell_id WHERE n_regionkey = 2),
s AS (SELECT DISTINCT site, lon, lat FROM records)
SELECT DISTINCT site FROM s, a WHERE radians(sqrt(pow(greatest(abs(lon - glon) - 1.5, 0.0) * cos(radians(lat)), 2) + pow(greatest(abs(lat - glat) - 1.0, 0.0), 2))) * {SPHERE!r} <= 150.0"""
)
def sites_near_areas(spark, d):
    """Sites in the named areas of one region, or at most 150 km from one. The areas are boxes around the nations' cells, written as a
    feature collection and read again by name."""
    n = X.read(spark, d, "nation").join(X.grid(spark, d), F.col("n_nationkey") == F.col("cell_id"))
    corner = lambda sx, sy: F.array(F.col("glon") + sx * 1.5, F.col("glat") + sy * 1.0)
    ring = F.array(*[corner(*c) for c in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("n_name").alias("name")).alias("properties"), shape.alias("geometry"))
    path = _folder(spark)
    whole = F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))  # a nation each
    n.agg(F.to_json(whole).alias("value")).write.text(path)
    names = [r["n_name"] for r in X.read(spark, d, "nation").filter("n_regionkey = 2").select("n_name").collect()]
    sites = X.records(spark, d).select("site", "lon", "lat").distinct()
    return areas.within(sites, polygons.edges(polygons.read_areas(spark, path, names)), 150.0).select("site")


_LEVELS = (90.0, 100.0, 110.0)


@query(
    f"""WITH g AS (SELECT CAST(day(ts) AS INT) AS i, CAST(hour(ts) AS INT) AS j, avg(value) AS z FROM events GROUP BY ALL),
q AS (SELECT a.i, a.j, a.z AS za, b.z AS zb, c.z AS zc, d.z AS zd FROM g a JOIN g b ON b.i = a.i + 1 AND b.j = a.j JOIN g c ON c.i = a.i AND c.j = a.j + 1 JOIN g d ON d.i = a.i + 1 AND d.j = a.j + 1),
s AS (SELECT i, j, 1 AS t, i AS ux, j AS uy, za AS uz, i + 1 AS vx, j AS vy, zb AS vz FROM q UNION ALL SELECT i, j, 1, i + 1, j, zb, i + 1, j + 1, zd FROM q UNION ALL SELECT i, j, 1, i, j, za, i + 1, j + 1, zd FROM q
  UNION ALL SELECT i, j, 2, i, j, za, i, j + 1, zc FROM q UNION ALL SELECT i, j, 2, i, j + 1, zc, i + 1, j + 1, zd FROM q UNION ALL SELECT i, j, 2, i, j, za, i + 1, j + 1, zd FROM q),
p AS (SELECT i, j, t, level, ux + (level - uz) / (vz - uz) * (vx - ux) AS x, uy + (level - uz) / (vz - uz) * (vy - uy) AS y FROM s, (SELECT unnest({list(_LEVELS)})::DOUBLE AS level) WHERE (uz > level) <> (vz > level)),
e AS (SELECT level, list(struct_pack(x := x, y := y) ORDER BY x, y) AS e FROM p GROUP BY i, j, t, level)
SELECT level, {', '.join(f"{fixed_sql(f'e[{k}].{c}')} AS {c}{k}" for k in (1, 2) for c in 'xy')} FROM e"""
)
def contour_segments(spark, d):
    """Contours of the mean value over days and hours."""
    e = X.read(spark, d, "events")
    day, hour = F.dayofmonth("ts"), F.hour("ts")
    grid = e.groupBy(day.alias("i"), hour.alias("j")).agg(F.avg("value").alias("z")).withColumns({"x": F.col("i").cast("double"), "y": F.col("j").cast("double")})
    found = contours.contour_segments(grid, list(_LEVELS))
    return found.select("level", *[fixed(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")])
