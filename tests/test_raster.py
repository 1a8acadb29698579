import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions.projection import MERCATOR, Albers, from_lonlat, to_lonlat
from fieldloom.operators import relational as R
from fieldloom.sources import raster


def field(seed: int, shape=(37, 11)) -> np.ndarray:
    a = np.random.default_rng(seed).normal(size=shape)
    a[a > 1] = np.nan
    return a


def load(spark, path, **options):
    spark.dataSource.register(raster.RasterSource)
    return spark.read.format("fieldloom_raster").options(path=str(path), **options).load()


@pytest.mark.parametrize("deflate,strip,cells", [(True, 16, "1000000"), (False, 5, "60"), (True, 37, "1")])
def test_cells_come_back_in_strips(spark, tmp_path, deflate, strip, cells):
    a = field(1)
    raster.write_raster(str(tmp_path / "a.tif"), a, 100.0, 50.0, 0.5, 0.25, rows_a_strip=strip, deflate=deflate)
    frame = load(spark, tmp_path, cells=cells)
    if cells == "60":
        assert frame.rdd.getNumPartitions() == math.ceil(37 / 5)
    rows = frame.collect()
    assert len(rows) == a.size and {r["file"] for r in rows} == {"a.tif"}
    for r in rows:
        v = a[r["row"], r["col"]]
        assert r["value"] is None if np.isnan(v) else r["value"] == v
        assert (r["x"], r["y"]) == (100.0 + (r["col"] + 0.5) * 0.5, 50.0 - (r["row"] + 0.5) * 0.25)


def test_big_endian_integers_with_predictor(tmp_path):
    import zlib

    a = np.array([[3, 65530, 2], [0, 7, 7]], ">u2")
    body = zlib.compress(np.diff(a, axis=1, prepend=np.zeros((2, 1), ">u2")).astype(">u2").tobytes())
    tags = [(256, 3, 1, 3), (257, 3, 1, 2), (258, 3, 1, 16), (259, 3, 1, 8), (273, 4, 1, 8), (279, 4, 1, len(body)), (317, 3, 1, 2)]
    entries = b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in tags)
    (tmp_path / "a.tif").write_bytes(b"MM\0*" + struct.pack(">I", 8 + len(body)) + body + struct.pack(">H", len(tags)) + entries + bytes(4))
    first, cells = raster.Raster(str(tmp_path / "a.tif")).strip(0)
    assert first == 0 and cells.tolist() == a.tolist()


def test_stack_checks_geometry_and_drops_empty_cells(spark, tmp_path):
    a, b = field(1), field(2)
    a[:20], b[10:] = np.nan, np.nan
    for name, values, left, crs in (("a", a, 1.0, 4326), ("b", b, 1.0, 4326), ("moved", b, 1.5, 4326), ("other", b, 1.0, 3857), ("none", a, 1.0, 0)):
        raster.write_raster(str(tmp_path / f"{name}.tif"), values, left, 40.0, 1.0, 1.0, crs)
    path = {n: str(tmp_path / f"{n}.tif") for n in ("a", "b", "moved", "other", "none")}
    rows = raster.read_stack(spark, {1776: path["a"], 1820: path["b"]}).collect()
    assert len(rows) == int((~np.isnan(a) | ~np.isnan(b)).sum())
    assert {(r["x"], r["y"]): (r["pop_1776"], r["pop_1820"]) for r in rows}[(1.5 + int(np.argwhere(~np.isnan(b))[0][1]), 39.5 - int(np.argwhere(~np.isnan(b))[0][0]))][1] == b[~np.isnan(b)][0]
    for wrong in ("moved", "other"):
        with pytest.raises(ValueError, match=wrong):
            raster.read_stack(spark, {1776: path["a"], 1820: path[wrong]})
    with pytest.raises(ValueError, match="reference system"):
        raster.read_stack(spark, {1776: path["none"]})
    (tmp_path / "text.tif").write_text("no raster at all")
    with pytest.raises(ValueError, match="not a classic TIFF"):
        raster.Raster(str(tmp_path / "text.tif"))
    with pytest.raises(FileNotFoundError):
        raster.read_stack(spark, {1776: str(tmp_path / "missing.tif")})


def test_projections_come_back(spark):
    points = spark.createDataFrame([(float(a), float(b)) for a in (75, 98.5, 105, 134) for b in (-10, 4, 25, 36.5, 60)], "lon double, lat double")
    for system in (MERCATOR, Albers(25, 47, 105), Albers(29.5, 45.5, -96, 23, radius=6378206.4, flattening=1 / 294.978698)):
        x, y = from_lonlat(F.col("lon"), F.col("lat"), system)
        lon, lat = to_lonlat(F.col("x"), F.col("y"), system)
        for r in points.withColumns({"x": x, "y": y}).withColumns({"a": lon, "b": lat}).collect():
            assert (r["a"], r["b"]) == pytest.approx((r["lon"], r["lat"]), abs=1e-9)
    # the manual's worked example on the Clarke 1866 ellipsoid
    x, y = from_lonlat(F.lit(-75.0), F.lit(35.0), Albers(29.5, 45.5, -96, 23, radius=6378206.4, flattening=1 / 294.978698))
    assert tuple(spark.range(1).select(x, y).first()) == pytest.approx((1885472.7, 1535925.0), abs=0.1)
    with pytest.raises(ValueError, match="not known"):
        to_lonlat(F.lit(0.0), F.lit(0.0), 9999)


def test_zonal_means_and_nearest_year(spark):
    grid = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "cell_id long, glon double, glat double")
    cells = spark.createDataFrame([(1.0, 1.0, 2.0, None), (-1.0, 0.0, 4.0, None), (9.0, 0.0, None, 5.0), (None, 0.0, 100.0, 100.0)], "lon double, lat double, a double, b double")
    means = R.zonal_means(cells, grid, ["a", "b"])
    assert sorted(means.collect()) == [(1, 3.0, None), (2, None, 5.0)]
    panel = means.crossJoin(spark.createDataFrame([(1776,), (1798,), (1799,)], "year int"))
    found = R.nearest_year_value(panel, "year", {1776: "a", 1820: "b"})
    assert {(r["cell_id"], r["year"]): (r["reference"], r["value"]) for r in found.collect()} == {
        (1, 1776): (1776, 3.0), (1, 1798): (1776, 3.0), (1, 1799): (1820, None), (2, 1776): (1776, None), (2, 1798): (1776, None), (2, 1799): (1820, 5.0)}
