"""Rasters: strips of TIFF files as cells, by the public TIFF 6.0 and GeoTIFF tags alone.

``spark.dataSource.register(RasterSource)``, then ``spark.read.format("fieldloom_raster").option("path", ...)``. A file's
strips are dealt into tasks of at most ``cells`` cells (default 1,000,000, but a strip is never cut), so that no task holds a
file. Only the header is read where tasks are planned, and again where a task reads its strips.

Read are classic files of one sample a pixel in strips, of integers or floats, plain or with deflate compression and the
horizontal predictor of integers; others raise an error that names the tag. Cells of the no-data value, and NaN, are null.
The path is a file, a folder of .tif files or a pattern of names, which all tasks must be able to open.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Sizes and codes of the format's field types.
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
#: Tags.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_A_STRIP, STRIP_BYTES, PREDICTOR, TILE_WIDTH, FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 317, 322, 339
PIXEL_SCALE, TIE_POINTS, GEO_KEYS, NO_DATA = 33550, 33922, 34735, 42113
#: Geographic keys of the projected and geographic system and of a point's place in its cell, and sample formats.
PROJECTED, GEOGRAPHIC, PLACE = 3072, 2048, 1025
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Geometry:
    """What cells of two rasters must have in common to be the same places."""

    width: int
    height: int
    left: float
    top: float
    dx: float
    dy: float
    crs: int


class Raster:
    """The header of one file, and reads of its strips."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            head = f.read(8)
            if head[:4] not in (b"II*\0", b"MM\0*"):
                raise ValueError(f"{path} is not a classic TIFF file")
            self.order = "<" if head[:2] == b"II" else ">"
            f.seek(struct.unpack(self.order + "I", head[4:])[0])
            n = struct.unpack(self.order + "H", f.read(2))[0]
            entries = [struct.unpack(self.order + "HHI4s", f.read(12)) for _ in range(n)]
            self.tags = {tag: self._values(f, kind, count, raw) for tag, kind, count, raw in entries if kind in FIELDS}
        t = self.tags
        for tag, allowed in ((SAMPLES, (1,)), (COMPRESSION, (1, 8, 32946)), (PREDICTOR, (1, 2))):
            if t.get(tag, (1,))[0] not in allowed:
                raise ValueError(f"{path}: tag {tag} has the value {t[tag][0]}, which is not supported")
        if TILE_WIDTH in t or STRIPS not in t:
            raise ValueError(f"{path}: tiled rasters are not supported (tag {TILE_WIDTH})")
        kind, bits = KINDS.get(t.get(FORMAT, (1,))[0]), t.get(BITS, (1,))[0]
        if kind is None or bits not in (8, 16, 32, 64) or (kind == "f" and bits < 32):
            raise ValueError(f"{path}: samples of {bits} bits (tag {BITS}) and format {t.get(FORMAT)} (tag {FORMAT}) are not supported")
        if t.get(PREDICTOR, (1,))[0] == 2 and kind == "f":
            raise ValueError(f"{path}: tag {PREDICTOR} is not supported for floats")
        self.dtype = np.dtype(f"{self.order}{kind}{bits // 8}")
        self.rows_a_strip = min(t.get(ROWS_A_STRIP, t[HEIGHT])[0], t[HEIGHT][0])
        text = b"".join(t[NO_DATA]).split(b"\0")[0].strip() if NO_DATA in t else b""
        self.no_data = float(text) if text else None
        (dx, dy), tie = t.get(PIXEL_SCALE, (1.0, 1.0))[:2], t.get(TIE_POINTS, (0.0,) * 6)
        keys = t.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
        half = 0.5 if codes.get(PLACE) == 2 else 0.0  # the point is a cell's middle, not its corner
        left, top = tie[3] - (tie[0] + half) * dx, tie[4] + (tie[1] + half) * dy
        self.geometry = Geometry(t[WIDTH][0], t[HEIGHT][0], left, top, dx, dy, codes.get(PROJECTED, codes.get(GEOGRAPHIC, 0)))

    def _values(self, f, kind: int, count: int, raw: bytes) -> tuple:
        code = f"{self.order}{count * len(FIELDS[kind])}{FIELDS[kind][0]}"
        size = struct.calcsize(code)
        if size > 4:
            back = f.tell()
            f.seek(struct.unpack(self.order + "I", raw)[0])
            raw = f.read(size)
            f.seek(back)
        return struct.unpack(code, raw[:size])

    def strips(self) -> int:
        return len(self.tags[STRIPS])

    def strip(self, k: int) -> tuple[int, np.ndarray]:
        """The number of its first row, and its cells as doubles, NaN where there is no value."""
        first = k * self.rows_a_strip
        rows = min(self.rows_a_strip, self.geometry.height - first)
        with open(self.path, "rb") as f:
            f.seek(self.tags[STRIPS][k])
            data = f.read(self.tags[STRIP_BYTES][k])
        if self.tags.get(COMPRESSION, (1,))[0] != 1:
            data = zlib.decompress(data)
        cells = np.frombuffer(data, self.dtype, rows * self.geometry.width).reshape(rows, self.geometry.width)
        if self.tags.get(PREDICTOR, (1,))[0] == 2:
            cells = np.cumsum(cells, axis=1, dtype=self.dtype.newbyteorder("="))
        out = cells.astype(float)
        if self.no_data is not None:
            missing = np.asarray(self.no_data).astype(self.dtype).astype(float) if self.dtype.kind == "f" else self.no_data
            out[out == missing] = np.nan
        return first, out


def write_raster(path: str, cells: np.ndarray, left: float, top: float, dx: float, dy: float, crs: int = 4326, no_data: float | None = -9999.0, rows_a_strip: int = 16, deflate: bool = True) -> None:
    """A small writer (little endian, doubles in strips), for tests and exports."""
    h, w = cells.shape
    full = np.where(np.isnan(cells), np.nan if no_data is None else no_data, cells).astype("<f8")
    strips = [full[k : k + rows_a_strip].tobytes() for k in range(0, h, rows_a_strip)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    at, offsets = 8, []
    for s in strips:
        offsets.append(at)
        at += len(s)
    projected = 0 if crs == 4326 else 1
    keys = (1, 1, 0, 2, 1024, 0, 1, 1 if projected else 2, PROJECTED if projected else GEOGRAPHIC, 0, 1, crs)
    fields = [(WIDTH, "I", (w,)), (HEIGHT, "I", (h,)), (BITS, "H", (64,)), (COMPRESSION, "H", (8 if deflate else 1,)), (STRIPS, "I", offsets), (SAMPLES, "H", (1,)), (ROWS_A_STRIP, "I", (rows_a_strip,)),
              (STRIP_BYTES, "I", [len(s) for s in strips]), (FORMAT, "H", (3,)), (PIXEL_SCALE, "d", (dx, dy, 0.0)), (TIE_POINTS, "d", (0.0, 0.0, 0.0, left, top, 0.0)), (GEO_KEYS, "H", keys)]
    if no_data is not None:
        fields.append((NO_DATA, "s", (repr(no_data).encode() + b"\0",)))
    kinds, entries, rest = {c: k for k, c in FIELDS.items()}, b"", b""
    base = at + 2 + 12 * len(fields) + 4
    for tag, code, values in sorted(fields):
        raw = values[0] if code == "s" else struct.pack(f"<{len(values)}{code}", *values)
        count = len(raw) if code == "s" else len(values)
        if len(raw) > 4:
            here, rest = base + len(rest), rest + raw
            raw = struct.pack("<I", here)
        entries += struct.pack("<HHI", tag, kinds[code], count) + raw.ljust(4, b"\0")
    with open(path, "wb") as f:
        f.write(b"II*\0" + struct.pack("<I", at) + b"".join(strips) + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + rest)


def write_rasters(cells: DataFrame, folder: str, shape: tuple[int, int], left: float, top: float, dx: float, dy: float, crs: int = 4326) -> dict[int, str]:
    """A file for each band of cells (band, row, col, value), written by tasks, and their paths; a task holds one raster of the shape
    (rows, columns). A file takes its name only when it is whole, so that a task may run twice."""
    folder = folder.removeprefix("file:")

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full(shape, np.nan)
        out[rows["row"].to_numpy(int), rows["col"].to_numpy(int)] = rows["value"].to_numpy(float)
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, f"{key[0]}.tif")
        part = f"{path}.{uuid.uuid4().hex}"
        write_raster(part, out, left, top, dx, dy, crs)
        os.replace(part, path)
        return pd.DataFrame({"band": [key[0]], "path": [path]})

    written = cells.select(F.col("band").cast("int").alias("band"), "row", "col", "value").groupBy("band").applyInPandas(one, "band int, path string")
    return {r["band"]: r["path"] for r in written.orderBy("band").collect()}  # a row a band


def _paths(path: str) -> list[str]:
    path = path.removeprefix("file:")
    path = "/" + path.lstrip("/") if path.startswith("//") else path
    found = sorted(glob.glob(os.path.join(path, "*.tif"))) if os.path.isdir(path) else [path] if os.path.exists(path) else sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.cells = _paths(options["path"]), int(options.get("cells", "1000000"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            r = Raster(p)
            each = max(1, self.cells // max(1, r.rows_a_strip * r.geometry.width))
            out += [InputPartition((p, k, min(k + each, r.strips()))) for k in range(0, r.strips(), each)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start, end = partition.value
        r = Raster(path)
        g, name = r.geometry, os.path.basename(path)
        for k in range(start, end):
            first, cells = r.strip(k)
            row, column = np.divmod(np.arange(cells.size, dtype=np.int64), g.width)
            row += first
            columns = [pa.array([name] * cells.size), pa.array(row), pa.array(column), pa.array(g.left + (column + 0.5) * g.dx), pa.array(g.top - (row + 0.5) * g.dy), pa.array(cells.ravel(), from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "row", "col", "x", "y", "value"])


class RasterSource(DataSource):
    """file, row, col, x, y (of a cell's middle) and value of every cell."""

    @classmethod
    def name(cls) -> str:
        return "fieldloom_raster"

    def schema(self) -> str:
        return "file string, row long, col long, x double, y double, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_stack(spark: SparkSession, paths: dict[int, str], prefix: str = "pop_") -> DataFrame:
    """x, y and a column a year of rasters of one geometry; cells that are null in all of them go.

    Rasters of another size, place, cell size or reference system than the first are an error, as is a raster without a system.
    """
    headers = {year: Raster(_paths(p)[0]).geometry for year, p in paths.items()}
    first = next(iter(headers.values()))
    if not first.crs:
        raise ValueError(f"{next(iter(paths.values()))} has no reference system")
    other = [paths[y] for y, g in headers.items() if g != first]
    if other:
        raise ValueError(f"not of the first raster's geometry: {', '.join(other)}")
    spark.dataSource.register(RasterSource)
    bands = [spark.read.format("fieldloom_raster").option("path", p).load().select("row", "col", "x", "y", F.lit(year).alias("year"), "value") for year, p in paths.items()]
    every = bands[0]
    for b in bands[1:]:
        every = every.unionByName(b)
    cells = every.filter("value is not null").groupBy("row", "col").agg(
        F.first("x").alias("x"), F.first("y").alias("y"), *[F.max(F.when(F.col("year") == year, F.col("value"))).alias(f"{prefix}{year}") for year in paths]
    )
    return cells.drop("row", "col")
