"""Classic NetCDF files (formats 1, 2 and 5 of the public specification): hyperslabs of one variable as long rows.

``spark.read.format("fieldloom_netcdf")`` with options path, variable, slices ("lo:hi" per dimension, joined by commas;
empty: all) and, for temperatures, to_kelvin. Each file, and of each file each step of its first dimension, is a task's range.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Type codes of the format.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


class Classic:
    """Header of a classic file, and reads of its variables."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            magic = f.read(4)
            if magic[:3] != b"CDF" or magic[3] not in (1, 2, 5):
                raise ValueError(f"{path} is not a classic NetCDF file")
            self._f, self._wide, self._far = f, magic[3] == 5, magic[3] in (2, 5)
            self.records = self._count()
            self.dimensions = self._list(lambda: (self._name(), self._count()))
            self.attributes = dict(self._list(self._attribute))
            self.variables = {v["name"]: v for v in self._list(self._variable)}
        moving = [v for v in self.variables.values() if v["dims"] and self.dimensions[v["dims"][0]][1] == 0]
        self.record_size = sum(v["size"] for v in moving)

    def _int(self, n: int = 4) -> int:
        return int.from_bytes(self._f.read(n), "big")

    def _count(self) -> int:
        return self._int(8 if self._wide else 4)

    def _name(self) -> str:
        n = self._count()
        return self._f.read(n + -n % 4)[:n].decode()

    def _list(self, item) -> list:
        self._int()
        return [item() for _ in range(self._count())]

    def _attribute(self):
        name, kind, n = self._name(), self._int(), self._count()
        size = np.dtype(TYPES[kind]).itemsize * n
        data = self._f.read(size + -size % 4)[:size]
        return name, data.decode("utf-8", "replace") if kind == 2 else np.frombuffer(data, TYPES[kind]).tolist()

    def _variable(self):
        v = {"name": self._name(), "dims": [self._count() for _ in range(self._count())]}
        v["attributes"] = dict(self._list(self._attribute))
        v["type"], v["size"] = TYPES[self._int()], self._count()
        v["at"] = self._int(8 if self._far else 4)
        return v

    def shape(self, name: str) -> list[int]:
        return [self.dimensions[d][1] or self.records for d in self.variables[name]["dims"]]

    def step(self, name: str, i: int) -> np.ndarray:
        """The values at place i of the first dimension."""
        v, shape = self.variables[name], self.shape(name)
        dtype = np.dtype(v["type"])
        n = int(np.prod(shape[1:], dtype=np.int64))
        moving = self.dimensions[v["dims"][0]][1] == 0
        with open(self.path, "rb") as f:
            f.seek(v["at"] + i * (self.record_size if moving else n * dtype.itemsize))
            return np.frombuffer(f.read(n * dtype.itemsize), dtype).reshape(shape[1:])


def write_classic(path: str, name: str, data: np.ndarray, dims: list[str], units: str = "K") -> None:
    """A small writer (format 1, doubles), for tests and exports."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    head = b"CDF\x01" + struct.pack(">i", 0) + struct.pack(">ii", 10, len(dims)) + b"".join(text(d) + struct.pack(">i", n) for d, n in zip(dims, data.shape, strict=True)) + struct.pack(">ii", 0, 0)
    attribute = struct.pack(">ii", 12, 1) + text("units") + struct.pack(">ii", 2, len(units)) + pad(units.encode())
    var = struct.pack(">ii", 11, 1) + text(name) + struct.pack(">i", len(dims)) + struct.pack(f">{len(dims)}i", *range(len(dims))) + attribute + struct.pack(">ii", 6, data.nbytes)
    with open(path, "wb") as f:
        f.write(head + var + struct.pack(">i", len(head) + len(var) + 4) + data.astype(">f8").tobytes())


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.variable, self.kelvin = options["variable"], options.get("to_kelvin", "false").lower() == "true"
        self.slices = [tuple(int(x) if x else None for x in s.split(":")) if s else (None, None) for s in options.get("slices", "").split(",")] if options.get("slices") else []
        path = options["path"].removeprefix("file://")
        self.paths = sorted(glob.glob(os.path.join(path, "*.nc"))) if os.path.isdir(path) else sorted(glob.glob(path))

    def _range(self, k: int, n: int) -> range:
        return range(*slice(*self.slices[k]).indices(n)) if k < len(self.slices) else range(n)

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in self.paths:
            steps = self._range(0, Classic(p).shape(self.variable)[0])
            out += [InputPartition((p, list(steps[k : k + 120]))) for k in range(0, len(steps), 120)]
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path, steps = partition.value
        file = Classic(path)
        units = str(file.variables[self.variable]["attributes"].get("units", ""))
        if self.kelvin and units not in ("K", "kelvin", "degC", "C", "celsius"):
            raise ValueError(f"{path}: unknown unit {units!r}")
        add = 273.15 if self.kelvin and units not in ("K", "kelvin") else 0.0
        shape = file.shape(self.variable)
        for i in steps:
            v = file.step(self.variable, i)
            for j in self._range(1, shape[1]):
                for k in self._range(2, shape[2]):
                    yield os.path.basename(path), i, j, k, float(v[j, k]) + add


class NetcdfSource(DataSource):
    """file, i0, i1, i2 and value of a variable with three dimensions."""

    @classmethod
    def name(cls) -> str:
        return "fieldloom_netcdf"

    def schema(self) -> str:
        return "file string, i0 int, i1 int, i2 int, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
