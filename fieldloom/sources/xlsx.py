"""A workbook source: sheets of .xlsx files as rows of text, by ZIP and XML alone.

``spark.dataSource.register(WorkbookSource)``, then ``spark.read.format("fieldloom_xlsx").option("path", ...)``. Options:
sheet (number from 1), header ("true": skip the first row), keep (positions from 1, such as "3,4,10,11"), names. Files are
tasks; a workbook is read by one task, as its shared strings are one table.
"""

from __future__ import annotations

import glob
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def column_number(reference: str) -> int:
    """1 for A, 27 for AA."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def read_rows(file, sheet: int = 1) -> Iterator[dict[int, str | None]]:
    """Cells by column number, row after row."""
    with zipfile.ZipFile(file) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                for _, e in ET.iterparse(f):
                    if e.tag == _MAIN + "si":
                        shared.append("".join(t.text or "" for t in e.iter(_MAIN + "t")))
                        e.clear()
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, e in ET.iterparse(f):
                if e.tag != _MAIN + "row":
                    continue
                cells: dict[int, str | None] = {}
                for k, c in enumerate(e.iter(_MAIN + "c"), 1):
                    v = c.find(_MAIN + "v")
                    text = v.text if v is not None else None
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                    elif c.get("t") == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                    cells[column_number(c.get("r")) if c.get("r") else k] = text
                yield cells
                e.clear()


def write_rows(path: str, rows: list[list], header: list[str]) -> None:
    """A small writer of one sheet: numbers, texts and empty cells."""
    name = lambda k: (chr(64 + (k - 1) // 26) if k > 26 else "") + chr(65 + (k - 1) % 26)

    def cell(n: int, k: int, v) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, str):
            return f'<c r="{name(k)}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>'
        return f'<c r="{name(k)}{n}"><v>{v!r}</v></c>'

    lines = [f'<row r="{n}">{"".join(cell(n, k, v) for k, v in enumerate(row, 1))}</row>' for n, row in enumerate([header, *rows], 1)]
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{"".join(lines)}</sheetData></worksheet>')


def read_triples(spark: SparkSession, path: str, ids: dict[str, int], first: int = 4, groups: int = 12, width: int = 3) -> DataFrame:
    """ids (as whole numbers), month and value of sheets that hold a value and its flags for each month: of each group of ``width``
    columns, the first of which stands at ``first``, the value is kept. Cells that are no number are null."""
    spark.dataSource.register(WorkbookSource)
    months = [str(m + 1) for m in range(groups)]
    keep = [*ids.values(), *[first + width * m for m in range(groups)]]
    wide = spark.read.format("fieldloom_xlsx").option("keep", ",".join(map(str, keep))).option("names", ",".join([*ids, *months])).load(path)
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    wide = wide.select(*[number(c).cast("int").alias(c) for c in ids], *[number(m).alias(m) for m in months])
    return wide.unpivot(list(ids), months, "month", "value").withColumn("month", F.col("month").cast("int"))


class _Reader(DataSourceReader):
    def __init__(self, options: dict, width: int) -> None:
        self.sheet, self.header = int(options.get("sheet", "1")), options.get("header", "true").lower() == "true"
        self.keep = [int(k) for k in options["keep"].split(",")] if options.get("keep") else list(range(1, width))
        path = options["path"].removeprefix("file://")
        self.paths = sorted(glob.glob(os.path.join(path, "*.xlsx"))) if os.path.isdir(path) else sorted(glob.glob(path))
        if not self.paths:
            raise FileNotFoundError(path)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, cells in enumerate(read_rows(partition.value, self.sheet)):
            if n or not self.header:
                yield (n + (not self.header), *[cells.get(k) for k in self.keep])


class WorkbookSource(DataSource):
    """row_number (order in the sheet), then a text column for each kept position."""

    @classmethod
    def name(cls) -> str:
        return "fieldloom_xlsx"

    def schema(self) -> StructType:
        keep = self.options.get("keep", "")
        n = len(keep.split(",")) if keep else int(self.options.get("columns", "1"))
        names = self.options.get("names", ",".join(f"c{i + 1}" for i in range(n))).split(",")
        return StructType([StructField("row_number", LongType()), *[StructField(x.strip(), StringType()) for x in names]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options), len(schema.fields))
