"""File sources and sinks with explicit schemas, source resolution, and resumable work lists."""

from __future__ import annotations

import csv
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from fieldloom.functions.scalar import month_of_column
from fieldloom.operators.relational import year_columns

# sources


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file with a header; gzip is told by its name. Malformed rows fail."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", "NA").csv(path)


def header_of(spark: SparkSession, path: str) -> list[str]:
    """The names in the first line, as they are."""
    line = spark.read.text(path).first()
    return next(csv.reader([line[0].removeprefix("\ufeff")])) if line else []


def read_wide_months(spark: SparkSession, path: str, member: int, ids: tuple[str, ...] = ("lon", "lat")) -> DataFrame:
    """ids, member, year, month, value from a file with a column T_YYYY_MM per month, all doubles.

    The thousands of columns become one array right at the scan, so that no later plan carries them.
    """
    names = header_of(spark, path)
    months = [c for c in names if re.fullmatch(r"T_[0-9]{4}_[0-9]{2}", c)]
    lost = [c for c in ids if c not in names]
    if lost or not months or len(months) + len(ids) != len(names):
        raise ValueError(f"{path}: missing {lost}, {len(months)} month columns of {len(names)}")
    wide = read_csv(spark, path, StructType([StructField(c, DoubleType()) for c in names]))
    long = wide.select(*ids, F.arrays_zip(F.array(*[F.lit(m) for m in months]).alias("name"), F.array(*[F.col(m) for m in months]).alias("value")).alias("z"))
    long = long.select(*ids, F.explode("z").alias("z"))
    year, month = month_of_column(F.col("z.name"))
    return long.select(*ids, F.lit(member).alias("member"), year.alias("year"), month.alias("month"), F.col("z.value").alias("value"))


def assemble_members(early: DataFrame, late: DataFrame, early_start: int, late_start: int) -> DataFrame:
    """One time axis from two runs counted in months from their own starts (column step from 0): adds year and month."""
    dated = lambda f, y: f.withColumns({"year": F.lit(y) + F.floor(F.col("step") / 12).cast("int"), "month": (F.col("step") % 12 + 1).cast("int")})
    return dated(early, early_start).unionByName(dated(late, late_start))


def read_wide_years(spark: SparkSession, path: str, ids: StructType, value: str = "value") -> DataFrame:
    """ids, year, value from a file with a column per year (x1850, X1850 or 1850)."""
    names = header_of(spark, path)
    years = year_columns(names)
    known = {f.name: f for f in ids.fields}
    wide = read_csv(spark, path, StructType([known.get(c, StructField(c, DoubleType() if c in years else StringType())) for c in names]))
    keep = [c for c in names if c in known]
    return wide.select(*keep, *[F.col(f"`{c}`").alias(str(y)) for c, y in years.items()]).unpivot(keep, [str(y) for y in years.values()], "year", value).withColumn("year", F.col("year").cast("int"))


def read_csv_inferred(spark: SparkSession, path: str, na: str = "NA") -> DataFrame:
    """A CSV whose columns' types follow from all of its values: one more pass over the file than with a schema."""
    return spark.read.option("header", True).option("inferSchema", True).option("nullValue", na).csv(path)


def cells_of_rasters(bands: dict[int, DataFrame], x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """x, y and a column pop_YEAR per band; bands must have the same cells; cells that are null in all bands go."""
    out = None
    for year, band in bands.items():
        b = band.select(x, y, F.col(value).alias(f"pop_{year}"))
        out = b if out is None else out.join(b, [x, y], "full_outer")
    return out.filter(F.coalesce(*[F.col(f"pop_{year}") for year in bands]).isNotNull())


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def resolve_set(spark: SparkSession, candidates: dict[str, list[str]], mode: str = "auto") -> tuple[str, list[str]]:
    """The first candidate set (in order: generated before precomputed) of which every file exists; a named mode takes that set or fails."""
    if mode != "auto" and mode not in candidates:
        raise ValueError(f"unknown mode {mode!r}; known: auto, {', '.join(candidates)}")
    missing: dict[str, list[str]] = {}
    for name, paths in candidates.items():
        if mode in ("auto", name):
            missing[name] = [p for p in paths if not exists(spark, p)]
            if not missing[name]:
                return name, paths
    raise FileNotFoundError("; ".join(f"{n} lacks {', '.join(p)}" for n, p in missing.items()))


def quoted(path: str) -> str:
    """A path as a string literal of SQL text."""
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_glob(path: str) -> str:
    """A path whose signs of patterns stand for themselves, for readers that take globs."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def first_folder_with(spark: SparkSession, folders: list[str], files: list[str]) -> str:
    for f in folders:
        if all(exists(spark, f"{f}/{x}") for x in files):
            return f
    raise FileNotFoundError(f"no folder of {folders} has all of {files}")


# sinks


def write_csv(frame: DataFrame, path: str, gzip: bool = False, bom: bool = False, na: str = "NA") -> None:
    """Parts of a CSV with headers; bom: the first column's name starts with a byte-order mark, as spreadsheets expect."""
    if bom:
        frame = frame.withColumnRenamed(frame.columns[0], "\ufeff" + frame.columns[0])
    writer = frame.write.mode("overwrite").option("header", True).option("nullValue", na).option("encoding", "UTF-8")
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_archive(tables: dict[str, DataFrame], folder: str) -> None:
    """A nested list as one Parquet table per element."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_archive(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def wide_years(frame: DataFrame, ids: list[str], years: list[int], value: str = "value", year: str = "year") -> DataFrame:
    """One row per location, one column xYEAR per year."""
    return frame.groupBy(*ids).pivot(year, years).agg(F.first(value)).toDF(*ids, *[f"x{y}" for y in years])


def delete_outputs(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Deletes named outputs under root, and nothing outside it."""
    done = []
    for n in names:
        if n.startswith("/") or ".." in n.split("/") or not n.strip("/"):
            raise ValueError(f"{n!r} is not inside {root}")
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{n}")
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True):
            done.append(n)
    return done


# resumable work


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


class Checkpoint:
    """Results of work units under a hash of their settings: what was done under the same settings is not done again."""

    def __init__(self, spark: SparkSession, folder: str, settings: dict, key: list[str]) -> None:
        self.spark, self.key, self.path = spark, key, f"{folder.rstrip('/')}/settings={settings_hash(settings)}"

    def done(self) -> DataFrame | None:
        return self.spark.read.option("mergeSchema", False).option("recursiveFileLookup", True).parquet(self.path) if exists(self.spark, self.path) else None

    def left(self, work: DataFrame) -> DataFrame:
        done = self.done()
        return work if done is None else work.join(done.select(*self.key).distinct(), self.key, "left_anti")

    def add(self, results: DataFrame) -> None:
        results.write.mode("append").parquet(self.path)

    def run(self, work: DataFrame, compute) -> DataFrame:
        """compute(frame of work units) gives results with the key; only units without results are computed."""
        left = self.left(work)
        if not left.isEmpty():
            self.add(compute(left))
        return self.done()

    def remove(self) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
