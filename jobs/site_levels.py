"""Keeps each site's ordinal level of each day up to date while documentary records arrive.

    python -m jobs.site_levels --source FOLDER --target FOLDER [--config FILE]

Source: Parquet files of records, to which files are added. A file stream with a checkpoint takes only files that no earlier
run has taken, in batches; records may come late and out of order. Under the target:

* ``records/day=.../batch=...``: the records taken, with their level; a batch that is taken again after a failure replaces itself;
* ``levels/day=...``: site, level, n_records, n_levels. The level is the most frequent one of the site's records of that day, ties go
  to the record that stands first; only days that a batch touches are computed again, from all their records;
* ``state``: the stream's checkpoint. It lies with what it describes, so that both are kept or lost together.

Records without a site, a time or a known category are counted, logged and left out.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import expect, relational

LOG = logging.getLogger("jobs.site_levels")
CONFIG = Path(__file__).with_suffix(".json")
RECORDS = "site long, source_order long, level int, day string, batch long"
LEVELS = "site long, level int, n_records long, n_levels long, day string"


@dataclass
class Done:
    """What a run took and wrote."""

    batches: int = 0
    read: int = 0
    kept: int = 0
    days: int = 0
    wrote: int = 0


def settings(path: str | Path = CONFIG) -> dict:
    return json.loads(Path(path).read_text())


def coded(rows: DataFrame, config: dict) -> DataFrame:
    """site, source_order, level and day of records; the level is null for categories that the config doesn't name."""
    level = F.lit(None).cast("int")
    for name, value in config["levels"].items():
        level = F.when(F.col(config["category"]) == name, F.lit(value)).otherwise(level)
    return rows.select(
        F.col(config["site"]).cast("long").alias("site"),
        F.col(config["order"]).cast("long").alias("source_order"),
        level.alias("level"),
        F.date_format(config["time"], "yyyy-MM-dd").alias("day"),
    )


def levels(records: DataFrame) -> DataFrame:
    """The level of each site and day."""
    mode = relational.mode_first(records, ["site", "day"], "level", "source_order")
    different = records.groupBy("site", "day").agg(F.count_distinct("level").alias("n_levels"))
    return mode.join(different, ["site", "day"]).select("site", "level", "n_records", "n_levels", "day")


def _write(frame: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that the frame has rows for, and no others."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(batch: DataFrame, number: int, target: str, config: dict, done: Done) -> None:
    """Stores a batch's records, then computes the days that it touches."""
    spark, seen, wrote = batch.sparkSession, Observation(), Observation()
    good = F.col("site").isNotNull() & F.col("day").isNotNull() & F.col("level").isNotNull()
    rows = coded(batch, config).observe(seen, F.count("*").alias("read"), F.count(F.when(good, 1)).alias("kept"))
    _write(rows.filter(good).withColumn("batch", F.lit(number).cast("long")), f"{target}/records", "day", "batch")
    if seen.get["kept"]:
        records = spark.read.schema(RECORDS).parquet(f"{target}/records")
        touched = records.filter(F.col("batch") == number).select("day").distinct()
        fresh = levels(records.join(touched, "day", "left_semi")).observe(wrote, F.count("*").alias("rows"))
        _write(fresh.repartition("day"), f"{target}/levels", "day")
        done.wrote += wrote.get["rows"]
        done.days += touched.count()
    done.batches += 1
    done.read += seen.get["read"]
    done.kept += seen.get["kept"]
    LOG.info("batch %d: read %d records, left out %d", number, seen.get["read"], seen.get["read"] - seen.get["kept"])


def run(spark: SparkSession, source: str, target: str, config: dict) -> Done:
    """Takes what is new in ``source`` and ends."""
    done = Done()
    schema = expect.require_columns(spark.read.parquet(source), [config[k] for k in ("site", "order", "time", "category")]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(source)
    writer = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, target, config, done))
    query = writer.option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    LOG.info("%s: read %d new records in %d batches, wrote %d levels of %d days to %s", source, done.read, done.batches, done.wrote, done.days, target)
    return done


def result(spark: SparkSession, target: str) -> DataFrame:
    """All levels as they stand."""
    return spark.read.schema(LEVELS).parquet(f"{target}/levels")


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    parser.add_argument("--source", required=True)
    parser.add_argument("--target", required=True)
    parser.add_argument("--config", default=str(CONFIG))
    told = parser.parse_args(arguments)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("site_levels").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, told.source, told.target, settings(told.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
