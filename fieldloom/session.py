"""Session defaults."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str | None = None, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("fieldloom")
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": "8g"} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the cluster's ``spark.checkpoint.dir``, or one of our own where that is unset and all runs in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    alone = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
    if not named and not alone and spark.sparkContext.getCheckpointDir() is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="fieldloom-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def stored(frame: DataFrame) -> DataFrame:
    """The frame written as Parquet under the shared checkpoint folder and read back: lost executors cost no more than a read."""
    spark = frame.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fieldloom-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back._fieldloom_path = path
    return back


def discard(frame: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing will read it again."""
    spark = frame.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(frame._fieldloom_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dealt(frame: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """The frame dealt by keys into a stated number of partitions (by default twice the shuffle partitions): for groups of few bytes and
    much work, which adaptive execution must not merge into few tasks. A number that differs from the shuffle partitions keeps
    Catalyst from taking an aggregate's own exchange by the same keys instead, which may be merged."""
    return frame.repartition(parts or 2 * int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
