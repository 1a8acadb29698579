"""Queries that run a stream over the events table to its end and give its result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.scalar import fixed, fixed_sql
from fieldloom.session import ensure_checkpoint_dir
from fieldloom.streaming import events as S

QUERIES: dict = {}
ORACLES: dict = {}


def _stream(spark, d) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _finished(frame: DataFrame, mode: str) -> DataFrame:
    """What the stream gives by its end: rows that are added go to files in the shared folder, a table of sums (complete) to memory."""
    if mode == "append":
        path = f"{ensure_checkpoint_dir(frame.sparkSession).rstrip('/')}/fieldloom-stream-{uuid.uuid4().hex}"
        frame.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
        return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/rows")
    name = f"stream_{uuid.uuid4().hex}"
    q = frame.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)


def stream_windowed(spark, d):
    w = S.windowed(_stream(spark, d), "ts", "value", ["event_type"], "1 day", late="40 days")
    out = _finished(w, "complete")
    return out.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n", fixed(F.col("mean")).alias("mean_value"))


QUERIES["stream_windowed"] = stream_windowed
ORACLES["stream_windowed"] = f"SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, {fixed_sql('avg(value)')} AS mean_value FROM events GROUP BY 1, 2"


def stream_first_seen(spark, d):
    return _finished(S.first_seen(_stream(spark, d), "ts", ["user_id"], "40 days").select("user_id"), "append")


QUERIES["stream_first_seen"] = stream_first_seen
ORACLES["stream_first_seen"] = "SELECT DISTINCT user_id FROM events"


def stream_causal_filter(spark, d):
    obs = _stream(spark, d).select("user_id", F.dayofyear("ts").alias("t"), (F.col("value") / 100).alias("obs"))
    return _finished(S.causal_filter(obs, "user_id", 1.0, 0.6, 0.3, 0.0, 1.0, 0.2), "append")


QUERIES["stream_causal_filter"] = stream_causal_filter
