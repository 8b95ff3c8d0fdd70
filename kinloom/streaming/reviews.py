"""Streams over events; an extension, as records themselves arrive in bounded files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)


def running_latest(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The newest event of each key so far; state is one row a key."""
    newest = F.max(F.struct("ts", "event_id", F.upper("event_type").alias("decision")))
    return events.groupBy(key).agg(newest.alias("n")).select(key, F.col("n.decision").alias("decision"), F.col("n.ts").alias("ts"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type in tumbling windows; state older than the watermark goes."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("value")).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "value")


def stream_static(events: DataFrame, keys: DataFrame) -> DataFrame:
    """A stream of records against the static side's keys."""
    return events.join(F.broadcast(keys), "user_id")


def drain(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there, and return its result table."""
    spark = df.sparkSession
    name = f"drained_{uuid.uuid4().hex}"
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="kinloom-stream-")
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)
