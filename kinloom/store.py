"""Cutting lineage with tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}

#: Bytes of fixed-width columns that may be broadcast, by counted rows.
BROADCAST_BYTES = 1 << 24


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; without it a temporary folder in local mode, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="kinloom-"))
    return found.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Any executor can read the files, so a lost one costs at most the tasks that it was running.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete kept tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        path = df.__dict__.get("kept_at")
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small(df: DataFrame) -> DataFrame:
    """``df`` (fixed-width columns) marked for broadcast if it is counted to be small; else a join goes by shuffle."""
    return F.broadcast(df) if 8 * len(df.columns) * df.count() <= BROADCAST_BYTES else df


def large(df: DataFrame) -> DataFrame:
    """``df`` marked so that a join with it goes by shuffle, unless the other side is marked for broadcast.

    Spark expects sizes by the bytes of compressed files; a table of many like rows can be a hundred times that in the driver that would broadcast it.
    """
    return df.hint("merge")


def few(words: DataFrame) -> DataFrame:
    """``words`` (strings) marked for broadcast if their counted bytes are few, else as ``large``."""
    size = words.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in words.columns), F.lit(32 * len(words.columns))))).first()[0]
    return F.broadcast(words) if (size or 0) <= BROADCAST_BYTES else large(words)
