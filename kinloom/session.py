"""The session settings that the plans in this package are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Adaptive execution re-plans joins, splits skewed partitions and merges small ones at run time, so
# no plan in the package fixes a partition count. UTC keeps timestamps equal to the SQL oracle's.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | None = None, app: str = "kinloom", **extra: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster spark-submit's own session is used."""
    cores = cores or os.cpu_count() or 8
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = SETTINGS | {"spark.sql.shuffle.partitions": str(cores), "spark.driver.memory": "12g", "spark.driver.host": "127.0.0.1"} | extra
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
