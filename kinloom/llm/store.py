"""Cutting lineage with written tables, and what Python workers hold at a time."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from kinloom.store import drop, keep, shared_folder, small

__all__ = ["BATCH_ROWS", "batches", "drop", "keep", "shared_folder", "small", "small_batches"]

#: Rows of an Arrow batch for operators that hand whole texts to Python workers.
BATCH_ROWS = 256


KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Let Python workers of this session hold at most ``rows`` texts at a time; Spark's own default is 10,000.

    Spark reads the setting when a plan runs, so an operator whose plan the caller runs can't put it back.
    """
    now = int(spark.conf.get(KEY, "10000"))
    if not 0 < now <= rows:
        spark.conf.set(KEY, str(rows))


@contextmanager
def batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """The same for what runs within, and then as before."""
    before = spark.conf.get(KEY, "10000")
    small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(KEY, before)
