"""Intermediate tables of the operators, and their removal."""

from __future__ import annotations

import gc

from pyspark.sql import SparkSession

from kvlake.sources.store import Files, saved

__all__ = ["release", "remove", "saved", "small_batches"]

#: Bytes of an Arrow batch, so that a Python worker's memory follows from this and not from the length of texts.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session's Python stages by bytes, unless the session bounds them lower."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete saved tables that no DataFrame reads any more."""
    for path in paths:
        Files(spark).delete(path)


def release(spark: SparkSession) -> None:
    """Let the context cleaner drop shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()
