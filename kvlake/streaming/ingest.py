"""Structured Streaming: micro-batch commits into an engine, and a live latest-version view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kvlake.plans.engine import Engine
from kvlake.schema import DELETE, SET
from kvlake.sources import oplog
from kvlake.sources.store import Files, saved


def ingest(stream: DataFrame, engine: Engine, checkpoint: str, arrival: str = "arrival", flush_rows: int = 0, name: str = "stream", trigger: dict | None = None) -> StreamingQuery:
    """Commit every micro-batch of (key, op, value, arrival) as one batch, visible whole; flush and compact once ``flush_rows`` are pending.

    The batch number is committed with the batch under the stream's ``name``, so a micro-batch that is replayed after a failure is
    committed once. Rows that the size limits reject are left out. ``trigger``: arguments of DataStreamWriter.trigger, else all that is available.
    """

    def commit(rows: DataFrame, batch: int) -> None:
        if batch <= engine.last_of(name):
            return
        good = rows.filter(F.col("key").isNotNull() & (F.octet_length("key").between(1, oplog.MAX_KEY_BYTES)) & (F.coalesce(F.octet_length("value"), F.lit(0)) <= oplog.MAX_VALUE_BYTES))
        good, path = saved(oplog.assign_seq(good.withColumn("value", F.when(F.col("op") == SET, F.col("value"))), arrival, engine.committed).select("key", "seq", "op", "value"))
        if count := good.count():
            engine.append(good, count, {"name": name, "batch": batch})
        Files(rows.sparkSession).delete(path)
        if flush_rows and engine.committed - engine.catalog.version.last_seq >= flush_rows:
            engine.flush()
            engine.compact()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_view(stream: DataFrame) -> DataFrame:
    """Newest version per key of a stream of (key, seq, op, value), for update or complete mode. State holds one row a key for good: keys never expire."""
    newest = F.max_by(F.struct("seq", "op", "value"), "seq")
    return stream.groupBy("key").agg(newest.alias("r")).select("key", "r.seq", "r.op", "r.value")


def window_report(stream: DataFrame, at: str = "ts", length: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Counts by outcome in tumbling windows of a stream; windows close ``late`` after their end."""
    return stream.withWatermark(at, late).groupBy(F.window(at, length), "outcome").count()


def deletes(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.lit(DELETE).alias("op"), F.lit(None).cast("binary").alias("value"), "arrival")
