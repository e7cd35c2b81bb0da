"""Building, checking and appending op logs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlake.functions.scalar import checksum
from kvlake.operators.snapshot import numbered
from kvlake.schema import DELETE, MAX_KEY_BYTES, MAX_VALUE_BYTES, OPLOG, SET, EmptyKey, KeyTooLarge, ValueTooLarge


def check(key: bytes, value: bytes | None) -> None:
    """Size limits of one write; empty keys are rejected, empty values are not."""
    if not key:
        raise EmptyKey("empty key")
    if len(key) > MAX_KEY_BYTES:
        raise KeyTooLarge(f"key of {len(key)} bytes; the limit is {MAX_KEY_BYTES}")
    if value is not None and len(value) > MAX_VALUE_BYTES:
        raise ValueTooLarge(f"value of {len(value)} bytes; the limit is {MAX_VALUE_BYTES}")


def rejected(writes: DataFrame) -> DataFrame:
    """Rows of a bulk write that the limits reject, with the reason."""
    reason = (
        F.when(F.col("key").isNull() | (F.octet_length("key") == 0), "empty key")
        .when(F.octet_length("key") > MAX_KEY_BYTES, "key too large")
        .when(F.octet_length("value") > MAX_VALUE_BYTES, "value too large")
    )
    return writes.withColumn("reason", reason).filter("reason is not null")


def rows(spark: SparkSession, writes: Iterable[tuple[bytes, int, bytes | None]], first_seq: int) -> DataFrame:
    """Op-log rows of a batch of (key, op, value), numbered in order from first_seq."""
    data = []
    for i, (key, op, value) in enumerate(writes):
        check(key, value)
        data.append((key, first_seq + i, op, value if op == SET else None))
    return spark.createDataFrame(data, OPLOG)


def assign_seq(writes: DataFrame, arrival: str, committed: int) -> DataFrame:
    """Commit-order sequences after ``committed``, by arrival. Ranges of arrivals are numbered by themselves, so no task holds them all."""
    return numbered(writes, F.col(arrival), into="seq").withColumn("seq", F.col("seq").cast("long") + committed)


def record_crc() -> Column:
    """Checksum of a record's sequence, op, key and value."""
    head = F.concat_ws(":", "seq", "op", F.octet_length("key"), F.coalesce(F.octet_length("value"), F.lit(-1)))
    return checksum(F.concat(head.cast("binary"), F.col("key"), F.coalesce("value", F.lit(b""))))


def stamped(log: DataFrame) -> DataFrame:
    """An op log with the checksum of each record."""
    return log.select("key", "seq", "op", "value").withColumn("crc", record_crc())


def checked(log: DataFrame) -> DataFrame:
    """A stamped op log with ``valid``: whether each record has its checksum."""
    return log.withColumn("valid", F.col("crc").eqNullSafe(record_crc()))


def rolled(sizes: list[int], most: int) -> list[list[int]]:
    """Numbers of consecutive batches that fill one unit of at most ``most`` bytes each (one batch at least); the last unit is still open."""
    out, size = [[]], 0
    for i, n in enumerate(sizes):
        if out[-1] and size + n > most:
            out.append([])
            size = 0
        out[-1].append(i)
        size += n
    return out


def batches(log: DataFrame, size: int) -> DataFrame:
    """Group commit with a full queue: every ``size`` writes in sequence order are one batch."""
    return log.withColumn("batch", F.expr(f"(seq - 1) div {size}"))


def encode_batches(log: DataFrame) -> DataFrame:
    """One row per batch with its rows in sequence order."""
    row = F.struct("seq", "key", "op", "value")
    return log.groupBy("batch").agg(F.array_sort(F.collect_list(row)).alias("rows"))


def decode_batches(encoded: DataFrame) -> DataFrame:
    return encoded.select("batch", F.explode("rows").alias("r")).select("batch", "r.key", "r.seq", "r.op", "r.value")


def from_events(events: DataFrame, run_rows: int = 1000) -> DataFrame:
    """The op log of the events table: k, seq, op, v and run. Errors are deletes."""
    gone = F.col("event_type") == "error"
    return events.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("k"),
        (F.col("event_id") + 1).alias("seq"),
        F.when(gone, DELETE).otherwise(SET).alias("op"),
        F.when(~gone, F.concat("event_type", F.lit("|"), "props")).alias("v"),
        F.expr(f"event_id div {run_rows}").alias("run"),
    )


def from_orders(orders: DataFrame) -> DataFrame:
    """Orders as a log: the newest order of each customer; status F is a tombstone."""
    gone = F.col("o_orderstatus") == "F"
    return orders.select(
        F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.when(gone, DELETE).otherwise(SET).alias("op"), F.when(~gone, F.col("o_orderstatus")).alias("v")
    )
