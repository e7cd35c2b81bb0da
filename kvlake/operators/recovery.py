"""Log recovery: replay after a point, torn tails, damaged records, retention.

A log has ``lsn``, ``valid`` and whatever a record holds. The first damaged record decides: if no valid record follows it, it is
a torn tail and is cut; else the policy stops with its lsn or truncates the log there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.schema import Corrupt


def after(log: DataFrame, checkpoint_seq: int) -> DataFrame:
    """Rows not yet in tables; a batch may straddle the checkpoint, so rows are skipped, not batches."""
    return log.filter(F.col("seq") > checkpoint_seq)


def diagnose(log: DataFrame) -> DataFrame:
    """One row: first damaged lsn, last valid lsn, and whether the damage is ``none``, a ``torn`` tail or ``mid`` log."""
    bad, good = F.min(F.when(~F.col("valid"), F.col("lsn"))), F.max(F.when(F.col("valid"), F.col("lsn")))
    return log.agg(bad.alias("first_bad"), good.alias("last_good")).withColumn(
        "damage", F.when(F.col("first_bad").isNull(), "none").when(F.col("last_good").isNull() | (F.col("last_good") < F.col("first_bad")), "torn").otherwise("mid")
    )


def cut(log: DataFrame) -> DataFrame:
    """The valid prefix of the log."""
    first_bad = log.agg(F.min(F.when(~F.col("valid"), F.col("lsn"))).alias("first_bad"))
    return log.crossJoin(F.broadcast(first_bad)).filter("first_bad is null or lsn < first_bad").drop("first_bad")


def recover(log: DataFrame, after_lsn: int = -1, policy: str = "stop") -> DataFrame:
    """Valid records after an lsn, in order. The record at ``after_lsn`` itself must be sound under either policy."""
    if after_lsn >= 0 and not log.filter((F.col("lsn") == after_lsn) & ~F.col("valid")).isEmpty():
        raise Corrupt(f"the checkpoint's record at lsn {after_lsn} is damaged", after_lsn)
    found = diagnose(log).first()
    if found["damage"] == "mid" and policy == "stop":
        raise Corrupt(f"damaged record at lsn {found['first_bad']}", found["first_bad"])
    kept = log if found["first_bad"] is None else log.filter(F.col("lsn") < found["first_bad"])
    return kept.filter(F.col("lsn") > after_lsn).orderBy("lsn")


def reassemble(parts: DataFrame) -> DataFrame:
    """Entries that were split over segments: parts (entry_lsn, part, last, data) to (entry_lsn, data); entries without their last part are left out."""
    whole = parts.groupBy("entry_lsn").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("p"), F.max("last").alias("ended"), F.max("part").alias("top"))
    data = F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["data"]))
    return whole.filter("ended and size(p) = top + 1").select("entry_lsn", data.alias("data"))


def expired(files: DataFrame, checkpoint_lsn: int) -> DataFrame:
    """Log files whose every record is before the checkpoint."""
    return files.filter(F.col("max_lsn") < checkpoint_lsn)


def record_at(log: DataFrame, lsn: int) -> DataFrame:
    return log.filter(F.col("lsn") == lsn)


def any_from(log: DataFrame, lsn: int) -> DataFrame:
    """One row: whether a sound record begins at or after an lsn."""
    return log.agg(F.coalesce(F.max((F.col("lsn") >= lsn) & F.col("valid")), F.lit(False)).alias("found"))
