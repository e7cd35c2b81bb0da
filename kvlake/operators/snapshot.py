"""Reads over an op log: newest visible version per key, ordered scans, point reads, history.

An op log has a key column, ``seq`` (unique), ``op`` (1 set, 2 delete) and a value; names other than the defaults are
given by ``key=``. Keys are compared bytewise. Filters on the key reach the Parquet scan; the visibility filter
``seq <= read_seq`` stands below the aggregate, the tombstone filter above it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from kvlake.schema import DELETE, MAX_KEY_BYTES, SET
from kvlake.sources.store import saved


def in_range(key: Column, lower=None, upper=None) -> Column:
    """lower <= key < upper; None leaves an end open."""
    conds = ([key >= F.lit(lower)] if lower is not None else []) + ([key < F.lit(upper)] if upper is not None else [])
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def visible(log: DataFrame, read_seq: int | None = None) -> DataFrame:
    return log if read_seq is None else log.filter(F.col("seq") <= read_seq)


def latest(log: DataFrame, read_seq: int | None = None, drop_tombstones: bool = True, key: str = "key") -> DataFrame:
    """The newest visible version of every key. A two-phase group limit prunes on the map side, so a hot key shuffles one row a task."""
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.col("seq").desc(), F.col("op").desc()))
    out = visible(log, read_seq).withColumn("__nth", newest).filter("__nth = 1").drop("__nth")
    return out.filter(F.col("op") == SET) if drop_tombstones else out


def scan(log: DataFrame, lower=None, upper=None, read_seq: int | None = None, key: str = "key", limit: int | None = None) -> DataFrame:
    """Live entries of [lower, upper) in key order. With a limit, a top-k instead of a sort."""
    if lower is not None and upper is not None and lower >= upper:
        return log.limit(0)
    out = latest(log.filter(in_range(F.col(key), lower, upper)), read_seq, key=key).orderBy(key)
    return out if limit is None else out.limit(limit)


def get(log: DataFrame, wanted, read_seq: int | None = None, key: str = "key") -> DataFrame:
    """At most one row: the newest version of a key if it is live. An oversized key is not found."""
    if wanted is not None and len(wanted.encode() if isinstance(wanted, str) else wanted) > MAX_KEY_BYTES:
        return log.limit(0)
    rows = visible(log.filter(F.col(key) == F.lit(wanted)), read_seq)
    return rows.orderBy(F.col("seq").desc(), F.col("op").desc()).limit(1).filter(F.col("op") == SET)


def multi_get(log: DataFrame, keys: DataFrame, read_seq: int | None = None, key: str = "key") -> DataFrame:
    """Live entries of a set of keys (an extension): a semi join below the aggregate; the planner picks broadcast or shuffle by size."""
    return latest(log.join(keys.select(key).distinct(), key, "left_semi"), read_seq, key=key)


def history(log: DataFrame, wanted, key: str = "key") -> DataFrame:
    """All versions of one key, newest first."""
    return log.filter(F.col(key) == F.lit(wanted)).orderBy(F.col("seq").desc())


def seek(run: DataFrame, start=None, key: str = "key") -> DataFrame:
    """The first record at or after start in (key, seq desc) order; at most one row."""
    return run.filter(in_range(F.col(key), start)).orderBy(F.col(key), F.col("seq").desc()).limit(1)


def iterate(run: DataFrame, start=None, end=None, key: str = "key") -> DataFrame:
    """Records of one run in order; unlike scan, the end is inclusive."""
    inside = in_range(F.col(key), start) if end is None else in_range(F.col(key), start) & (F.col(key) <= F.lit(end))
    return run.filter(inside).orderBy(F.col(key), F.col("seq").desc(), F.col("op").desc())


def merge(runs: Iterable[DataFrame]) -> DataFrame:
    """All records of several runs in (key, seq desc, op desc) order."""
    runs = list(runs)
    return reduce(DataFrame.unionByName, runs).orderBy("key", F.col("seq").desc(), F.col("op").desc())


def numbered(df: DataFrame, *order: Column, into: str = "ord") -> DataFrame:
    """df with its rank (from 1) in a total order, without a single-partition window.

    Rows are dealt into ranges of the order, sorted, and saved with their place in the range; a prefix sum over the range counts (one row a
    range) gives where each begins. Ranges follow a sample of the rows, so their sizes do not depend on how the order's values are spread.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread, _ = saved(dealt.withColumn("__at", F.monotonically_increasing_id()))  # range in the high bits, place in the low 33
    spread = spread.select("*", F.shiftright("__at", 33).alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__nth")).drop("__at")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = spread.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    return spread.join(F.broadcast(begins), "__part").withColumn(into, F.col("__begin") + F.col("__nth") + 1).drop("__part", "__nth", "__begin")


def first_hit(runs: DataFrame, key: str = "k", run: str = "run") -> DataFrame:
    """The newest run that holds each key, where a newest-first probe stops."""
    return runs.groupBy(key).agg(F.max(run).alias(run))


def verify_reads(log: DataFrame, reads: DataFrame, key: str = "key") -> DataFrame:
    """reads (key, value) with ``ok``: whether the value read is the key's newest one (null for a deleted or unknown key)."""
    now = latest(log, key=key).select(F.col(key), F.col("value").alias("__now"))
    return reads.join(now, key, "left").withColumn("ok", F.col("value").eqNullSafe(F.col("__now"))).drop("__now")


def point(rows: DataFrame) -> tuple[object, bool]:
    """(value, found) of a get()."""
    row: Row | None = rows.first()
    return (row["value"], True) if row else (None, False)


def tombstones(log: DataFrame) -> DataFrame:
    return log.filter(F.col("op") == DELETE)
