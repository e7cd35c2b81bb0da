"""Levelled compaction: planning over table metadata, and execution over records.

Planning reads one row per table, on the driver for the engine (``Table`` tuples) or as a DataFrame (overlap joins). Execution
is the newest-version aggregate, the tombstone rule, and a range-partitioned sorted write.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvlake.operators.snapshot import latest
from kvlake.operators.zonemap import interval_join, octets
from kvlake.schema import LEVELS, SET, Options


class Table(NamedTuple):
    id: int
    level: int
    min_key: bytes
    max_key: bytes
    size: int
    keys: int = 0


class Plan(NamedTuple):
    level: int
    target: int
    inputs: tuple[Table, ...]


def overlaps(a: Table, low: bytes, high: bytes) -> bool:
    return a.min_key <= high and a.max_key >= low


def overlapping(tables: list[Table], low: bytes, high: bytes) -> list[Table]:
    return [t for t in tables if overlaps(t, low, high)]


def level_targets(bottom_bytes: int, o: Options) -> list[int]:
    """Target bytes of every level: none for the first and last; between them a geometric series, raised so that a large bottom level keeps its fanout."""
    out = [0] * LEVELS
    for level in range(1, LEVELS - 1):
        out[level] = max(o.l1_target_bytes * o.fanout ** (level - 1), bottom_bytes // o.fanout ** (LEVELS - 1 - level))
    return out


def ratio(table: Table, below: list[Table]) -> float:
    return sum(t.size for t in overlapping(below, table.min_key, table.max_key)) / max(1, table.size)


def pick(tables: list[Table], o: Options) -> Plan | None:
    """The next compaction: level 0 by table count, else the first level over its target, by least overlap."""
    by = {n: [t for t in tables if t.level == n] for n in range(LEVELS)}
    if len(by[0]) >= o.l0_trigger:
        chosen = by[0][: o.l0_trigger]
        level = 0
    else:
        goal = level_targets(sum(t.size for t in by[LEVELS - 1]), o)
        over = [n for n in range(1, LEVELS - 1) if sum(t.size for t in by[n]) > goal[n]]
        if not over:
            return None
        level = over[0]
        chosen = [min(by[level], key=lambda t: ratio(t, by[level + 1]))]
    low, high = min(t.min_key for t in chosen), max(t.max_key for t in chosen)
    return Plan(level, level + 1, (*chosen, *overlapping(by[level + 1], low, high)))


def movable(plan: Plan) -> bool:
    """Inputs all from the source level, disjoint, and not bound for the bottom level: only their level changes."""
    if plan.target == LEVELS - 1 or any(t.level != plan.level for t in plan.inputs):
        return False
    order = sorted(plan.inputs, key=lambda t: (t.min_key, t.id))
    return all(a.max_key < b.min_key for a, b in zip(order, order[1:], strict=False))


def can_drop_tombstones(plan: Plan, tables: list[Table]) -> bool:
    """No table outside the plan, at the source level (1 at least) or deeper, overlaps its range."""
    low, high = min(t.min_key for t in plan.inputs), max(t.max_key for t in plan.inputs)
    ids = {t.id for t in plan.inputs}
    return not any(t.id not in ids and t.level >= max(plan.level, 1) and overlaps(t, low, high) for t in tables)


def flushable(full: list, retain: int) -> list:
    """The units of flushing that are due, oldest first: all full ones but the newest ``retain``."""
    return full[: max(0, len(full) - retain)]


def estimate_keys(tables: list[Table], target_bytes: int) -> int:
    """Keys of one output table, for sizing its filter."""
    keys, size = sum(t.keys for t in tables), sum(t.size for t in tables)
    return keys if not size else min(keys, target_bytes * keys // size)


def estimated(tables: DataFrame, target_bytes: int, *by: str) -> DataFrame:
    """estimate_keys for groups of a table of metadata."""
    return tables.groupBy(*by).agg(F.expr(f"if(sum(bytes) = 0, sum(keys), least(sum(keys), {target_bytes} * sum(keys) div sum(bytes)))").alias("keys"))


def compact(records: DataFrame, drop_tombstones: bool, key: str = "key") -> DataFrame:
    """Newest version of each key of all inputs; tombstones go only if the caller may drop them."""
    return latest(records, drop_tombstones=drop_tombstones, key=key)


def compact_over(records: DataFrame, deeper: DataFrame, key: str = "k") -> DataFrame:
    """Compaction with the tombstone rule per key: a tombstone stays while the zone map of a deeper table (min_key, max_key) holds its key."""
    newest = latest(records, drop_tombstones=False, key=key)
    gone = newest.filter(F.col("op") != SET)
    dead = interval_join(gone, deeper.select("min_key", "max_key"), key, key, "min_key", "max_key", semi=True)
    return newest.filter(F.col("op") == SET).unionByName(dead)


def overlap_join(tables: DataFrame, next_level: DataFrame) -> DataFrame:
    """Pairs of a table and a table of the next level whose key ranges overlap (both ends inclusive)."""
    other = next_level.select(*[F.col(c).alias(f"next_{c}") for c in ("id", "min_key", "max_key", "bytes")])
    return interval_join(tables, other, "min_key", "max_key", "next_min_key", "next_max_key")


def least_overlap(tables: DataFrame, next_level: DataFrame) -> DataFrame:
    """The table with the least overlap ratio, of equals the first by smallest key."""
    summed = tables.join(overlap_join(tables, next_level).groupBy("id").agg(F.sum("next_bytes").cast("long").alias("overlap")), "id", "left")
    rated = summed.withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long"))).withColumn("ratio", F.col("overlap") / F.greatest("bytes", F.lit(1)))
    return rated.orderBy("ratio", "min_key").limit(1)


def neighbours(tables: DataFrame, group: str = "lvl") -> DataFrame:
    """For every group of tables whether neighbours by smallest key are disjoint."""
    before = F.lag("max_key").over(Window.partitionBy(group).orderBy("min_key", "id"))
    return tables.withColumn("touch", F.coalesce(before >= F.col("min_key"), F.lit(False))).groupBy(group).agg((~F.max("touch")).alias("movable"))


def split(records: DataFrame, target_bytes: int, key: str = "k", value: str = "v", ranges: int | None = None) -> DataFrame:
    """Records with ``part``: a new part begins once the bytes since the last cut reach the target.

    The cut is greedy, so each key range is walked in order by one task that holds a batch at a time. Ranges (as many as shuffle
    partitions, if not given) are walked in parallel; parts of range r are numbered from r * 2^32. With one range the cut is that of a single walk.
    """
    ranges = ranges or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = records.withColumn("__bytes", octets(key, value))
    ordered = ordered.coalesce(1).sortWithinPartitions(key) if ranges == 1 else ordered.repartitionByRange(ranges, key).sortWithinPartitions(key)
    names = [c for c in ordered.columns if c != "__bytes"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size = TaskContext.get().partitionId() << 32, 0
        for rows in batches:
            parts = []
            for n in rows["__bytes"]:
                if size >= target_bytes:
                    part, size = part + 1, 0
                size += n
                parts.append(part)
            yield rows[names].assign(part=parts)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields)
    return ordered.mapInPandas(walk, f"{schema}, part long")
