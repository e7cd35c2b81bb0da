"""Table statistics and pruning by key range. Metadata tables have id, lvl, min_key, max_key, keys and bytes; they are small (a row per file)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.functions.scalar import separator
from kvlake.operators.snapshot import numbered


def octets(key: str = "k", value: str = "v") -> Column:
    return F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0))


def run_meta(deduplicated: DataFrame, by: str = "run", key: str = "k", value: str = "v") -> DataFrame:
    """Zone map of every run: smallest and largest key, keys and bytes."""
    return deduplicated.groupBy(by).agg(
        F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count("*").alias("keys"), F.sum(octets(key, value)).cast("long").alias("bytes")
    )


def point_candidates(meta: DataFrame, wanted) -> DataFrame:
    """Tables that may hold a key."""
    return meta.filter((F.col("min_key") <= F.lit(wanted)) & (F.col("max_key") >= F.lit(wanted)))


def range_candidates(meta: DataFrame, lower=None, upper=None) -> DataFrame:
    """Tables that overlap [lower, upper)."""
    out = meta if lower is None else meta.filter(F.col("max_key") >= F.lit(lower))
    return out if upper is None else out.filter(F.col("min_key") < F.lit(upper))


def interval_join(left: DataFrame, right: DataFrame, low: str, high: str, other_low: str, other_high: str, bins: int = 256, semi: bool = False) -> DataFrame:
    """Pairs of rows whose ranges [low, high] and [other_low, other_high] overlap, both ends inclusive; with ``semi`` the left rows that have a partner.

    The key space is cut at about ``bins`` starts of the right side, drawn by hash (all of them, if there are fewer than twice as many). Rows go to all bins they meet and are joined by bin, so no
    side is broadcast whole or compared with all of the other. A pair is given out in the first bin that both meet.
    """
    starts = right.select(F.col(other_low).alias("cut")).filter("cut is not null").distinct()
    step = max(1, starts.count() // bins)
    cuts = F.array(*[F.lit(r["cut"]) for r in starts.filter(F.pmod(F.xxhash64("cut"), F.lit(step)) == 0).collect()])  # about ``bins`` values
    bin_of = lambda c: F.size(F.filter(cuts, lambda cut: cut <= F.col(c)))
    dealt = lambda df, a, b, to: df.withColumn(f"__{to}", bin_of(a)).withColumn("__bin", F.explode(F.sequence(F.col(f"__{to}"), F.greatest(bin_of(b), F.col(f"__{to}")))))
    ours, theirs = dealt(left, low, high, "l"), dealt(right, other_low, other_high, "r")
    meet = (F.col(low) <= F.col(other_high)) & (F.col(high) >= F.col(other_low))
    if semi:
        return ours.join(theirs, (ours["__bin"] == theirs["__bin"]) & meet, "left_semi").drop("__l", "__bin")
    return ours.join(theirs, "__bin").filter(meet & (F.col("__bin") == F.greatest("__l", "__r"))).drop("__l", "__r", "__bin")


def probe_candidates(keys: DataFrame, meta: DataFrame, key: str = "k") -> DataFrame:
    """Every key with every table that may hold it."""
    return interval_join(keys, meta, key, key, "min_key", "max_key")


def set_range(meta: DataFrame, *by: str) -> DataFrame:
    return meta.groupBy(*by).agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def blocks(run: DataFrame, block_bytes: int, key: str = "k", value: str = "v") -> DataFrame:
    """Rows of a sorted run with ``block``: a block ends once its bytes pass a multiple of ``block_bytes``. Sums are taken in two levels."""
    sized = numbered(run.withColumn("__n", octets(key, value)), F.col(key), into="__ord").withColumn("__span", F.expr("__ord div 4096"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    spans = sized.groupBy("__span").agg(F.sum("__n").alias("__t")).select("__span", F.coalesce(F.sum("__t").over(before(Window.orderBy("__span"))), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__n").over(before(Window.partitionBy("__span").orderBy("__ord"))), F.lit(0))
    return sized.withColumn("__within", within).join(spans, "__span").withColumn("block", F.expr(f"(__base + __within) div {block_bytes}")).drop("__n", "__ord", "__span", "__within", "__base")


def sparse_index(blocked: DataFrame, key: str = "k") -> DataFrame:
    """A row a block: first and last key, and the separator: the shortest key from the last key on and before the next block, if it is shorter; else the last key."""
    ends = blocked.groupBy("block").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    following = F.lead("first_key").over(Window.orderBy("block"))  # a row a block
    return ends.withColumn("next_key", following).withColumn("separator", F.coalesce(separator(F.col("last_key"), F.col("next_key")), F.col("last_key"))).drop("next_key")


def find_block(index: DataFrame, wanted) -> DataFrame:
    """The block that a key lies in if the run has it: the first whose separator is not below it."""
    return index.filter(F.col("separator") >= F.lit(wanted)).orderBy("block").limit(1)


def level_sizes(meta: DataFrame) -> DataFrame:
    return meta.groupBy("lvl").agg(F.sum("bytes").cast("long").alias("bytes"), F.count("*").alias("tables"))


def orphans(files: DataFrame, live: DataFrame, on: str = "path") -> DataFrame:
    """Files that no live table names."""
    return files.join(live, on, "left_anti")
