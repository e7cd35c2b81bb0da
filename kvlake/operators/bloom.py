"""Per-table Bloom filters in built-in bitmaps, and probe accounting.

A filter of ``bits`` per key has k = bits * 69 / 100 probes (fixed ratio). Positions come from double hashing, and bits are
kept as Spark's 32,768-bit bitmaps, one row per (table, bucket): the build is a mergeable aggregate and no row grows with a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.operators.zonemap import interval_join

PROBE_PERCENT = 69
#: Bits of one of Spark's bitmaps.
BUCKET = 1 << 15


def probes(bits_per_key: int) -> int:
    return max(1, bits_per_key * PROBE_PERCENT // 100)


def _hashed(df: DataFrame, key: str, sizes: str) -> DataFrame:
    """df with the two hashes of a key that all its positions follow from, as remainders, so that their sums cannot overflow."""
    a, b = F.xxhash64(F.col(key), F.lit(0)), F.xxhash64(F.col(key), F.lit(1)).bitwiseOR(1)
    return df.withColumns({"__a": F.pmod(a, F.col(sizes)), "__b": F.pmod(b, F.col(sizes))})


def _positions(sizes: str, bits_per_key: int) -> list[str]:
    """The positions of a hashed key, as SQL."""
    return [f"pmod(__a + {i}L * __b, {sizes})" for i in range(probes(bits_per_key))]


def build(records: DataFrame, table: str = "run", key: str = "k", bits_per_key: int = 12) -> DataFrame:
    """(table, bits, bucket, bitmap): the filter of every table's keys."""
    keys = records.select(table, key).distinct()
    sizes = keys.groupBy(table).agg((F.greatest(F.count("*") * bits_per_key, F.lit(64))).alias("bits"))
    bit = F.explode(F.array(*map(F.expr, _positions("bits", bits_per_key))))
    at = _hashed(keys.join(sizes, table), key, "bits").select(table, "bits", bit.alias("__bit"))
    return at.groupBy(table, "bits", F.expr(f"__bit div {BUCKET}").alias("bucket")).agg(F.expr(f"bitmap_construct_agg(__bit % {BUCKET})").alias("bitmap"))


def may_contain(pairs: DataFrame, filters: DataFrame, table: str = "run", key: str = "k", bits_per_key: int = 12) -> DataFrame:
    """pairs (table, key) with ``maybe``: false only if the key is not in the table.

    A pair goes once to each bucket that it has positions in, and all of these are looked up there, in words that the bitmap is cut into before the join.
    """
    sizes = filters.select(table, "bits").distinct()
    at = _positions("bits", bits_per_key)
    buckets = F.expr(f"if(bits <= {BUCKET}, array(0L), array_distinct(array({', '.join(f'shiftright({p}, 15)' for p in at)})))")
    asked = _hashed(pairs.select(table, key).join(sizes.hint("shuffle_hash"), table), key, "bits").withColumn("bucket", F.explode(buckets))
    last = f"least({BUCKET // 64 - 1}L, (bits - bucket * {BUCKET} - 1) div 64)"
    words = F.expr(f"transform(sequence(0L, {last}), i -> cast(conv(hex(substring(bitmap, cast(i * 8 + 1 as int), 8)), 16, -10) as bigint))")
    met = asked.join(filters.select(table, "bucket", words.alias("__words")).hint("shuffle_hash"), [table, "bucket"], "left")
    # positions in a projection of their own, and shifts: the generated code stays small enough to be compiled
    met = met.select(table, key, "bucket", "__words", *[F.expr(p).alias(f"__p{i}") for i, p in enumerate(at)])
    # a word's first byte is its highest one
    is_set = lambda p: f"coalesce(shiftright(get(__words, int(shiftright({p} & {BUCKET - 1}, 6))), int({p} & 63) ^ 56) & 1, 0) = 1"
    maybe = F.expr(" and ".join(f"(shiftright(__p{i}, 15) <> bucket or {is_set(f'__p{i}')})" for i in range(len(at))))
    return met.select(table, key, maybe.alias("maybe")).groupBy(table, key).agg(F.min("maybe").alias("maybe"))


def probe_counts(keys: DataFrame, records: DataFrame, meta: DataFrame, filters: DataFrame, table: str = "run", key: str = "k", bits_per_key: int = 12) -> DataFrame:
    """For every key: tables in range, those that hold it, those its filter excludes, false positives among the rest, and held ones that a filter excludes (none)."""
    pairs = interval_join(keys.select(key).distinct(), meta.select(table, "min_key", "max_key"), key, key, "min_key", "max_key").select(table, key)
    asked = may_contain(pairs, filters, table, key, bits_per_key)
    held = records.select(table, key).distinct().withColumn("held", F.lit(True))
    both = asked.join(held, [table, key], "left")
    return both.groupBy(key).agg(
        F.count("*").alias("probed"),
        F.count("held").alias("held"),
        F.count_if(~F.col("maybe")).alias("negative"),
        F.count_if(F.col("maybe") & F.col("held").isNull()).alias("false_positive"),
        F.count_if(~F.col("maybe") & F.col("held").isNotNull()).alias("missed"),
    )
