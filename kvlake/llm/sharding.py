"""Hilbert-curve sharding with DataFrame functions only.

Three metadata dimensions (source, size, id) are quantised to ``bits`` bits
each, the cell's index on a Hilbert curve orders the rows, and the order is
cut into runs of equal row counts (law ``rows``: counts at most one apart).
Each shard then covers a compact box of the three dimensions, so files written
from it (``write_shards``) have narrow min/max ranges in all of them.

Sizes and ids are quantised by their approximate quantiles and sources by the
share of rows before them, so outliers and hot sources do not crowd the rows
into few cells. The total order (curve, text, size, id) is dealt into ranges by
a sample of it, so a cell that is hot all the same is split over tasks.

Null ids and sources lie at the low end of their dimension; a null text has
size 1. Repeated rows are rows of their own, placed in any order among
themselves. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.store import saved
from kvlake.operators.snapshot import numbered


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve of len(dims) dimensions of ``bits`` bits, as a long (transposed form, bits interleaved)."""
    n = len(dims)
    steps = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])

    def exchange(x: Column, i: Column, q: Column) -> Column:
        flip = (x[0].bitwiseXOR(x[i])).bitwiseAND(q - 1)
        return F.when(
            x[i].bitwiseAND(q) != 0, F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(q - 1)).otherwise(v))
        ).otherwise(F.transform(x, lambda v, j: F.when((j == 0) | (j == i), v.bitwiseXOR(flip)).otherwise(v)))

    axes = F.array(*[d.cast("int") for d in dims])
    undone = F.aggregate(steps, axes, lambda s, q: F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), s, lambda x, i: exchange(x, i, q)))
    gray = F.transform(undone, lambda _, j: F.aggregate(F.slice(undone, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
    turned = F.aggregate(
        steps,
        F.struct(gray.alias("x"), F.lit(0).alias("t")),
        lambda s, q: F.struct(
            s["x"].alias("x"), F.when(s["x"][n - 1].bitwiseAND(q) != 0, s["t"].bitwiseXOR(q - 1)).otherwise(s["t"]).alias("t")
        ),
        lambda s: F.transform(s["x"], lambda v: v.bitwiseXOR(s["t"])),
    )
    places = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(
        places,
        F.struct(turned.alias("x"), F.lit(0).cast("long").alias("h")),
        lambda s, b: F.struct(
            s["x"].alias("x"),
            F.aggregate(s["x"], s["h"], lambda h, v: h * 2 + F.call_function("shiftright", v, b).bitwiseAND(1)).alias("h"),
        ),
        lambda s: s["h"],
    )


def _quantiles(name: str, cells: int) -> Column:
    return F.coalesce(F.percentile_approx(name, [i / cells for i in range(1, cells)], 100 * cells), F.array().cast("array<long>")).alias(f"{name}_cuts")


def _cell(name: str) -> Column:
    """Number of the name's quantiles that a row reaches; 0 for null."""
    return F.when(F.col(name).isNull(), 0).otherwise(F.size(F.filter(f"{name}_cuts", lambda cut: cut <= F.col(name))))


def _source_places(rows: DataFrame, cells: int) -> DataFrame:
    """(source, place): the share of rows before each source in its order, in cells. Sources are ranged and summed in two levels, however many there are."""
    by_source = rows.groupBy("source").agg(F.count("*").alias("n"))
    dealt, _ = saved(by_source.repartitionByRange(F.col("source").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.sum("n").alias("n"))  # a row a range
    parts = parts.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy()).alias("total"))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first()))), F.lit(0))
    return dealt.withColumn("within", within).join(F.broadcast(parts), "part").select("source", F.floor((F.col("begin") + F.col("within")) * cells / F.col("total")).cast("int").alias("place"))


def hilbert_shards(docs: DataFrame, shards: int = 16, bits: int = 6, doc_id: str = "doc_id", text: str = "text", source: str = "source", whole: bool = False) -> DataFrame:
    """One row per row of docs: id, size, text_crc32, curve index, shard and gapless slot in it; with ``whole`` also the row itself, as struct ``row``."""
    octets = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    rows, _ = saved(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            (F.octet_length(octets).cast("long") + 1).alias("size"),
            F.crc32(octets).alias("text_crc32"),
            *([F.struct("*").alias("row")] if whole else []),
        )
    )
    cells = 1 << bits
    cuts = rows.agg(_quantiles("doc_id", cells), _quantiles("size", cells))
    places = _source_places(rows, cells)
    placed = rows.join(places, rows["source"].eqNullSafe(places["source"]), "left").drop(places["source"]).crossJoin(F.broadcast(cuts))
    indexed = placed.select("doc_id", "size", "text_crc32", *(["row"] if whole else []), hilbert_index([F.col("place"), _cell("size"), _cell("doc_id")], bits).alias("curve"))
    total = rows.count()
    q, longer = total // shards, total % shards * (total // shards + 1)
    # rows that agree in all else are told apart by a hash, so that ranges can split them
    spread, _ = saved(indexed.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id())))  # else sampling computes the curve again
    ranked = numbered(spread, *[F.col(c) for c in ("curve", "text_crc32", "size", "doc_id", "__salt")], into="rank").withColumn("rank", F.col("rank") - 1)
    return ranked.selectExpr(
        "doc_id",
        "size",
        "text_crc32",
        "curve",
        f"cast(if(rank < {longer}, rank div {q + 1}, {longer // (q + 1)} + (rank - {longer}) div {max(q, 1)}) as int) as shard",
        f"if(rank < {longer}, rank % {q + 1}, (rank - {longer}) % {max(q, 1)}) as slot",
        *(["row"] if whole else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, **options) -> None:
    """Write the rows of docs as Parquet, a folder ``shard=n`` each, in curve order: files and row groups have narrow ranges of source, size and id."""
    rows = hilbert_shards(docs, shards, whole=True, **options)
    rows.select("row.*", F.col("shard").alias("shard")).write.partitionBy("shard").parquet(path)


def file_ranges(files: DataFrame, *names: str) -> DataFrame:
    """Smallest and largest value of columns in every file of a table that was read from files."""
    ends = [f(n).alias(f"{n}_{k}") for n in names for k, f in (("min", F.min), ("max", F.max))]
    return files.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), *ends)
