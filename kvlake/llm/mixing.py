"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents are dealt by hash into blocks. A source takes part
with whole permuted rounds over its blocks and a last partial round, so that
its words come to its target; in the block where the target falls, whole
documents are taken in hash order to the nearest half document. The block
draws of all sources are split over output shards by a binary tree: at each
node a multivariate hypergeometric draw decides how many of each source's
draws go left, so each shard is a random sample without replacement of all
draws, and the shards are disjoint. ``mixed_rows`` writes out the copies and
shuffles them by hash within their shard.

Words are counted once and saved with id and source; sums, blocks and the
place where a source's target falls are found on that narrow table. Whole rows
are then decided by broadcast tables alone: the plan of the blocks and one
cut for each source.

What the driver holds is bounded: a row per source (``max_sources``) and one
per block (``max_blocks`` in all, plus one per source). All randomness comes
from ``seed``, so reruns agree.

Null sources form a source of their own, last in order. Null and empty texts
have size 0, add no words and are drawn with their block. Rows that repeat are
drawn together, each counted. An empty table gives an empty mix.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.store import remove, saved

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def targets(sizes: list[int], weights: list[float], most: float = MOST_REPEATS) -> list[float]:
    """Shares of sum(sizes) by weight, none above ``most`` times its size; the excess is reshared by weight until none is above."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if weights[i] * unit > most * sizes[i]]
        if not above:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in sorted(above):
            out[i] = float(most * sizes[i])
            left -= out[i]
            open_.discard(i)
    return out


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(shards x sources) draws: quotas split by multivariate hypergeometric draws down a binary tree over the shards."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(lo: int, hi: int, quota: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = quota
            return
        mid = (lo + hi) // 2
        total = int(quota.sum())
        take = total * (mid - lo) // (hi - lo)
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, take, method="marginals") if total else quota
        split(lo, mid, left)
        split(mid, hi, quota - left)

    split(0, shards, quotas.astype(np.int64))
    return out


def _words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


class Mix:
    """The plan of a mix: what each source, block and edge contributes."""

    def __init__(self, sized: DataFrame, shards: int, seed: int, max_blocks: int, max_sources: int):
        """sized: source, size and draw (a hash of the id) of every row."""
        spark = sized.sparkSession
        per_source = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
        if len(per_source) > max_sources:
            raise ValueError(f"more than {max_sources} sources")
        per_source.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in per_source]
        goal = targets(sizes, [float(WEIGHTS[i % len(WEIGHTS)]) for i in range(len(sizes))])
        total = max(1, sum(sizes))
        n_blocks = [max(1, min(r["docs"] // 4, max_blocks * r["size"] // total)) for r in per_source]
        self.head = spark.createDataFrame(
            [(r["source"], i, r["size"], goal[i], n_blocks[i]) for i, r in enumerate(per_source)],
            "__h_source string, __h_nth int, __h_size long, __h_target double, __h_blocks int",
        )
        self.plan, self.cuts = None, None
        dealt = self._blocks(sized)
        blocks = dealt.groupBy(F.col("__h_nth").alias("nth"), F.col("__block").alias("block")).agg(F.sum("size").alias("size")).toPandas()
        rows = _plan(blocks, sizes, goal, n_blocks, shards, seed)
        self.plan = spark.createDataFrame(rows, "__p_nth int, __p_block int, __p_shards array<int>, __p_edge double, __p_edge_shard int")
        # the last draw that a source's edge takes: equal draws are taken together
        edge = self._planned(dealt).filter("__p_edge is not null").groupBy("__h_nth", "__p_edge", "draw", "size").agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("__h_nth").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0))
        within = edge.withColumn("upto", upto).filter(F.col("upto") - F.col("words") / 2 <= F.col("__p_edge"))
        cuts = within.groupBy("__h_nth").agg(F.max(F.struct("draw", "size")).alias("c")).collect()  # a row a source
        self.cuts = spark.createDataFrame([(r["__h_nth"], r["c"]["draw"], r["c"]["size"]) for r in cuts], "__c_nth int, __c_draw long, __c_size long")

    def _blocks(self, rows: DataFrame) -> DataFrame:
        out = rows.join(F.broadcast(self.head), F.col("source").eqNullSafe(F.col("__h_source")), "left")
        return out.withColumn("__block", F.pmod(F.col("draw"), F.col("__h_blocks")).cast("int"))

    def _planned(self, dealt: DataFrame) -> DataFrame:
        return dealt.join(F.broadcast(self.plan), (F.col("__h_nth") == F.col("__p_nth")) & (F.col("__block") == F.col("__p_block")), "left")

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows (source, size, draw and others) with struct ``mix``."""
        out = self._planned(self._blocks(rows)).join(F.broadcast(self.cuts), F.col("__h_nth") == F.col("__c_nth"), "left")
        taken = F.col("__p_edge").isNotNull() & F.coalesce(F.struct("draw", "size") <= F.struct("__c_draw", "__c_size"), F.lit(False)) & F.col("__c_nth").isNotNull()
        shards = F.coalesce(F.when(taken, F.array_append("__p_shards", F.col("__p_edge_shard"))).otherwise(F.col("__p_shards")), F.array().cast("array<int>"))
        mix = F.struct(F.col("size"), F.col("__h_size").alias("source_size"), F.col("__h_target").alias("target"), (F.col("size") * F.size(shards)).alias("taken"), shards.alias("shards"))
        own = [c for c in out.columns if not c.startswith(("__h_", "__p_", "__c_", "__block"))]
        return out.select(*own, mix.alias("mix"))


def _sized(docs: DataFrame, seed: int, text: str, source: str, key: str, *more: Column) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), _words(text).alias("size"), F.xxhash64(F.lit(seed), F.col(key)).alias("draw"), *more)


def mix(docs: DataFrame, shards: int = 16, seed: int = 20, max_blocks: int = 8_192, max_sources: int = 100_000, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """(key, source, mix) of every row of docs; mix: size, source_size, target, taken and shards (one entry for each copy taken)."""
    sized, _ = saved(_sized(docs, seed, text, source, key))
    decided = Mix(sized, shards, seed, max_blocks, max_sources).apply(sized)
    return decided.select(F.col("key").alias(key), F.col("source").alias(source), "mix")


def _plan(blocks, sizes: list[int], goal: list[float], n_blocks: list[int], shards: int, seed: int) -> list[tuple]:
    """Rows (source, block, shards of its whole draws, words of its partial draw, that draw's shard)."""
    words = [np.zeros(n, np.int64) for n in n_blocks]
    for nth, block, size in blocks.itertuples(index=False):
        words[nth][block] = size
    draws, edges = [], []
    for i, w in enumerate(words):
        rounds = int(goal[i] / sizes[i] + 1e-9) if sizes[i] else 0
        rest = goal[i] - rounds * sizes[i]
        orders = [np.random.default_rng([seed, i, r]).permutation(len(w)) for r in range(rounds + 1)]
        done = np.cumsum(w[orders[-1]])
        part = int(np.searchsorted(done, rest, side="right")) if rest > 0.5 else 0
        over = rest - (done[part - 1] if part else 0)
        last = orders.pop()
        draws.append(np.concatenate([*orders, last[: part + (part < len(w) and over > 0 and rest > 0.5)]]).astype(np.int64))
        edges.append((int(last[part]), float(over)) if part < len(w) and over > 0 and rest > 0.5 else None)
    leaf = split_tree(np.array([len(d) for d in draws]), shards, seed) if draws else np.zeros((shards, 0), np.int64)
    out = []
    for i, d in enumerate(draws):
        to = np.repeat(np.arange(shards), leaf[:, i])
        # a random order of the draws: each shard's interval is then a random set of blocks
        at = np.empty(len(d), np.int64)
        at[np.random.default_rng([seed, i, 1 << 20]).permutation(len(d))] = to
        edge_shard = int(at[-1]) if edges[i] else None
        whole = len(d) - bool(edges[i])
        by_block: dict[int, list[int]] = {}
        for b, shard in zip(d[:whole].tolist(), at[:whole].tolist(), strict=True):
            by_block.setdefault(b, []).append(shard)
        if edges[i]:
            by_block.setdefault(edges[i][0], [])
        for b, to_shards in by_block.items():
            is_edge = bool(edges[i]) and b == edges[i][0]
            out.append((i, b, to_shards, edges[i][1] if is_edge else None, edge_shard if is_edge else None))
    return out


def mixed_rows(docs: DataFrame, shards: int = 16, seed: int = 20, max_blocks: int = 8_192, max_sources: int = 100_000, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: docs' columns, ``mix_shard`` and ``mix_order``, one row for each copy taken.

    Rows lie in order of ``mix_shard`` and, in a shard, of ``mix_order``, a hash: each partition is a range of that order, so
    written as files they are the shuffled shards one after the other.
    """
    narrow, path = saved(_sized(docs, seed, text, source, key))
    decided = Mix(narrow, shards, seed, max_blocks, max_sources)
    remove(docs.sparkSession, path)
    taken = decided.apply(_sized(docs, seed, text, source, key, F.struct("*").alias("row")))
    out = taken.select("row", "key", F.posexplode("mix.shards").alias("copy", "mix_shard"))
    out = out.withColumn("mix_order", F.xxhash64(F.lit(seed), "key", "copy")).select("row", "mix_shard", "mix_order")
    spread = out.repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("mix_shard", "mix_order")]
    return spread.select(*own, "mix_shard", "mix_order")
