"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into ``segments``, each with an index from value to
codes. If all segments before the a-th have been searched up to radius r and the
others up to r - 1, every code within a distance of segments * r + a - 1 is known
by the pigeonhole principle. So a query searches one segment at one more bit
at a time, verifies the full distance of what it finds, and stops once k
verified distances are covered. The result is exact.

Codes and queries are dealt by hash into blocks of bounded size, and every pair of
blocks is searched by itself: a pair gives out at most k answers a query,
however close the codes lie, and the answers of all blocks are merged by one
more top-k. Equal query codes are searched once, and of equal codes only the k
smallest ids take part, which no query can exceed.

A segment has about as many values as a block has codes (16 bits, 262,144 codes),
so a bucket holds a few codes and a query of random codes verifies about a tenth of
a block. Blocks are large so that few copies are sent: each code goes to every
block of queries, each query to every block of codes.

Ties go to the smaller id. Null or short vectors have no code: they are
neither queries nor answers. Rows without an id are no answers. Repeated rows
are answers of their own. An empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvlake.llm.store import saved


def sign_code(vector: str, bits: int) -> Column:
    """A long whose bit i says that component i of a column is above 0; null if there are fewer components. bits: 64 at most."""
    set_bits = " | ".join(f"if(coalesce({vector}[{i}] > 0, false), shiftleft(1L, {i}), 0L)" for i in range(bits))
    return F.expr(f"if(size({vector}) >= {bits}, {set_bits}, null)")


class Index:
    """The codes of a block, listed by the value of each segment."""

    def __init__(self, codes: np.ndarray, ids: np.ndarray, bits: int, segments: int):
        self.codes, self.ids, self.segments, self.width = codes, ids, segments, bits // segments
        self.size, self.verified = 1 << self.width, 0
        self.values = [self._part(codes, s) for s in range(segments)]
        self.order = [np.argsort(v, kind="stable") for v in self.values]
        self.starts = [np.concatenate([[0], np.cumsum(np.bincount(v, minlength=self.size))]) for v in self.values]
        weight = np.bitwise_count(np.arange(self.size, dtype=np.uint64))
        self.masks = [np.flatnonzero(weight == r) for r in range(self.width + 1)]

    def _part(self, code, s: int):
        return ((code >> np.uint64(s * self.width)) & np.uint64(self.size - 1)).astype(np.int64)

    def search(self, code: np.uint64, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest codes, or of all if there are fewer."""
        far = np.full(len(self.codes), 255, np.uint8)
        seen = np.zeros(256, np.int64)  # verified codes by distance
        for r in range(self.width + 1):
            for s in range(self.segments):
                near = int(self._part(code, s)) ^ self.masks[r]
                begin = self.starts[s][near]
                count = self.starts[s][near + 1] - begin
                upto = np.cumsum(count)
                found = self.order[s][np.repeat(begin - (upto - count), count) + np.arange(upto[-1])]
                found = found[far[found] == 255]
                if len(found):
                    d = np.bitwise_count(self.codes[found] ^ code)
                    far[found] = d
                    seen += np.bincount(d, minlength=256)
                covered = self.segments * r + s
                if seen[: covered + 1].sum() >= k:
                    break
            else:
                continue
            break
        self.verified += int(seen.sum())
        kth = np.searchsorted(np.cumsum(seen), min(k, seen.sum()))
        best = np.flatnonzero(far <= min(kth, 254))
        best = best[np.lexsort((self.ids[best], far[best]))][:k]
        return self.ids[best], far[best].astype(np.int32)


def top_k(queries: DataFrame, codes: DataFrame, k: int = 10, bits: int = 64, segments: int = 4, code_block: int = 262_144, query_block: int = 8_192) -> DataFrame:
    """query_id, rank (from 1), id and distance of the k nearest codes of each query.

    queries: (query_id, code); codes: (id, code). Rows without a code are left out.
    """
    spark = codes.sparkSession
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    entries, _ = saved(codes.filter("code is not null and id is not null").withColumn("n", nth).filter(F.col("n") <= k).select("id", "code"))
    asked, _ = saved(queries.filter("code is not null").select("query_id", "code"))
    distinct = asked.select(F.col("code").alias("q")).distinct()
    n_codes, n_asked = -(-entries.count() // code_block) or 1, distinct.count()
    # with few blocks of codes, smaller blocks of queries keep all cores busy
    n_queries = max(-(-n_asked // query_block), min(-(-n_asked // 64), -(-4 * spark.sparkContext.defaultParallelism // n_codes))) or 1
    block = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(n)).cast("int")
    # pairs of blocks are dealt by number, four places for each, so that they do not crowd in few tasks
    tasks = min(4 * n_codes * n_queries, max(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = entries.withColumn("cb", block("id", n_codes)).withColumn("qb", F.expr(f"explode(sequence(0, {n_queries - 1}))")).repartition(tasks, "qb", "cb")
    probes = distinct.withColumn("qb", block("q", n_queries)).withColumn("cb", F.expr(f"explode(sequence(0, {n_codes - 1}))")).repartition(tasks, "qb", "cb")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["q", "id", "distance"]
        if not len(left) or not len(right):
            return pd.DataFrame({n: [] for n in names}).astype({"q": "int64", "id": "int64", "distance": "int32"})
        index = Index(right["code"].to_numpy().view(np.uint64), right["id"].to_numpy(), bits, segments)
        parts = [(q, *index.search(np.uint64(q & 0xFFFFFFFFFFFFFFFF), k)) for q in left["q"].tolist()]
        q = np.repeat(np.array([p[0] for p in parts], np.int64), [len(p[1]) for p in parts])
        return pd.DataFrame({"q": q, "id": np.concatenate([p[1] for p in parts]), "distance": np.concatenate([p[2] for p in parts])})

    found = probes.groupBy("qb", "cb").cogroup(rows.groupBy("qb", "cb")).applyInPandas(run, "q long, id long, distance int")
    rank = F.row_number().over(Window.partitionBy("q").orderBy("distance", "id"))
    best = found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)
    return asked.join(best, asked["code"] == best["q"]).select("query_id", "rank", "id", "distance")
