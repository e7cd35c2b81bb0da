"""Best-fit packing of tokenised documents by swap-based local search.

Documents become token ids followed by an end id and are cut, only where
longer than a sequence, into pieces of ``length`` tokens; the first piece of a
cut document may be shorter. Full pieces are sequences of their own, numbered
in shards of their own. Shorter ones are dealt by hash into shards; shards of
both kinds hold about ``shard_items`` pieces. Each shard of shorter pieces
is packed by itself: best-fit decreasing first, then local search.
While a shard has more bins than its tokens need, underfull bins take from
emptier ones, the fullest first: a document is moved, or one exchanged for
one, two for one or one for two, by the largest net shift that the bin
has room for. Every step raises the sum of squared fills, and the search ends
only where no pair of underfull bins has such an exchange; bins that come empty
go. What bins can give is indexed by length, so no pairs of bins are tried. Shards do not grow with the input. What a shard wastes beyond the lower
bound (its tokens over the length of a sequence) is measured in the README:
some bins where documents are long against a sequence, as no such exchange
then fills bins to the brim.

Token ids are those of the byte-level BPE file given by its path. A special
token's string in a text is that token, and the text around it is encoded by
itself. Texts split
at single spaces and single line breaks between non-space characters into
chunks whose ids do not depend on their surroundings, so chunk ids are cached
(a bounded cache); texts with other white space at such places are encoded
whole.

Null and empty texts are the end id alone. Repeated rows are pieces of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.store import saved, small_batches

#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_of() -> dict[str, int]:
    """Characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, others follow from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(path: str) -> tiktoken.Encoding:
    """The encoder of a byte-level BPE tokenizer file (JSON), with its added tokens as special tokens."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that depend on their surroundings are not supported")
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in t): i for t, i in file["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Copies of one row that are numbered at once.
COPIES = 4096


class _Whole(Exception):
    """A chunk at whose edge splitting is not safe."""


class _Chunks(dict):
    LIMIT = 150_000

    def __init__(self, encoding: tiktoken.Encoding, prefix: str):
        self.encode, self.prefix = encoding.encode_ordinary, prefix

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            raise _Whole
        ids = array("I", self.encode(self.prefix + chunk)).tobytes()
        if len(chunk) <= 48:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = ids
        return ids


class CachedEncoder:
    """Token ids of texts, as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        self.encoding = load_encoding(path)
        self.first, self.later = _Chunks(self.encoding, ""), _Chunks(self.encoding, " ")
        self.line = array("I", self.encoding.encode_ordinary("\n")).tobytes()
        names = sorted(self.encoding.special_tokens_set, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None
        self.names = {n: array("I", [self.encoding.encode_single_token(n)]).tobytes() for n in names}

    def __call__(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self._ordinary(text)
        return b"".join(self.names.get(part) or self._ordinary(part) for part in self.special.split(text))

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        first, later, lines = self.first, self.later, []
        try:
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                lines.append(b"".join([first[head], *[later[w] for w in rest]]))
        except _Whole:
            return array("I", self.encoding.encode_ordinary(text)).tobytes()
        return self.line.join(lines)


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece."""
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = CachedEncoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for i, t in enumerate(batch.column(1)):
                ids = memoryview(encode(t.as_py() or "") + end)
                n = len(ids) // 4
                cuts = [0, *range(n % length or length, n + 1, length)] if n > length else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, x in zip(out, (i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(x)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = [pa.array(c, k) for c, k in zip(out[1:], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), *cols], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# -- packing one shard ------------------------------------------------------------------------------------------------------------


def best_fit(lengths: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing: bins of item numbers."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    rooms = 0  # a bit for each room that some bin has
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if fits := rooms >> n:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = cap, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class _Offers:
    """What underfull bins can give by its length: one document, or two of one bin. Finds the least full bin for a length."""

    def __init__(self, cap: int):
        self.bits, self.heaps, self.stamp = [0, 0], ([[] for _ in range(cap + 1)], [[] for _ in range(cap + 1)]), {}
        self.count = ([0] * (cap + 1), [0] * (cap + 1))
        self.has: dict[int, tuple[set[int], set[int]]] = {}
        self.clock = 0

    def enter(self, b: int, fill: int, lens: list[int]) -> None:
        kinds = sorted(set(lens))
        pairs = {x + y for i, x in enumerate(kinds) for y in kinds[i + 1 :]} | {2 * x for x in kinds if lens.count(x) > 1}
        self.clock += 1
        self.has[b], self.stamp[b] = (set(kinds), pairs), self.clock
        for k in (0, 1):
            for v in self.has[b][k]:
                heappush(self.heaps[k][v], (fill, b, self.clock))
                self.count[k][v] += 1
                self.bits[k] |= 1 << v

    def leave(self, b: int) -> None:
        for k, values in enumerate(self.has.pop(b)):
            for v in values:
                self.count[k][v] -= 1
                if not self.count[k][v]:
                    self.bits[k] &= ~(1 << v)
        del self.stamp[b]

    def least_full(self, k: int, v: int, but: int) -> tuple[int, int] | None:
        """(fill, bin) of the least full bin, other than one, that can give v by k + 1 documents."""
        heap, own = self.heaps[k][v], None
        while heap and (self.stamp.get(heap[0][1]) != heap[0][2] or heap[0][1] == but):
            entry = heappop(heap)
            if self.stamp.get(entry[1]) == entry[2]:
                own = entry
        found = heap[0][:2] if heap else None
        if own:
            heappush(heap, own)
        return found

    def best_for(self, b: int, fill: int, cap: int) -> tuple[int, int, int, int] | None:
        """(source, documents it gives, their length, length given back) with the largest net shift that bin b has room for and that raises the squared fills."""
        room, best, found = cap - fill, 0, None
        ones, pairs = self.has[b]
        for k, backs in ((0, [0, *ones, *pairs]), (1, ones)):
            for back in backs:
                fits = (self.bits[k] >> (back + 1 + best)) & ((1 << (room - best)) - 1)
                while fits:
                    v = back + best + fits.bit_length()
                    source = self.least_full(k, v, b)
                    if source and fill - source[0] + v - back > 0:
                        best, found = v - back, (source[1], k + 1, v, back)
                        break
                    fits &= ~(1 << (fits.bit_length() - 1))
                if best == room:
                    return found
        return found


def _take(items: list[int], lengths: list[int], total: int, most: int) -> list[int]:
    """Remove one or up to ``most`` (1 or 2) items of a total length from a bin."""
    if not total:
        return []
    for i in items:
        if lengths[i] == total:
            items.remove(i)
            return [i]
    at: dict[int, int] = {}
    for i in items if most == 2 else []:
        if (j := at.get(total - lengths[i])) is not None:
            items.remove(i)
            items.remove(j)
            return [i, j]
        at[lengths[i]] = i
    raise AssertionError("no such items")


def local_search(bins: list[list[int]], lengths: list[int], cap: int) -> list[list[int]]:
    """Empty bins while there are more than the tokens need and some exchange raises the sum of squared fills.

    The fullest underfull bins take first, and take from the least full bin that has what fits best.
    """
    need = max(-(-sum(lengths) // cap), sum(2 * n > cap for n in lengths))
    fill = [sum(lengths[i] for i in b) for b in bins]
    offers, alive, improved = _Offers(cap), len(bins), True

    def enter(b: int) -> None:
        if 0 < fill[b] < cap:
            offers.enter(b, fill[b], [lengths[i] for i in bins[b]])

    for b in range(len(bins)):
        enter(b)
    while improved and alive > need:
        improved = False
        for b in sorted(offers.has, key=lambda b: (-fill[b], b)):
            while b in offers.has and alive > need and (found := offers.best_for(b, fill[b], cap)):
                source, most, out, back = found
                offers.leave(b)
                offers.leave(source)
                given = _take(bins[source], lengths, out, most)
                returned = _take(bins[b], lengths, back, 2)
                bins[b] += given
                bins[source] += returned
                fill[b] += out - back
                fill[source] -= out - back
                alive -= not fill[source]
                improved = True
                enter(b)
                enter(source)
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], cap: int) -> list[list[int]]:
    return local_search(best_fit(lengths, cap), lengths, cap)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, shard_items: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all docs with sequence_id and gapless offset."""
    small_batches(docs.sparkSession)
    cut, _ = saved(pieces(docs, tokenizer, length, end_id, doc_id, text))
    full_piece = F.col("length") >= length
    counts = cut.agg(F.count_if(~full_piece).alias("short"), F.count_if(full_piece).alias("full")).first()
    shards, full_shards = (max(1, -(-counts[k] // shard_items)) for k in ("short", "full"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], ignore_index=True)
        n = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        some = np.flatnonzero(n < length)
        bins = pack_lengths(n[some].tolist(), length)
        for k, members in enumerate(bins):
            at = some[members]
            sequence[at] = k
            offset[at] = np.cumsum(n[at]) - n[at]
        full = np.flatnonzero(n >= length)
        sequence[full] = len(bins) + np.arange(len(full))
        rows["sequence_id"] = sequence + rows["__shard"].to_numpy() * (1 << 40)
        rows["offset"] = offset
        return rows.drop(columns="__shard")

    # dealt by content and the number of the copy, so that the shards do not depend on the layout of files
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    copies = cut.groupBy(*names).agg(F.count("*").alias("__n"))
    few = copies.filter(F.col("__n") <= COPIES).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__n")))
    # a row with very many copies is dealt to tasks by runs of copies
    runs = copies.filter(F.col("__n") > COPIES).withColumn("__run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {COPIES}"))))
    spread = runs.repartition("__run", *names).withColumn("__copy", F.explode(F.sequence(F.expr(f"__run * {COPIES} + 1"), F.least(F.expr(f"(__run + 1) * {COPIES}"), "__n"))))
    each = few.unionByName(spread.drop("__run"))
    draw = F.xxhash64("doc_id", "piece", "length", "ids_crc32", "__copy")
    salt = F.when(full_piece, F.pmod(draw, F.lit(full_shards)) + shards).otherwise(F.pmod(draw, F.lit(shards)))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return each.withColumn("__shard", salt.cast("long")).select(*names, "__shard").groupBy("__shard").applyInPandas(run, schema)
