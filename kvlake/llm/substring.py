"""Substring deduplication by level-wise doubling of repeated windows.

A window is a run of words of one text. Windows repeated at one length are
the only ones that can repeat at twice that length, so candidates are
extended level by level: half the asked length, then the asked length. Repeats
of the asked length decide which words are removed, so the query stops there. With
``levels`` the doubling goes on, twice that length and so on, until no
candidate survives; the last level that a text takes part in says how long its longest
repeats are (``longest_repeat``, the asked length doubled so many times; 0 for none).

Level 1 does not need every start: of the starts of half-length windows inside
any window of the asked length, the one with the least hash is marked
(winnowing), so two occurrences of one window mark the same place. About two
windows in twelve are marked; marked windows that occur once are dropped.
Each survivor is extended to all windows of the asked length that contain it.
Of these, every one that also starts earlier (smaller id, or same id and
earlier start) is a repeat, and the words it covers are removed. Beyond the
asked length a window is two repeated halves side by side, so texts are not
read again: its digest follows from those of its halves.

Windows are told apart by digests of 64 and 32 bits together, so that of 10^13
windows any two are taken for one another with a probability below 0.001.

Texts with equal word sequences are one class: the first id stands for all.
A later copy is removed whole if it has a window at all.

Counts are aggregated before they are shuffled and joined back on the window's
hash, so a passage that many texts share is no single task's work.

Null texts have no words. Rows that repeat an id count as one document: the
same window at the same place of two of them is no repeat. Rows without an id
are left whole, and are no other text's earlier copy. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvlake.llm.store import release, remove, saved, small_batches
from kvlake.llm.words import Words, blocks, digest, mix, scan, windows

SECOND = np.uint64(0x5851F42D4C957F2D)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _kept_sha(w: Words, a: int, b: int, keep: np.ndarray | None = None) -> str:
    """sha256 of words a..b of w joined by spaces, or of those that keep marks."""
    at = np.arange(a, b) if keep is None else a + np.flatnonzero(keep)
    if not len(at):
        return _EMPTY
    start, end = w.start[at], w.end[at]
    if keep is None and (start[1:] - end[:-1] == 1).all():
        data = w.data[start[0] : end[-1]].copy()
        data[end[:-1] - start[0]] = 32
        return hashlib.sha256(data.tobytes()).hexdigest()
    # every kept word with the byte after it, which becomes the space
    size = end - start + 1
    total = np.cumsum(size)
    out = w.data[np.repeat(start - (total - size), size) + np.arange(total[-1])]
    out[total - 1] = 32
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def _described(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, digest of the word sequence (d1, d2) and sha256 of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch):
                w = scan(texts)
                hashes = w.hashes()
                spans = list(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True))
                marks = [digest(hashes[a:b]) for a, b in spans]
                cols = [pa.array([b - a for a, b in spans], pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64())]
                shas = pa.array([_kept_sha(w, a, b) for a, b in spans], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), *cols, shas], ["doc_id", "n_words", "d1", "d2", "sha"])

    return docs.mapInArrow(run, "doc_id long, n_words long, d1 long, d2 long, sha string")


def marked_starts(hashes: np.ndarray, first: np.ndarray, half: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, hash) of the half-length windows marked by winnowing: in each window of ``length`` words, the start with the least hash (the last of equals)."""
    runs = windows(hashes, half)
    texts, starts, values = [], [], []
    span = length - half + 1
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a < length:
            continue
        own = runs[a : b - half + 1]
        views = np.lib.stride_tricks.sliding_window_view(own[::-1], span)
        at = len(own) - 1 - (np.arange(len(views)) + views.argmin(axis=1))
        at = np.unique(at)
        texts.append(np.full(len(at), i))
        starts.append(at)
        values.append(own[at])
    if not texts:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64)
    return np.concatenate(texts), np.concatenate(starts), np.concatenate(values)


def _anchors(docs: DataFrame, half: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, texts in blocks(batch):
                w = scan(texts)
                row, start, value = marked_starts(w.hashes(), w.first, half, length)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + at)), pa.array(start.astype(np.int32)), pa.array(value.view(np.int64))], ["doc_id", "start", "h"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start int, h long")


def _repeated(rows: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """Rows whose digest occurs again, saved, and their path.

    The digests are saved before the join: both of its sides are then plain shuffles, and a digest with very many rows can be split over tasks.
    """
    again, path = saved(rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by))
    out = saved(rows.join(again, [*by], "left_semi"))
    remove(rows.sparkSession, path)
    return out


def _extended(docs: DataFrame, starts: DataFrame, span: int, length: int) -> DataFrame:
    """(doc_id, start, h, g) of all windows of ``length`` words that begin at most ``span`` words before a listed start, and contain it."""
    listed = starts.groupBy("doc_id").agg(F.collect_set("start").alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for at, texts in blocks(batch):
                w = scan(texts)
                hashes = w.hashes()
                runs, seconds = windows(hashes, length), windows(mix(hashes ^ SECOND), length)
                rows, begins, values, others = [], [], [], []
                for i in range(len(texts)):
                    a, n = int(w.first[i]), int(w.first[i + 1] - w.first[i]) - length + 1
                    if n <= 0:
                        continue
                    listed_here = np.array(lists[at + i].as_py(), np.int64)
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, np.clip(listed_here - span, 0, n), 1)
                    np.add.at(edge, np.clip(listed_here + 1, 0, n), -1)
                    begin = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                    rows.append(np.full(len(begin), at + i))
                    begins.append(begin)
                    values.append(runs[a + begin])
                    others.append(seconds[a + begin])
                if rows:
                    row, begin, value, other = (np.concatenate(x) for x in (rows, begins, values, others))
                    cols = [pa.array(begin.astype(np.int32)), pa.array(value.view(np.int64)), pa.array((other >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), *cols], ["doc_id", "start", "h", "g"])

    return docs.join(listed, "doc_id").select("doc_id", "text", "starts").mapInArrow(run, "doc_id long, start int, h long, g int")


def longest_repeats(level: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """(doc_id, longest): ``length`` doubled until no window of the text occurs again; and the saved tables that are read.

    ``level``: distinct rows (doc_id, start, h, g) of windows of ``length`` words that occur again; two starts of one digest are two places.
    """
    spark, paths, reached, level_path = level.sparkSession, [], None, None
    while True:
        here, path = saved(level.select("doc_id", F.lit(length).cast("long").alias("longest")).distinct())
        paths.append(path)
        reached = here if reached is None else reached.union(here)
        # a window of twice the length that repeats is two repeated halves
        later = level.select("doc_id", (F.col("start") - length).alias("start"), F.col("h").alias("h2"), F.col("g").alias("g2"))
        twice = level.join(later, ["doc_id", "start"]).select("doc_id", "start", F.xxhash64("h", "h2").alias("h"), F.xxhash64("g", F.lit(7), "g2").alias("g"))
        twice, twice_path = saved(twice)
        longer, longer_path = _repeated(twice, "h", "g")
        remove(spark, twice_path, *([level_path] if level_path else []))
        level, level_path, length = longer, longer_path, length * 2
        if level.isEmpty():
            remove(spark, level_path)
            return reached.groupBy("doc_id").agg(F.max("longest").alias("longest")), paths


def _removed(docs: DataFrame, repeats: DataFrame, length: int) -> DataFrame:
    """doc_id, n_removed and sha of the rest, of texts with repeats (doc_id, list of starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(2)
            for at, texts in blocks(batch):
                w, removed, shas = scan(texts), [], []
                hashes, marks = w.hashes(), []
                for i in range(len(texts)):
                    a, b = int(w.first[i]), int(w.first[i + 1])
                    marks.append(digest(hashes[a:b]))
                    starts = np.array(lists[at + i].as_py(), np.int64)
                    starts = starts[starts <= b - a - length]  # of another row with this id
                    edge = np.zeros(b - a + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + length, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    removed.append(int(b - a - keep.sum()))
                    shas.append(_kept_sha(w, a, b, keep))
                cols = [pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), *cols, pa.array(shas, pa.string())], ["doc_id", "d1", "d2", "n_removed", "sha_left"])

    found = docs.join(repeats, "doc_id").select("doc_id", "text", "starts")
    return found.mapInArrow(run, "doc_id long, d1 long, d2 long, n_removed long, sha_left string").dropDuplicates(["doc_id", "d1", "d2"])


def remove_repeats(docs: DataFrame, length: int = 20, doc_id: str = "doc_id", text: str = "text", levels: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs; with ``levels`` also longest_repeat."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows, _ = saved(_described(source))
    firsts = rows.filter((F.col("n_words") >= length) & F.col("doc_id").isNotNull()).groupBy("d1", "d2")
    firsts, _ = saved(firsts.agg(F.min("doc_id").alias("doc_id"), (F.min("doc_id") != F.max("doc_id")).alias("copied")))
    half = max(1, length // 2)
    own = source.join(firsts.select("doc_id"), "doc_id", "left_semi")
    anchors, anchors_path = saved(_anchors(own, half, length))
    release(spark)
    survivors, survivors_path = _repeated(anchors, "h")
    remove(spark, anchors_path)
    release(spark)
    full, full_path = saved(_extended(source, survivors, length - half, length))
    remove(spark, survivors_path)
    release(spark)
    # the first places are saved before the join, as in _repeated
    first, first_path = saved(full.groupBy("h", "g").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    again = full.join(first, ["h", "g"]).filter("struct(doc_id, start) > first")
    later, later_path = saved(again.groupBy("doc_id").agg(F.collect_set("start").alias("starts")))
    remove(spark, first_path)
    longest = None
    if levels:
        distinct, distinct_path = saved(full.distinct())
        level, level_path = _repeated(distinct, "h", "g")
        reached, paths = longest_repeats(level, length)
        longest, _ = saved(reached)
        remove(spark, distinct_path, level_path, *paths)
    remove(spark, full_path)
    release(spark)
    left, _ = saved(_removed(source, later, length))
    remove(spark, later_path)
    release(spark)
    out = rows.join(firsts.withColumnRenamed("doc_id", "first_id"), ["d1", "d2"], "left").join(left, ["doc_id", "d1", "d2"], "left")
    whole = F.col("doc_id") != F.col("first_id")
    removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0)))
    sha = F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("sha_left", "sha"))
    columns = ["doc_id", "n_words", removed.cast("long").alias("n_removed"), sha.alias("kept_sha256")]
    if longest is None:
        return out.select(*columns)
    # all windows of a copied text repeat: the last doubling that it is long enough for
    top = F.expr(f"shiftleft({length}L, length(bin(n_words div {length})) - 1)")
    mine = F.when(F.col("doc_id").isNotNull() & F.col("copied"), top).otherwise(F.coalesce("longest", F.lit(0)))
    return out.join(longest, "doc_id", "left").select(*columns, mine.cast("long").alias("longest_repeat"))
