"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read in overlapping windows of ``WINDOW`` words, ``STRIDE`` apart, to
its end, so passages of up to 25 words lie whole in some window. A word's input
joins a word embedding and the embeddings of all its n-grams of three to five
bytes (their sum over the root of their number), with a mark before its first
and behind its last byte, all by hash.
A forward and a backward gated recurrent layer read the window,
attention weighs the states, and a logistic unit scores their mean. The
score of a text is the largest of its windows' scores.

All inner units squash by the softsign x / (1 + |x|) in place of the hyperbolic
tangent, which is several times faster in numpy; gates map it to 0..1. Eight
hidden units a direction are enough here, as a window's verdict rests on a few of its words:
held-out accuracy is in the README.

Training sees labels of whole texts only: a text is toxic if any window is, so
the loss is a noisy-or over its windows, which lie ``TRAIN_STRIDE`` apart, so that
all words are read. Words and n-grams that only one
training text holds are not read. The training sample is bounded by
``max_train`` texts, half of each class, drawn by hash among the labelled rows that
the caller allows; whole texts are used. The model is a few hundred kilobytes
and is broadcast. Scores depend on the text alone.

Null and empty texts have one window without words and get the score of the
bias alone. Repeated rows are scored alike. Labels that are null are not used;
without labels of both classes every score is 0. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvlake.llm.store import small_batches
from kvlake.llm.words import blocks, mix, scan

WINDOW, STRIDE, TRAIN_STRIDE = 32, 8, 24
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 8, 8, 8, 8
N_GRAMS = (3, 4, 5)
PLACES = 1 << 18  # n-grams looked up at once
THRESHOLD = 0.3

_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
ONE, HALF = np.float32(1), np.float32(0.5)
GATES = "zrn"


def _grams(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places x N_GRAMS rows of n-grams, the word of each place) of words given by first byte and size, with a mark before and behind each.

    A row is the n-gram of each size that begins at the place, or CHAR_ROWS where the word ends before it does.
    """
    owner = np.repeat(np.arange(len(size)), size + 2)
    inside = np.arange(len(owner)) - (np.cumsum(size + 2) - size - 2)[owner]
    left = (size + 2)[owner] - inside
    marked = np.full(len(owner) + max(N_GRAMS), 257, np.uint64)
    within = (inside > 0) & (left > 1)
    marked[: len(owner)][within] = data[(start[owner] + inside - 1)[within]]
    marked[: len(owner)][inside == 0] = 256
    rows = np.empty((len(owner), len(N_GRAMS)), np.int32, order="F")
    with np.errstate(over="ignore"):
        h = np.zeros(len(owner), np.uint64)
        for i in range(max(N_GRAMS)):  # the hash of a longer n-gram continues that of a shorter one
            h = h * np.uint64(0x100000001B3) + marked[i : i + len(owner)]
            if i + 1 in N_GRAMS:
                rows[:, N_GRAMS.index(i + 1)] = np.where(left > i, mix(h + np.uint64(i)) % np.uint64(CHAR_ROWS), CHAR_ROWS)
    return rows, owner


@dataclass
class Ids:
    """Embedding rows of distinct words."""

    word: np.ndarray
    grams: np.ndarray  # of all places of all words
    owner: np.ndarray  # the word of each place
    root: np.ndarray  # square root of each word's number of n-grams, one at least

    def __len__(self) -> int:
        return len(self.word)


def word_ids(texts: list[bytes]) -> tuple[Ids, np.ndarray, np.ndarray]:
    """(ids of distinct words, index of each word in them, first word of each text)."""
    w = scan(texts, lower=True)
    start, end = w.start.copy(), w.end.copy()
    for _ in range(3):  # trim marks around a word
        start += (start < end) & ~_ALNUM[w.data[start]]
        end -= (start < end) & ~_ALNUM[w.data[end - 1]]
    w.start, w.end = start, end
    hashes = w.hashes()
    distinct, at, index = np.unique(hashes, return_index=True, return_inverse=True)
    grams, owner = _grams(w.data, start[at], end[at] - start[at])
    count = np.bincount(owner, weights=(grams < CHAR_ROWS).sum(axis=1), minlength=len(distinct))
    return Ids((distinct % np.uint64(WORD_ROWS)).astype(np.int64), grams, owner, np.sqrt(np.maximum(count, 1)).astype(np.float32)), index, w.first


def window_words(index: np.ndarray, first: np.ndarray, none: int, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW of word indexes, padded with ``none``; first window of each text). Every text has a window."""
    n = first[1:] - first[:-1]
    count = np.maximum(1, -(-(n - WINDOW) // stride) + 1)
    begins = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    offset = (np.arange(begins[-1]) - begins[text]) * stride
    at = offset[:, None] + np.arange(WINDOW)[None, :]
    inside = at < n[text][:, None]
    padded = np.append(index, none)
    return np.where(inside, padded[np.minimum(first[text][:, None] + at, len(index))], none), begins[:-1]


def _sign(x: np.ndarray) -> np.ndarray:
    """Softsign x / (1 + |x|), in place: the squashing function of all inner units."""
    x /= np.abs(x) + ONE
    return x


def _slope(s: np.ndarray) -> np.ndarray:
    """Derivative of the softsign where its value is s."""
    return np.square(ONE - np.abs(s))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return HALF * (np.tanh(HALF * x) + ONE)


class Network:
    """Parameters by name; the two directions share none."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        normal = lambda *s, scale=0.1: (r.standard_normal(s) * scale).astype(np.float32)
        size = WORD_DIM + CHAR_DIM
        self.p = {"word": np.zeros((WORD_ROWS, WORD_DIM), np.float32) + normal(WORD_ROWS, WORD_DIM, scale=0.01), "char": normal(CHAR_ROWS, CHAR_DIM, scale=0.2)}
        for d in (d + g for d in "fb" for g in GATES):
            self.p |= {f"x{d}": normal(size, HIDDEN, scale=0.3), f"h{d}": normal(HIDDEN, HIDDEN, scale=0.3), f"c{d}": np.zeros(HIDDEN, np.float32)}
        self.p |= {"a": normal(2 * HIDDEN, ATTEND, scale=0.3), "v": normal(ATTEND, scale=0.3), "o": normal(2 * HIDDEN, scale=0.3), "z": np.full(1, -4, np.float32)}

    def inputs(self, ids: Ids, keep: np.ndarray | None = None) -> np.ndarray:
        """Input vectors of distinct words; the last row, for padding, is zero."""
        word = self.p["word"][ids.word]
        if keep is not None:
            word = word * keep[:, None]
        chars, table = np.zeros((len(ids), CHAR_DIM), np.float32), np.append(self.p["char"], np.zeros((1, CHAR_DIM), np.float32), axis=0)
        for at in range(0, len(ids.owner), PLACES):
            owner = ids.owner[at : at + PLACES]
            edge = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
            some = ids.grams[at : at + PLACES]
            here = table.take(some[:, 0], axis=0)
            for k in range(1, len(N_GRAMS)):
                here += table.take(some[:, k], axis=0)
            chars[owner[edge]] += np.add.reduceat(here, edge)
        chars /= ids.root[:, None]
        return np.concatenate([np.concatenate([word, chars], axis=1), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])

    def forward(self, x: np.ndarray, words: np.ndarray, keep: bool = False):
        """Logit of each window. x: inputs of distinct words; words: windows x WINDOW."""
        kept = {}
        by_time = np.ascontiguousarray(words.T)
        both = np.empty((WINDOW, len(words), 2 * HIDDEN), np.float32)
        for k, d in enumerate("fb"):
            wide = [x @ self.p[f"x{d}{g}"] + self.p[f"c{d}{g}"] for g in GATES]
            uz, ur, un = (self.p[f"h{d}{g}"] for g in GATES)
            h, steps = np.zeros((len(words), HIDDEN), np.float32), []
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                gz, gr, gn = (w.take(by_time[t], axis=0) for w in wide)
                z, r, inner = _sign(gz + h @ uz), _sign(gr + h @ ur), h @ un
                z *= HALF
                z += HALF
                r *= HALF
                r += HALF
                n = _sign(gn + r * inner)
                if keep:
                    steps.append((t, h, z, r, n, inner))
                h = h - n
                h *= z
                h += n
                both[t, :, k * HIDDEN : (k + 1) * HIDDEN] = h
            kept[d] = steps
        lit = _sign((both.reshape(-1, 2 * HIDDEN) @ self.p["a"]).reshape(WINDOW, len(words), ATTEND))
        e = lit @ self.p["v"]
        pad = by_time == len(x) - 1
        empty = pad.all(axis=0)
        e[pad & ~empty] = -1e9
        e -= e.max(axis=0)
        weight = np.exp(e)
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", weight, both)
        pooled[empty] = 0
        logit = pooled @ self.p["o"] + self.p["z"]
        return (logit, kept, both, lit, weight, pooled, empty) if keep else logit

    def gradients(self, ids: Ids, words: np.ndarray, first: np.ndarray, label: np.ndarray, keep: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean noisy-or loss over texts, and its gradients."""
        p = self.p
        x = self.inputs(ids, keep)
        logit, kept, both, lit, weight, pooled, empty = self.forward(x, words, keep=True)
        prob = _sigmoid(logit)
        none = np.add.reduceat(-np.logaddexp(0, logit), first)  # log of no window being toxic
        odd = np.clip(-np.expm1(none), 1e-6, None)
        loss = np.where(label == 1, -np.log(odd), -none)
        text = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
        slope = np.where(label == 1, -np.exp(none) / odd, 1.0)
        dlogit = (prob * slope[text] / len(first)).astype(np.float32)
        g = {"z": dlogit.sum(keepdims=True), "o": dlogit @ pooled}
        dpool = dlogit[:, None] * p["o"]
        dpool[empty] = 0
        dboth = weight[:, :, None] * dpool[None]
        dw = np.einsum("bh,tbh->tb", dpool, both)
        de = weight * (dw - (weight * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tba->a", de, lit)
        dlit = de[:, :, None] * p["v"] * _slope(lit)
        g["a"] = np.tensordot(both, dlit, ((0, 1), (0, 1)))
        dboth += dlit @ p["a"].T
        dx = np.zeros_like(x)
        flat = words.T
        for d, part in (("f", dboth[:, :, :HIDDEN]), ("b", dboth[:, :, HIDDEN:])):
            dwide = {k: np.zeros((len(x), HIDDEN), np.float32) for k in GATES}
            for k in GATES:
                g[f"h{d}{k}"], g[f"c{d}{k}"] = np.zeros((HIDDEN, HIDDEN), np.float32), np.zeros(HIDDEN, np.float32)
            dh = np.zeros((len(words), HIDDEN), np.float32)
            for t, h, z, r, n, inner in reversed(kept[d]):
                dh = dh + part[t]
                dn = dh * (1 - z) * _slope(n)
                dz = dh * (h - n) * HALF * _slope(2 * z - 1)
                dr = dn * inner * HALF * _slope(2 * r - 1)
                dh = dh * z
                for k, outer, back in (("z", dz, dz), ("r", dr, dr), ("n", dn, dn * r)):
                    g[f"h{d}{k}"] += h.T @ back
                    g[f"c{d}{k}"] += outer.sum(axis=0)
                    np.add.at(dwide[k], flat[t], outer)
                    dh += back @ p[f"h{d}{k}"].T
            for k in GATES:
                g[f"x{d}{k}"] = x.T @ dwide[k]
                dx += dwide[k] @ p[f"x{d}{k}"].T
        dx = dx[:-1]
        g["word"] = (ids.word, dx[:, :WORD_DIM] * keep[:, None])
        real = ids.grams < CHAR_ROWS
        g["char"] = (ids.grams[real], (dx[:, WORD_DIM:] / ids.root[:, None])[np.broadcast_to(ids.owner[:, None], real.shape)[real]])
        return float(loss.mean()), g

    def keep_common(self, texts: list[bytes], least: int = 2) -> dict[str, np.ndarray]:
        """Which rows of the embeddings ``least`` texts share; all others become zero, as what one text alone holds cannot tell about others."""
        seen = {"word": np.zeros(WORD_ROWS, np.int32), "char": np.zeros(CHAR_ROWS, np.int32)}
        for t in texts:
            ids, _, _ = word_ids([t])
            seen["word"][np.unique(ids.word)] += 1
            seen["char"][np.unique(ids.grams[ids.grams < CHAR_ROWS])] += 1
        common = {k: n >= least for k, n in seen.items()}
        for k, some in common.items():
            self.p[k][~some] = 0
        return common

    def fit(self, texts: list[bytes], labels: list[int], steps: int = 260, batch: int = 24, rate: float = 0.03, seed: int = 5) -> list[float]:
        """Adam over shuffled batches of whole texts, for as many epochs as make ``steps``; half of the words hide their word embedding, so that characters count. Mean loss of each epoch."""
        r, y = np.random.default_rng(seed), np.array(labels)
        common = self.keep_common(texts)
        first, second, step, losses = {}, {}, 0, []
        n = max(1, len(texts) // batch)
        for _ in range(-(-steps // n)):
            seen = []
            for chosen in np.array_split(r.permutation(len(texts)), n):
                ids, index, begins = word_ids([texts[i] for i in chosen])
                words, starts = window_words(index, begins, len(ids), TRAIN_STRIDE)
                loss, g = self.gradients(ids, words, starts, y[chosen], (r.random(len(ids)) < 0.5).astype(np.float32))
                seen.append(loss)
                step += 1
                grow = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for k, d in g.items():
                    if isinstance(d, tuple):
                        rows, place = np.unique(d[0], return_inverse=True)
                        order = np.argsort(place, kind="stable")
                        d = np.add.reduceat(d[1][order], np.searchsorted(place[order], np.arange(len(rows))))
                    else:
                        rows = slice(None)
                    if k in common:
                        d = d * common[k][rows][:, None]
                    m, v = first.setdefault(k, np.zeros_like(self.p[k])), second.setdefault(k, np.zeros_like(self.p[k]))
                    m[rows] = 0.9 * m[rows] + 0.1 * d
                    v[rows] = 0.999 * v[rows] + 0.001 * d * d
                    self.p[k][rows] -= grow * m[rows] / (np.sqrt(v[rows]) + 1e-8)
            losses.append(float(np.mean(seen)))
        return losses

    def score(self, texts: list[bytes], chunk: int = 1024) -> np.ndarray:
        """Largest window score of each text."""
        ids, index, begins = word_ids(texts)
        words, starts = window_words(index, begins, len(ids))
        x = self.inputs(ids)
        logit = np.concatenate([self.forward(x, words[i : i + chunk]) for i in range(0, len(words), chunk)])
        return _sigmoid(np.maximum.reduceat(logit, starts).astype(np.float32)).astype(float)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int, allowed: Column, doc_id: str, text: str) -> tuple[list[bytes], list[int]]:
    """At most max_train labelled texts, half of each class, drawn by hash among ``allowed`` label rows."""
    spark = docs.sparkSession
    usable = labels.filter(allowed & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = [r for y in (0, 1) for r in usable.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train // 2).collect()]
    if not drawn:
        return [], []
    wanted = spark.createDataFrame([(int(r["doc_id"]), int(r["toxic"])) for r in drawn], "__id long, __toxic int")
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).join(F.broadcast(wanted), "__id")
    got = sorted((r["__id"], r["__toxic"], r["__text"] or "") for r in rows.collect())
    return [t.encode() for _, _, t in got], [y for _, y, _ in got]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 2000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with columns held_out, score and predicted; labels: doc_id, toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    texts, y = training_rows(docs, labels, max_train, ~held_out(F.col("doc_id")), doc_id, text)
    model = None
    if len(set(y)) == 2:
        net = Network()
        net.fit(texts, y)
        model = net.p
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network.__new__(Network)
        net.p = sent.value
        for series in batches:
            if net.p is None:
                yield pd.Series(np.zeros(len(series)))
                continue
            column = pa.RecordBatch.from_arrays([pa.array(series, pa.string(), from_pandas=True)], ["text"])
            parts = [net.score(t) for _, t in blocks(column, "text", 1 << 20)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    out = docs.withColumn("held_out", held_out(F.col(doc_id))).withColumn("score", scored(F.col(text)))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
