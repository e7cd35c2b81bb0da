"""Vectorised word scanning over batches of UTF-8 texts.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; that is
the same set of runs as the regular expression ``[^\\x20\\x09-\\x0D]+`` over
code points, because those six bytes never occur inside a multi-byte
character. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

MASK = (1 << 64) - 1
#: Bytes of text scanned at once; longer single texts make a block of their own.
BLOCK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits: xor-shift and multiply, twice."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP)
_BASE = 0xD1342543DE82EF95
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2^64, and of its inverse."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_BYTES + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


class Words:
    """The words of a block of texts, in order.

    ``data``: all bytes, one space between texts; ``start``/``end``: byte span
    of each word; ``first``: index of each text's first word, with the total
    at the end (so text i owns words first[i]..first[i+1]).
    """

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray):
        self.data, self.start, self.end, self.first = data, start, end, first

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = powers(len(self.data) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=total[1:])
            raw = (total[self.end] - total[self.start]) * down[self.start]
            return mix(raw ^ ((self.end - self.start).astype(np.uint64) * _STEP))


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def scan(texts: list[bytes], lower: bool = False) -> Words:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(data) and not space[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    return Words(data, start, end, np.searchsorted(start, begins))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(row offset, texts) pieces of a batch of about ``limit`` bytes each."""
    texts = text_bytes(batch.column(batch.schema.get_field_index(column)))
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


_ODD = [int(x) | 1 for x in mix((np.arange(64, dtype=np.uint64) + np.uint64(1000)) * _STEP)]


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive words (runs over text ends included)."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        if n > len(_ODD):  # two halves
            half = n // 2
            return mix(windows(hashes, half)[:count] * np.uint64(_ODD[0]) + windows(hashes, n - half)[half:] * np.uint64(_ODD[1]))
        total = np.zeros(count, np.uint64)
        for i in range(n):
            total += hashes[i : i + count] * np.uint64(_ODD[i])
        return mix(total)


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit digests of a sequence of 64-bit values."""
    with np.errstate(over="ignore"):
        place = (np.arange(len(values), dtype=np.uint64) + np.uint64(1)) * _STEP
        a = mix(values + place).sum(dtype=np.uint64) + np.uint64(len(values))
        b = mix(values ^ mix(place + np.uint64(7))).sum(dtype=np.uint64)
        a, b = mix(np.array([a, b], np.uint64)).view(np.int64)
    return int(a), int(b)
