"""Scalar helpers: sizes, names, separators, units, formats, internal keys."""

from __future__ import annotations

import base64
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

RECORD_HEADER = 30
PAGE = 4096
#: Fixed values of the FNV-1a hash: its basis, and its prime less 2^40.
FNV_BASIS, FNV_SMALL = 14695981039346656037, 435


def uvarint_size(x: Column) -> Column:
    """Bytes of x as a base-128 varint."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("int")


def align(x: Column, to: int) -> Column:
    return (F.ceil(x / to) * to).cast("long")


def record_size(payload: Column) -> Column:
    """Framed size of a log record: header and payload, up to eight bytes."""
    return align(payload + RECORD_HEADER, 8)


def checksum(data: Column) -> Column:
    """CRC-32 of a record (Spark's polynomial; files are not byte-compatible with others)."""
    return F.crc32(data)


def fnv1a_shard(key: Column, shards: int) -> Column:
    """The 64-bit FNV-1a hash of a key's bytes, unsigned, modulo ``shards``. Held in two 32-bit halves, as 64-bit products would overflow."""
    mask = (1 << 32) - 1
    low, high = FNV_BASIS & mask, FNV_BASIS >> 32

    def step(h: Column, i: Column) -> Column:
        octet = F.conv(F.hex(F.substring(key.cast("binary"), i, F.lit(1))), 16, 10).cast("long")
        lo = h["lo"].bitwiseXOR(octet)
        # the prime is 2^40 + FNV_SMALL
        small = lo * FNV_SMALL
        hi = h["hi"] * FNV_SMALL + F.shiftright(small, 32) + F.shiftleft(lo, 8).bitwiseAND(mask)
        return F.struct(hi.bitwiseAND(mask).alias("hi"), small.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(high).cast("long").alias("hi"), F.lit(low).cast("long").alias("lo"))
    places = F.when(F.octet_length(key) > 0, F.sequence(F.lit(1), F.octet_length(key))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, step, lambda h: (h["hi"] % shards * ((1 << 32) % shards) + h["lo"] % shards) % shards)


def table_name(table_id: Column) -> Column:
    return F.lpad(table_id.cast("string"), 20, "0")


def segment_name(millis: int, segment: int) -> str:
    """Names of log segments: base-32 of 48 bits of time and 32 bits of id, which sort by time."""
    return base64.b32hexencode((millis % (1 << 48)).to_bytes(6, "big") + segment.to_bytes(4, "big")).decode() + ".log"


def internal_key(key: Column, seq: Column, op: Column) -> Column:
    """Bytes that show (key, seq, op): key, a zero byte, inverted seq and op, so that newer versions of a key sort first. Shown only; sorts use the columns."""
    inverted = F.unhex(F.lpad(F.hex(F.bitwise_not(seq)), 16, "0"))
    return F.concat(key, F.lit(b"\x00"), inverted, F.unhex(F.lpad(F.hex(F.lit(255) - op), 2, "0")))


def shortest_separator(start: bytes, limit: bytes) -> bytes | None:
    """The shortest key k with start <= k < limit that is shorter than start; None if there is none."""
    for n in range(1, len(start)):
        head = start[:n]
        if limit[:n] > head:
            # a proper prefix of the limit, else the least prefix above start that stays below the limit
            if len(limit) > n:
                return limit[:n]
        if head[-1] < 0xFF:
            raised = head[:-1] + bytes([head[-1] + 1])
            if start < raised < limit:
                return raised
    return None


def separator(start: Column, limit: Column) -> Column:
    """shortest_separator for text keys as an expression, where a prefix of the limit serves; null elsewhere."""
    places = F.sequence(F.lit(1), F.greatest(F.least(F.length(start), F.length(limit)), F.lit(1)))
    differs = F.filter(places, lambda i: F.substring(start, i, F.lit(1)) != F.substring(limit, i, F.lit(1)))
    at = F.get(differs, F.lit(0))
    fits = (F.size(differs) > 0) & (at < F.length(start)) & (at < F.length(limit)) & (start < limit)
    return F.when(fits, F.substring(limit, F.lit(1), at))


#: Binary units by suffix.
UNITS = {"TiB": 40, "GiB": 30, "MiB": 20, "KiB": 10, "B": 0}


def parse_bytes(text: str) -> int:
    """``16MiB`` as a number; a bare number is bytes. Rejects other units, signs, fractions and numbers over 64 bits."""
    unit = next((u for u in UNITS if text.endswith(u)), "")
    number = text.removesuffix(unit).strip() if unit else text
    if not re.fullmatch("[0-9]+", number):
        raise ValueError(f"not a size: {text!r}")
    out = int(number) << UNITS.get(unit, 0)
    if out >= 1 << 64:
        raise ValueError(f"out of range: {text!r}")
    return out


def env_name(prefix: str, path: str) -> str:
    """memtable.capacityBytes as PREFIX_MEMTABLE_CAPACITY_BYTES."""
    return f"{prefix}_" + re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", path).replace(".", "_").upper()


def group_digits(number: str) -> str:
    """Thousands separators in a formatted number; exponents stay as they are."""
    if "e" in number.lower():
        return number
    return re.sub(r"^([+-]?\d+)", lambda m: re.sub(r"(?<=\d)(?=(\d{3})+$)", ",", m[1]), number)


def format_duration(ns: int) -> str:
    if ns <= 0:
        return "0s"
    for limit, unit, places in ((10**3, "ns", 0), (10**6, "µs", 2), (10**9, "ms", 2)):
        if ns < limit:
            return f"{ns / (limit / 1000):.{places}f}{unit}"
    return f"{ns / 1e9:.3f}s"
