"""Media columns: signature sniffing with an Aho-Corasick automaton and format validators.

``sniff`` scans stored bytes once for the magic numbers of all known formats;
at each hit the format's validator checks the structure that follows and
says how long the object is. A hit whose validator fails is ignored, so
magic bytes that occur by chance do not count. The first confirmed object at
offset 0 corrects the declared type; confirmed objects further on are carved
as embedded media. Objects do not overlap: the earliest start wins, at equal
starts the longest.

``store`` packs an arbitrary payload losslessly as 8-bit samples of one of the
formats; ``load`` reads the samples back from stored bytes.

A null or empty text has a payload of 192 spaces; null media bytes have no
type and no embedded objects. Values depend on the text alone, so equal texts
have equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kvlake.llm.store import small_batches

UNIT = 192
RATE = 8000


# -- writers: payload length is a multiple of 192 ------------------------------------------------------------------------------


def _wav(payload: bytes) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def _bmp(payload: bytes) -> bytes:
    width, height = UNIT, len(payload) // UNIT
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    begin = 14 + 40 + len(palette)
    head = b"BM" + struct.pack("<IHHI", begin + len(payload), 0, 0, begin)
    return head + struct.pack("<IiiHHIIiiII", 40, width, -height, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette + payload


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def _png(payload: bytes) -> bytes:
    width, height = UNIT, len(payload) // UNIT
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def _pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (UNIT, len(payload) // UNIT) + payload


# -- validators: (bytes, start) -> length of the object, or 0 -------------------------------------------------------------------


def _is_wav(b: bytes, at: int) -> int:
    if len(b) < at + 44 or b[at + 8 : at + 16] != b"WAVEfmt ":
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0]
    if size < 36 or at + 8 + size > len(b):
        return 0
    p, found = at + 12, False
    while p + 8 <= at + 8 + size:
        kind, n = b[p : p + 4], struct.unpack_from("<I", b, p + 4)[0]
        found |= kind == b"data"
        p += 8 + n + (n & 1)
    return size + 8 if found and p - (at + 8 + size) in (0, 1) else 0


def _is_bmp(b: bytes, at: int) -> int:
    if len(b) < at + 54:
        return 0
    size, zero, begin, head, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if zero or head != 40 or planes != 1 or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        return 0
    rows = (width * depth + 31) // 32 * 4 * abs(height)
    return size if begin >= 54 and begin + rows == size and at + size <= len(b) else 0


def _is_png(b: bytes, at: int) -> int:
    p, seen = at + 8, []
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or zlib.crc32(memoryview(b)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return 0
        seen.append(kind)
        p += 12 + n
        if kind == b"IEND":
            return p - at if seen[0] == b"IHDR" and b"IDAT" in seen else 0
    return 0


def _is_pgm(b: bytes, at: int) -> int:
    parts = b[at : at + 40].split(b"\n", 3)
    if len(parts) < 4 or parts[2] != b"255":
        return 0
    numbers = parts[1].split(b" ")
    if len(numbers) != 2 or not all(x.isdigit() and len(x) < 10 for x in numbers):
        return 0
    n = sum(len(x) + 1 for x in parts[:3]) + int(numbers[0]) * int(numbers[1])
    return n if int(numbers[0]) and at + n <= len(b) else 0


def _is_gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    images = 0
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at if images else 0
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            images += 1
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return 0
    return 0


#: Media types by magic bytes.
SIGNATURES = {
    b"RIFF": ("audio/wav", _is_wav),
    b"BM": ("image/bmp", _is_bmp),
    b"\x89PNG\r\n\x1a\n": ("image/png", _is_png),
    b"P5\n": ("image/x-portable-graymap", _is_pgm),
    b"GIF87a": ("image/gif", _is_gif),
    b"GIF89a": ("image/gif", _is_gif),
}
WRITERS = {"audio/wav": _wav, "image/bmp": _bmp, "image/png": _png, "image/x-portable-graymap": _pgm}
KINDS = list(WRITERS)


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic in SIGNATURES:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def sniff(data: bytes | None, found_by: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """Confirmed, non-overlapping objects as (start, length, type)."""
    hits = []
    for end, magic in found_by.iter((data or b"").decode("latin-1")):
        hits.append((end + 1 - len(magic), magic))
    out, free = [], 0
    for start, magic in sorted(hits, key=lambda h: (h[0], -len(h[1]))):
        if start < free:
            continue
        kind, length_of = SIGNATURES[magic]
        if n := length_of(data, start):
            out.append((start, n, kind))
            free = start + n
    return out


def store(payload: bytes, kind: str) -> bytes:
    return WRITERS[kind](payload)


def load(data: bytes, kind: str) -> bytes:
    """Samples of one stored object of the given type, in payload order."""
    if kind == "audio/wav":
        n = struct.unpack_from("<I", data, 40)[0]
        return data[44 : 44 + n]
    if kind == "image/bmp":
        return data[struct.unpack_from("<I", data, 10)[0] :]
    if kind == "image/png":
        width, height = struct.unpack_from(">II", data, 16)
        p, packed = 8, []
        while p < len(data):
            n, name = struct.unpack_from(">I4s", data, p)
            if name == b"IDAT":
                packed.append(data[p + 8 : p + 8 + n])
            p += 12 + n
        return np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()
    if kind == "image/x-portable-graymap":
        return data[sum(len(x) + 1 for x in data[:40].split(b"\n", 3)[:3]) :]
    raise ValueError(kind)


def correct_types(media: DataFrame, data: str = "data", declared: str = "declared") -> DataFrame:
    """Add actual (type found at offset 0, null if none), mismatch and embedded (array of start, length, type) to each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = automaton()
        for batch in batches:
            found = [sniff(x, found_by) for x in batch.column(data).to_pylist()]
            actual = [f[0][2] if f and f[0][0] == 0 else None for f in found]
            said = batch.column(declared).to_pylist()
            embedded = [[{"start": s, "length": n, "type": k} for s, n, k in f if s] for f in found]
            more = {
                "actual": pa.array(actual, pa.string()),
                "mismatch": pa.array([a is not None and a != d for a, d in zip(actual, said, strict=True)]),
                "embedded": pa.array(embedded, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))),
            }
            keep = [n for n in batch.schema.names if n not in more]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], *more.values()], [*keep, *more])

    from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

    names = ("actual", "mismatch", "embedded")
    item = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("type", StringType())])
    kinds = (StringType(), BooleanType(), ArrayType(item))
    schema = StructType([*[f for f in media.schema.fields if f.name not in names], *[StructField(n, k) for n, k in zip(names, kinds, strict=True)]])
    return media.mapInArrow(run, schema)


def text_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text stored as a media object, sniffed, carved and read back.

    The stored bytes are the object; its declared type is wrong for one text
    in four, and the sniffed type is the one that reads it. feature:
    type, whether it was corrected, embedded objects, mean and largest sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_by = automaton()
        for batch in batches:
            ids, rows = batch.column(0), []
            for t in batch.column(1).cast(pa.large_binary()):
                raw = t.as_py() or b""
                payload = raw + b" " * ((-len(raw)) % UNIT if raw else UNIT)
                code = zlib.crc32(raw)
                kind = KINDS[code % 4]
                declared = kind if code // 4 % 4 else KINDS[(code + 1) % 4]
                media = store(payload, kind)
                start, length, actual = sniff(media, found_by)[0]
                back = load(media[start : start + length], actual)
                inner = len(sniff(back, found_by))
                mean = int(np.frombuffer(back, np.uint8).sum(dtype=np.int64)) // len(back)
                feature = f"{actual};declared={declared};corrected={int(declared != actual)};embedded={inner};mean={mean};max={max(back)}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["doc_id", *names])

    small_batches(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(run, schema)
