"""Fixed schemas, limits and engine options."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import types as T

SET, DELETE = 1, 2
ADD, REMOVE, CHECKPOINT = 1, 2, 3

MAX_KEY_BYTES = 4096
MAX_VALUE_BYTES = 4 << 20
LEVELS = 5

OPLOG = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("seq", T.LongType()), T.StructField("op", T.IntegerType()), T.StructField("value", T.BinaryType())])
#: The op log with a checksum of each record, as log batches are stored.
LOGGED = T.StructType([*OPLOG.fields, T.StructField("crc", T.LongType())])
TABLE = T.StructType(
    [
        T.StructField("ver", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("lvl", T.IntegerType()),
        T.StructField("path", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("minKey", T.BinaryType()),
        T.StructField("maxKey", T.BinaryType()),
        T.StructField("keys", T.LongType()),
        T.StructField("sizeBytes", T.LongType()),
    ]
)


class KvError(Exception):
    """Base of all engine errors."""


class KeyTooLarge(KvError):
    pass


class ValueTooLarge(KvError):
    pass


class EmptyKey(KvError):
    pass


class ReadOnly(KvError):
    """A log write failed; the engine only reads until it is opened again."""


class NotStarted(KvError):
    pass


class Corrupt(KvError):
    """A damaged record that the policy does not allow to cut; lsn says where."""

    def __init__(self, message: str, lsn: int | None = None):
        super().__init__(message)
        self.lsn = lsn


class Locked(KvError):
    """Another engine holds the folder."""


class BelowHorizon(KvError):
    """An as-of read below the newest flushed sequence: older versions may be gone."""


@dataclass(frozen=True)
class Options:
    """Engine options. Defaults are fixed values of the storage model.

    ``memtable_bytes``: log batches of this size together are one unit of flushing; ``cached_immutables`` full units stay in the log.
    ``segment_bytes``: size of the files a log batch is written in. ``corruption``: what recovery does with damage in mid-log, stop or truncate.
    """

    batch_requests: int = 128
    memtable_bytes: int = 64 << 20
    cached_immutables: int = 1
    l0_trigger: int = 4
    fanout: int = 10
    l1_target_bytes: int = 256 << 20
    table_bytes: int = 64 << 20
    segment_bytes: int = 64 << 20
    stale_records: int = 1024
    bloom_bits_per_key: int = 12
    corruption: str = "stop"

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "corruption":
                if value not in ("stop", "truncate"):
                    raise ValueError(f"corruption {value!r}: neither stop nor truncate")
            elif value < (0 if f.name == "cached_immutables" else 1):
                raise ValueError(f"{f.name} must be positive, not {value}")
        if self.fanout < 2:
            raise ValueError("fanout must be 2 at least")
        if self.memtable_bytes < MAX_KEY_BYTES + MAX_VALUE_BYTES:
            raise ValueError("memtable_bytes cannot hold the largest record")
