"""Synthetic keys and payloads as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("uuid4", "uuid7", "ulid", "seq", "iso")
#: The digits of base 32 without easily confused letters.
_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _hex(n: int, *salt: Column) -> Column:
    """n hex digits (32 at most) that follow from salt."""
    return F.substring(F.md5(F.concat_ws(":", *salt)), 1, n)


def keys(spark: SparkSession, count: int, kind: str = "mix", wrap: int = 0, seed: int = 0, start_ms: int = 1_700_000_000_000, prefix: str = "") -> DataFrame:
    """(id, key) of a kind of keys, or of all kinds in turn (mix); counters wrap to 1 after ``wrap``. Seeded, so reruns agree."""
    i, salt = F.col("id"), F.lit(seed)
    ms = (i + start_ms).cast("long")
    rnd = _hex(32, salt, i)
    counter = F.format_string("%010d", (F.pmod(i, F.lit(wrap)) + 1) if wrap else i + 1)
    stamp = F.lower(F.lpad(F.hex(ms), 12, "0"))
    uuid4 = F.concat_ws("-", F.substring(rnd, 1, 8), F.substring(rnd, 9, 4), F.concat(F.lit("4"), F.substring(rnd, 13, 3)), F.concat(F.lit("a"), F.substring(rnd, 16, 3)), F.substring(rnd, 19, 12))
    uuid7 = F.concat_ws("-", F.substring(stamp, 1, 8), F.substring(stamp, 9, 4), F.concat(F.lit("7"), F.substring(rnd, 13, 3)), F.concat(F.lit("a"), F.substring(rnd, 16, 3)), F.substring(rnd, 19, 12))
    digit = lambda x: F.substring(F.lit(_CROCKFORD), x.cast("int") + 1, F.lit(1))
    time = F.concat(*[digit(F.shiftrightunsigned(ms, 5 * p).bitwiseAND(31)) for p in range(9, -1, -1)])
    tail = F.concat(*[digit(F.conv(F.substring(rnd, 2 * p + 1, 2), 16, 10).cast("int").bitwiseAND(31)) for p in range(16)])
    iso = F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'000000Z'")
    made = {"uuid4": uuid4, "uuid7": uuid7, "ulid": F.concat(time, tail), "seq": counter, "iso": iso}
    if kind == "mix":
        out = made[KINDS[-1]]
        for n, k in enumerate(KINDS[:-1]):
            out = F.when(F.pmod(i, F.lit(len(KINDS))) == n, made[k]).otherwise(out)
    else:
        out = made[kind]
    return spark.range(count).select("id", F.concat(F.lit(prefix), out).alias("key"))


def payloads(spark: SparkSession, count: int, seed: int = 0) -> DataFrame:
    """(id, value): JSON objects with id, ts, ip, ua, user, loc and bio."""
    i, salt = F.col("id"), F.lit(seed)
    byte = lambda p: F.conv(F.substring(_hex(32, salt, i, F.lit("ip")), 2 * p + 1, 2), 16, 10)
    part = lambda p, span: F.conv(F.substring(_hex(32, salt, i, F.lit("loc")), 6 * p + 1, 6), 16, 10).cast("double") / 0xFFFFFF * span - span / 2
    body = F.struct(
        _hex(32, salt, i).alias("id"),
        F.date_format(F.timestamp_millis((i + 1_700_000_000_000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        F.concat_ws(".", *[byte(p) for p in range(4)]).alias("ip"),
        F.concat(F.lit("agent/"), F.pmod(i, F.lit(97))).alias("ua"),
        F.concat(F.lit("user"), F.pmod(i, F.lit(10_000))).alias("user"),
        F.array(part(0, 180.0), part(1, 360.0)).alias("loc"),
        F.repeat(_hex(32, salt, i, F.lit("bio")), 4).alias("bio"),
    )
    return spark.range(count).select("id", F.to_json(body).alias("value"))
