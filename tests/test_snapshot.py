"""Newest-version reads against stated lists and a dictionary model."""

import random

import pytest
from pyspark.sql import functions as F

from kvlake.operators import snapshot
from kvlake.schema import OPLOG, EmptyKey, KeyTooLarge, ValueTooLarge
from kvlake.sources import oplog


def log(spark, *rows):
    """Rows as key, seq and value; no value is a delete."""
    return spark.createDataFrame([(k.encode(), s, 1 if v is not None else 2, v.encode() if v is not None else None) for k, s, v in rows], OPLOG)


def pairs(df):
    return [(bytes(r["key"]).decode(), r["value"] and bytes(r["value"]).decode()) for r in df.collect()]


RANGE = [("b", 1, "b1"), ("a", 2, "a1"), ("b", 3, "b2"), ("c", 4, "c1"), ("a", 5, None)]


def test_ranges(spark):
    df = log(spark, *RANGE)
    assert pairs(snapshot.scan(df)) == [("b", "b2"), ("c", "c1")]
    assert pairs(snapshot.scan(df, b"b", b"c")) == [("b", "b2")]
    assert pairs(snapshot.scan(df, b"b", b"b")) == []
    assert pairs(snapshot.scan(df, b"c", b"b")) == []
    assert pairs(snapshot.scan(df, limit=1)) == [("b", "b2")]


def test_point_reads(spark):
    df = log(spark, ("test", 1, "val"), ("test", 2, "val2"), ("test", 3, "val3"))
    assert snapshot.point(snapshot.get(df, b"test")) == (b"val3", True)
    gone = df.unionByName(log(spark, ("test", 4, None)))
    assert snapshot.point(snapshot.get(gone, b"test")) == (None, False)
    assert snapshot.point(snapshot.get(gone, b"test", read_seq=2)) == (b"val2", True)
    assert snapshot.point(snapshot.get(df, b"x" * 4097)) == (None, False)


def test_snapshots(spark):
    df = log(spark, ("a", 9, "a9"), ("b", 6, None), ("c", 4, "c4"), ("a", 5, "a5"), ("b", 3, "b3"), ("c", 2, "c2"))
    assert pairs(snapshot.scan(df, read_seq=7)) == [("a", "a5"), ("c", "c4")]
    kept = snapshot.latest(df, drop_tombstones=False).orderBy("key")
    assert pairs(kept) == [("a", "a9"), ("b", None), ("c", "c4")]


def test_merge_order(spark):
    runs = [log(spark, ("a", 3, "x"), ("c", 1, "x")), log(spark, ("a", 2, "x"), ("b", 5, "x")), log(spark)]
    assert [(bytes(r["key"]).decode(), r["seq"]) for r in snapshot.merge(runs).collect()] == [("a", 3), ("a", 2), ("b", 5), ("c", 1)]


def test_order_is_bytewise(spark):
    df = log(spark, ("a\0", 1, "2"), ("a", 2, "1"), ("é", 3, "4"), ("z", 4, "3"))
    assert [v for _, v in pairs(snapshot.scan(df))] == ["1", "2", "3", "4"]


def test_seek_and_iterate(spark):
    df = log(spark, ("a", 1, "a"), ("c", 2, "c"), ("e", 3, "e"))
    found = {k: pairs(snapshot.seek(df, k)) for k in (b"0", b"c", b"b", b"z", None)}
    assert found == {b"0": [("a", "a")], b"c": [("c", "c")], b"b": [("c", "c")], b"z": [], None: [("a", "a")]}
    assert [k for k, _ in pairs(snapshot.iterate(df, b"c", b"e"))] == ["c", "e"]


def test_limits():
    oplog.check(b"k" * 4096, b"v" * (4 << 20))
    oplog.check(b"k", b"")
    for error, key, value in ((EmptyKey, b"", b"v"), (KeyTooLarge, b"k" * 4097, b""), (ValueTooLarge, b"k", b"v" * ((4 << 20) + 1))):
        with pytest.raises(error):
            oplog.check(key, value)


def test_numbered_is_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("seq"))
    got = [(r["ord"], r["k"], r["seq"]) for r in snapshot.numbered(df, F.col("k"), F.col("seq").desc()).orderBy("ord").collect()]
    want = sorted(((i % 7, i) for i in range(1000)), key=lambda x: (x[0], -x[1]))
    assert got == [(n + 1, k, s) for n, (k, s) in enumerate(want)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_model(spark, seed):
    r = random.Random(seed)
    rows = [(f"k{r.randrange(30):02d}", i + 1, None if r.random() < 0.3 else f"v{i}") for i in range(400)]
    at = r.randrange(400)
    for seq in (400, at):
        model = {}
        for k, s, v in rows:
            if s <= seq:
                model[k] = v
        assert pairs(snapshot.scan(log(spark, *rows), read_seq=seq)) == sorted((k, v) for k, v in model.items() if v is not None)


def test_batches_round_trip(spark):
    df = oplog.batches(log(spark, *RANGE), 2)
    back = oplog.decode_batches(oplog.encode_batches(df))
    key = lambda x: sorted(map(str, x.select("batch", "key", "seq", "op", "value").collect()))
    assert key(back) == key(df)
