"""Recovery, filters, workload figures and scalar helpers."""

import random

import pytest
from pyspark.sql import functions as F

from kvlake.functions import config, generate, scalar
from kvlake.operators import bloom, compaction, recovery, workload, zonemap
from kvlake.schema import Corrupt, Options
from kvlake.sources.store import saved


def flagged(spark, *valid):
    return spark.createDataFrame([(i, v) for i, v in enumerate(valid)], "lsn long, valid boolean")


def test_recovery(spark):
    lsns = lambda df: [r["lsn"] for r in df.collect()]
    assert lsns(recovery.recover(flagged(spark, True, True, True), 1)) == [2]
    assert lsns(recovery.recover(flagged(spark, True, False))) == [0]
    middle = flagged(spark, True, False, True)
    with pytest.raises(Corrupt) as e:
        recovery.recover(middle)
    assert e.value.lsn == 1
    assert lsns(recovery.recover(middle, policy="truncate")) == [0]
    for policy in ("stop", "truncate"):
        with pytest.raises(Corrupt):
            recovery.recover(middle, 1, policy)
    assert [r["damage"] for df in (flagged(spark, True), flagged(spark, False), middle) for r in recovery.diagnose(df).collect()] == ["none", "torn", "mid"]
    parts = spark.createDataFrame([(1, 1, False, b"b"), (1, 0, False, b"a"), (1, 2, True, b"c"), (2, 0, False, b"x")], "entry_lsn int, part int, last boolean, data binary")
    assert [(r["entry_lsn"], bytes(r["data"])) for r in recovery.reassemble(parts).collect()] == [(1, b"abc")]


def test_bloom(spark):
    held = spark.range(2000).select(F.lit(1).alias("run"), F.concat(F.lit("k"), "id").alias("k"))
    filters = bloom.build(held)
    assert bloom.may_contain(held, filters).filter("not maybe").count() == 0
    other = spark.range(2000).select(F.lit(1).alias("run"), F.concat(F.lit("x"), "id").alias("k"))
    assert bloom.may_contain(other, filters).filter("maybe").count() < 40
    assert bloom.probes(12) == 8


def test_bloom_lookups(spark):
    """A pair is a row for each bucket that it has positions in, not for each position; filters of several buckets exclude none of their keys."""
    key = lambda letter: F.concat(F.lit(letter), "id").alias("k")
    held = spark.range(30000).select((F.col("id") % 15 == 0).cast("int").alias("run"), key("k"))  # 28,000 and 2,000 keys: eleven buckets and one
    filters, _ = saved(bloom.build(held))
    assert bloom.may_contain(held, filters).filter("not maybe").isEmpty()
    assert 0 < bloom.may_contain(spark.range(30000).select(F.lit(0).alias("run"), key("x")), filters).filter("maybe").count() < 300
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        asked = bloom.may_contain(held.filter("run = 1"), filters)
        assert len(asked.collect()) == 2000
        todo, made = [asked._jdf.queryExecution().executedPlan()], []
        while todo:
            node = todo.pop()
            todo += [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Generate":
                made.append(node.metrics().apply("numOutputRows").value())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert made == [2000]


def test_split(spark):
    rows = spark.createDataFrame([(f"k{i:02d}", "v" * 16) for i in range(20)], "k string, v string")
    got = compaction.split(rows, 128, ranges=1).collect()
    spread = compaction.split(rows, 64, ranges=3).collect()
    assert len(spread) == 20 and len({r["part"] >> 32 for r in spread}) == 3
    parts = {}
    for r in got:
        parts.setdefault(r["part"], []).append(r["k"])
    assert len(got) == 20 and len(parts) > 1
    spans = [(min(x), max(x)) for _, x in sorted(parts.items())]
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_histogram_and_percentiles(spark):
    assert [r[0] for r in spark.createDataFrame([(0,), (1,), (2,)], "x long").select(workload.bucket(F.col("x"))).collect()] == [0, 1, 71]
    df = spark.range(1, 1001).select(F.lit("a").alias("g"), F.col("id").alias("ns"))
    row = workload.percentiles(workload.histogram(df, "g", F.col("ns")), "g", {"p50": 0.5, "p100": 1.0}).select("p50", "p100").first()
    assert 500 <= row[0] <= 505 and 1000 <= row[1] <= 1010


def test_streaks_of_a_hot_group_cross_slices(spark):
    """Against a plain walk: one group holds most rows, nulls of the order come first, a null outcome is no failure."""
    r = random.Random(8)
    rows = [(1 if r.random() < 0.7 else r.randrange(2, 9), i, r.choices([True, False, None], [30, 2, 1])[0]) for i in range(900)] + [(9, None, True)]
    want = {}
    for u, _, bad in rows:
        now, best = want.get(u, (0, 0))
        now = now + 1 if bad else 0
        want[u] = now, max(best, now)
    df = spark.createDataFrame(rows, "u int, o long, bad boolean")
    for slices in (1, 5, 256):
        got = {x["u"]: (x["streak"], x["alarm"]) for x in workload.streaks(df, "u", "o", F.col("bad"), slices).collect()}
        assert got == {u: (n, n >= 10) for u, (_, n) in want.items()}
    assert workload.streaks(df.limit(0), "u", "o", F.col("bad")).count() == 0


def test_backlog_of_a_burst(spark):
    """Most requests open within a sliver of the time; one is far off."""
    r = random.Random(9)
    rows = [(a, a + r.randrange(1, 50)) for a in (r.randrange(1000) for _ in range(600))] + [(10**15, 10**15 + 5)]
    want = max(sum(x <= a <= y for x, y in rows) for a, _ in rows)
    df = spark.createDataFrame(rows, "a long, b long")
    for slots in (1, 7, 256):
        assert workload.backlog(df, F.col("a"), F.col("b"), slots).first()[0] == want
    assert workload.backlog(df.limit(0), F.col("a"), F.col("b")).first()[0] is None


def test_streaks_backlog_and_ring(spark):
    df = spark.createDataFrame([(1, i, i not in (3, 20)) for i in range(16)] + [(2, 0, False)], "u int, o int, bad boolean")
    assert {r["u"]: (r["streak"], r["alarm"]) for r in workload.streaks(df, "u", "o", F.col("bad")).collect()} == {1: (12, True), 2: (0, False)}
    spans = spark.createDataFrame([(0, 10), (5, 15), (10, 20), (30, 31)], "a long, b long")
    assert workload.backlog(spans, F.col("a"), F.col("b")).first()[0] == 3  # an open counts before a close at its time
    assert workload.ring(df, F.col("u"), "o", 5).count() == 6


def test_schedule_and_diagnosis(spark):
    assert [r["due_ns"] for r in workload.schedule(spark, 4, 3).orderBy("arrival").collect()] == [0, 250_000_000, 500_000_000]
    assert (workload.scheduled_count(10, 1.0), workload.scheduled_count(10, 0.0), workload.scheduled_count(10, 1.05)) == (10, 1, 11)
    names = "scheduled long, overrun_ns long, start_p99_ns long, max_backlog long, utilisation double, wait_ns long, max_wait_ns long"
    rows = [(9, 10**9, 0, 0, 0.9, 0, 0), (9, 10**9, 0, 0, 0.1, 10**9, 0), (9, 0, 10**8, 0, 0.1, 0, 0), (9, 0, 0, 0, 0.5, 0, 0), (0, 0, 0, 0, 0.0, 0, 0)]
    got = [r["diagnosis"] for r in workload.diagnose(spark.createDataFrame(rows, names), 1000.0).collect()]
    assert got == ["server or workers too slow for the rate", "generator limits the rate", "scheduling jitter", None, None]


def test_zone_maps(spark):
    meta = zonemap.run_meta(spark.createDataFrame([(1, "a", "x"), (1, "c", None), (2, "d", "yy")], "run int, k string, v string"))
    assert [tuple(r) for r in meta.orderBy("run").collect()] == [(1, "a", "c", 2, 3), (2, "d", "d", 1, 3)]
    assert [r["run"] for r in zonemap.range_candidates(meta, "b", "d").collect()] == [1]
    assert [r["run"] for r in zonemap.point_candidates(meta, "d").collect()] == [2]


def test_scalars(spark):
    row = spark.range(1).select(scalar.uvarint_size(F.lit(127)), scalar.uvarint_size(F.lit(128)), scalar.record_size(F.lit(3)), scalar.table_name(F.lit(7)), scalar.uvarint_size(F.lit(0))).first()
    assert tuple(row) == (1, 2, 40, "0" * 19 + "7", 1)
    newer, older = spark.range(1).select(scalar.internal_key(F.lit(b"k"), F.lit(14).cast("long"), F.lit(1)), scalar.internal_key(F.lit(b"k"), F.lit(11).cast("long"), F.lit(1))).first()
    assert bytes(newer) < bytes(older)
    for start, limit in ((b"abcdef", b"abzz"), (b"abc", b"abd"), (b"ab\xff\xffz", b"ac"), (b"apple", b"apricot"), (b"a", b"b")):
        sep = scalar.shortest_separator(start, limit)
        assert sep is None or (start <= sep < limit and len(sep) < len(start))
    assert scalar.shortest_separator(b"abcdef", b"abzz") == b"abz" or scalar.shortest_separator(b"abcdef", b"abzz") == b"abd"
    assert scalar.segment_name(1, 2) < scalar.segment_name(2, 1)
    assert (scalar.group_digits("1234567.5"), scalar.group_digits("-123"), scalar.group_digits("1e9")) == ("1,234,567.5", "-123", "1e9")
    assert [scalar.format_duration(n) for n in (-1, 5, 1500, 2_500_000, 1_500_000_000)] == ["0s", "5ns", "1.50µs", "2.50ms", "1.500s"]
    assert scalar.env_name("KV", "memtable.capacityBytes") == "KV_MEMTABLE_CAPACITY_BYTES"


def test_interval_join(spark):
    """Pairs of overlapping ranges, once each, whatever the bins; ranges of equal starts, single keys and ranges over everything."""
    r = random.Random(5)
    make = lambda n: [(i, *sorted((f"k{r.randrange(40):02d}", f"k{r.randrange(40):02d}"))) for i in range(n)] + [(n, "a", "z"), (n + 1, "k05", "k05"), (n + 1, "k05", "k05")]
    a, b = make(30), make(25)
    left, right = spark.createDataFrame(a, "i int, lo string, hi string"), spark.createDataFrame(b, "j int, from string, to string")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] <= y[2] and x[2] >= y[1])
    for bins in (1, 4, 256):
        assert sorted((p["i"], p["j"]) for p in zonemap.interval_join(left, right, "lo", "hi", "from", "to", bins).collect()) == want
    none = right.filter("j < 0")
    assert zonemap.interval_join(left, none, "lo", "hi", "from", "to").isEmpty() and zonemap.interval_join(left, none, "lo", "hi", "from", "to", semi=True).isEmpty()
    points = left.withColumn("hi", F.col("lo"))
    semi = sorted(p["i"] for p in zonemap.interval_join(points, right.filter("j < 5"), "lo", "hi", "from", "to", semi=True).collect())
    assert semi == sorted(x[0] for x in a if any(y[1] <= x[1] <= y[2] for y in b if y[0] < 5))


def test_blocks_and_separators(spark):
    rows = [(f"key{i * 7:05d}", "v" * (i % 30)) for i in range(200)]
    blocked = zonemap.blocks(spark.createDataFrame(rows, "k string, v string"), 300)
    index = zonemap.sparse_index(blocked).orderBy("block").collect()
    assert all(x["last_key"] <= x["separator"] < y["first_key"] or x["separator"] == x["last_key"] for x, y in zip(index, index[1:], strict=False))
    where = {r["k"]: r["block"] for r in blocked.collect()}
    for k in list(where)[::23]:
        assert zonemap.find_block(zonemap.sparse_index(blocked), k).first()["block"] == where[k]
    for start, limit in (("abcdef", "abzz"), ("abc", "abd"), ("apple", "apricot"), ("a", "b"), ("same", "same")):
        got = spark.range(1).select(scalar.separator(F.lit(start), F.lit(limit))).first()[0]
        assert got is None or (start <= got < limit and len(got) < len(start) and got.encode() == scalar.shortest_separator(start.encode(), limit.encode()))


def test_config():
    spec = {"server.port": ("port", "80"), "memtable.capacityBytes": ("bytes", "64MiB")}
    got = config.load(spec, "KV", {"server.port": "1", "memtable.capacityBytes": "16MiB"}, {"KV_SERVER_PORT": "2"}, {"server.port": "3"})
    assert got == {"server.port": 3, "memtable.capacityBytes": 16 << 20}
    for bad in ({"server.port": "70000"}, {"server.port": "64KiB"}, {"memtable.capacityBytes": "64MB"}, {"unknown": "1"}):
        with pytest.raises(ValueError):
            config.load(spec, "KV", bad)
    with pytest.raises(ValueError):
        Options(fanout=1)
    with pytest.raises(ValueError):
        Options(corruption="ignore")


def test_generators(spark):
    rows = {r["id"]: r["key"] for r in generate.keys(spark, 10, wrap=4).collect()}
    assert rows[3] == "0000000004" and len(rows[0]) == 36 and rows[0][14] == "4" and rows[1][14] == "7" and len(rows[2]) == 26
    assert [r["key"] for r in generate.keys(spark, 5, "seq", wrap=3).orderBy("id").collect()] == [f"{n:010d}" for n in (1, 2, 3, 1, 2)]
    body = generate.payloads(spark, 3).select(F.from_json("value", "id string, loc array<double>, ip string").alias("j")).first()["j"]
    assert len(body["loc"]) == 2 and body["ip"].count(".") == 3
