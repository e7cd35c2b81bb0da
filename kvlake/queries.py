"""The engine's queries over the driver's tables, and the same queries as DuckDB SQL.

The op log is derived from ``events`` (oplog.from_events): run = 1,000 sequences, batch = 128. Levels are thirds of the table's
runs by age, however many there are: the newest third is level 0, the oldest level 2. Parameters are stated once, below.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kvlake.functions import config, generate, scalar
from kvlake.operators import bloom, compaction, recovery, snapshot, workload, zonemap
from kvlake.plans import load
from kvlake.plans.engine import Engine
from kvlake.schema import ADD, REMOVE, Options
from kvlake.sources import catalog, oplog
from kvlake.sources.store import Files, saved, shared_dir
from kvlake.streaming import ingest

LOWER, UPPER = "u0000020", "u0000050"
READ_SEQ, CHECKPOINT_SEQ = 5000, 9000
PRESENT, MISSING, DELETED = "u0000007", "nosuchkey", "u0000017"
SPLIT_BYTES = 512
BAD = (7000, 7001)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOG = """
log AS (
  SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS k, event_id + 1 AS seq,
         CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op,
         CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '|' || props END AS v,
         CAST(event_id // 1000 AS BIGINT) AS run
  FROM events
)"""
LATEST = """
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1)"""
RUNS = """
dedup AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
meta AS (
  SELECT run, min(k) AS min_key, max(k) AS max_key, count(*) AS keys,
         CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS BIGINT) AS bytes
  FROM dedup GROUP BY run
)"""
TABLES = """
tables AS (
  SELECT run AS id, min_key, max_key, keys, bytes, CAST(3 * (row_number() OVER (ORDER BY run DESC) - 1) // count(*) OVER () AS INTEGER) AS lvl FROM meta
)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.from_events(_events(spark, sf_dir))


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run reduced to its newest version per key, as flushing does."""
    return snapshot.latest(_log(spark, sf_dir).withColumn("key", F.struct("run", "k")), drop_tombstones=False).drop("key")


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.run_meta(_dedup(spark, sf_dir))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs' zone maps as tables of levels."""
    return _levels(_meta(spark, sf_dir))


def _levels(meta: DataFrame) -> DataFrame:
    aged = snapshot.numbered(meta.withColumnRenamed("run", "id"), F.col("id").desc(), into="age")
    return aged.withColumn("lvl", F.expr(f"cast(3 * (age - 1) div {max(1, aged.count())} as int)")).drop("age")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KV = ["k", "v"]


@query(f"WITH {LOG}, {LATEST} SELECT k, v FROM newest WHERE op = 1")
def kv_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.scan(_log(spark, sf_dir), key="k").select(*KV)


@query(f"WITH {LOG}, {LATEST} SELECT k, v FROM newest WHERE op = 1 AND k >= '{LOWER}' AND k < '{UPPER}'")
def kv_scan_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.scan(_log(spark, sf_dir), LOWER, UPPER, key="k").select(*KV)


@query(f"""WITH {LOG} SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log WHERE seq <= {READ_SEQ})
WHERE rn = 1 AND op = 1""")
def kv_scan_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.scan(_log(spark, sf_dir), read_seq=READ_SEQ, key="k").select(*KV)


@query(f"WITH {LOG}, {LATEST} SELECT k, seq, op, v FROM newest")
def kv_latest_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.latest(_log(spark, sf_dir), drop_tombstones=False, key="k").select("k", "seq", "op", "v")


@query(f"WITH {LOG} SELECT CAST(row_number() OVER (ORDER BY k, seq DESC) AS BIGINT) AS ord, k, seq, op FROM log")
def kv_merge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir).select("k", "seq", "op")
    return snapshot.numbered(rows, F.col("k"), F.col("seq").desc(), F.col("op").desc()).select(F.col("ord").cast("long").alias("ord"), "k", "seq", "op")


def _get_sql(key: str) -> str:
    return f"WITH {LOG}, {LATEST} SELECT k, v FROM newest WHERE op = 1 AND k = '{key}'"


@query(_get_sql(PRESENT))
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.get(_log(spark, sf_dir), PRESENT, key="k").select(*KV)


@query(_get_sql(MISSING))
def kv_get_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.get(_log(spark, sf_dir), MISSING, key="k").select(*KV)


@query(f"""WITH {LOG}, {LATEST}, gone AS (SELECT min(k) AS k FROM newest WHERE op = 2)
SELECT n.k, n.v FROM newest n JOIN gone g ON n.k = g.k WHERE n.op = 1""")
def kv_get_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    gone = snapshot.latest(log, drop_tombstones=False, key="k").filter("op = 2").agg(F.min("k")).first()[0]
    return snapshot.get(log, gone, key="k").select(*KV)


@query(f"WITH {LOG}, {LATEST}, wanted AS (SELECT DISTINCT k FROM log WHERE run = 1) SELECT k, v FROM newest WHERE op = 1 AND k IN (SELECT k FROM wanted)")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return snapshot.multi_get(log, log.filter("run = 1").select("k"), key="k").select(*KV)


@query(f"WITH {LOG} SELECT k, seq, op, v FROM log WHERE k = '{PRESENT}'")
def kv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.history(_log(spark, sf_dir), PRESENT, key="k").select("k", "seq", "op", "v")


@query(f"WITH {LOG}, {LATEST} SELECT k, v FROM newest WHERE op = 1 ORDER BY k LIMIT 50")
def kv_limit_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.scan(_log(spark, sf_dir), key="k", limit=50).select(*KV)


@query(f"WITH {LOG}, {RUNS} SELECT k, seq, op, v FROM dedup WHERE run = 2 AND k >= '{LOWER}' ORDER BY k, seq DESC LIMIT 1")
def kv_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.seek(_dedup(spark, sf_dir).filter("run = 2"), LOWER, key="k").select("k", "seq", "op", "v")


@query(f"WITH {LOG}, {RUNS} SELECT k, seq, op, v FROM dedup WHERE run = 2 AND k >= '{LOWER}' AND k <= '{UPPER}'")
def kv_run_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.iterate(_dedup(spark, sf_dir).filter("run = 2"), LOWER, UPPER, key="k").select("k", "seq", "op", "v")


@query(f"WITH {LOG}, {RUNS} SELECT * FROM meta")
def kv_run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _meta(spark, sf_dir)


@query(f"""WITH {LOG}, {RUNS} SELECT m.run, count(*) AS probes FROM (SELECT DISTINCT k FROM log) d JOIN meta m ON d.k BETWEEN m.min_key AND m.max_key GROUP BY m.run""")
def kv_probe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _log(spark, sf_dir).select("k").distinct()
    return zonemap.probe_candidates(keys, _meta(spark, sf_dir)).groupBy("run").agg(F.count("*").alias("probes"))


@query(f"WITH {LOG}, {RUNS} SELECT * FROM meta WHERE min_key <= '{PRESENT}' AND max_key >= '{PRESENT}'")
def kv_point_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.point_candidates(_meta(spark, sf_dir), PRESENT)


@query(f"WITH {LOG}, {RUNS} SELECT * FROM meta WHERE max_key >= '{LOWER}' AND min_key < '{UPPER}'")
def kv_range_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.range_candidates(_meta(spark, sf_dir), LOWER, UPPER)


@query(f"WITH {LOG} SELECT k, max(run) AS run FROM log GROUP BY k")
def kv_first_hit_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.first_hit(_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT CAST((seq - 1) // 128 AS BIGINT) AS batch, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM log GROUP BY 1")
def kv_group_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    batched = oplog.batches(_log(spark, sf_dir), Options().batch_requests)
    return batched.groupBy("batch").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query(f"WITH {LOG} SELECT CAST((seq - 1) // 128 AS BIGINT) AS batch, k, seq, op, v FROM log")
def kv_batch_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows grouped into encoded batches and decoded again."""
    rows = _log(spark, sf_dir).withColumnsRenamed({"k": "key", "v": "value"})
    back = oplog.decode_batches(oplog.encode_batches(oplog.batches(rows, Options().batch_requests)))
    return back.withColumnsRenamed({"key": "k", "value": "v"})


@query(f"WITH {LOG} SELECT k, seq, op, v FROM log WHERE seq > {CHECKPOINT_SEQ}")
def kv_recover_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.after(_log(spark, sf_dir), CHECKPOINT_SEQ).select("k", "seq", "op", "v")


@query(f"""WITH {LOG}, {RUNS}, {TABLES}, deeper AS (SELECT * FROM tables WHERE lvl > 0),
m AS (SELECT * FROM (SELECT k, seq, op, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM dedup WHERE run NOT IN (SELECT id FROM deeper)) WHERE rn = 1)
SELECT k, seq, op, v FROM m WHERE op = 1 OR EXISTS (SELECT 1 FROM deeper d WHERE m.k BETWEEN d.min_key AND d.max_key)""")
def kv_compact_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of level 0 compacted over the zone maps of all deeper levels."""
    runs = _dedup(spark, sf_dir)
    tables = _levels(zonemap.run_meta(runs))
    level0 = tables.filter("lvl = 0").agg(F.min("id")).first()[0]  # level 0 is all runs from this one on; null if there are none
    newest = runs.filter(F.col("run") >= F.lit(level0))
    return compaction.compact_over(newest, tables.filter("lvl > 0")).select("k", "seq", "op", "v")


@query(f"""WITH {LOG}, {RUNS}, {TABLES} SELECT a.id, b.id AS next_id FROM tables a JOIN tables b ON a.min_key <= b.max_key AND a.max_key >= b.min_key
WHERE (a.lvl = 1 AND b.lvl = 2) OR (a.lvl = 0 AND b.lvl = 1)""")
def kv_pick_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    both = [compaction.overlap_join(t.filter(F.col("lvl") == n), t.filter(F.col("lvl") == n + 1)) for n in (1, 0)]
    return both[0].union(both[1]).select("id", "next_id")


@query(f"""WITH {LOG}, {RUNS}, {TABLES}, rated AS (
  SELECT a.id, a.min_key, CAST(coalesce(sum(b.bytes), 0) AS BIGINT) AS overlap, a.bytes
  FROM tables a LEFT JOIN tables b ON b.lvl = 2 AND a.min_key <= b.max_key AND a.max_key >= b.min_key WHERE a.lvl = 1 GROUP BY a.id, a.min_key, a.bytes)
SELECT id, overlap FROM rated ORDER BY CAST(overlap AS DOUBLE) / greatest(bytes, 1), min_key LIMIT 1""")
def kv_least_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tables(spark, sf_dir)
    return compaction.least_overlap(t.filter("lvl = 1"), t.filter("lvl = 2")).select("id", "overlap")


@query("""SELECT CAST(level AS INTEGER) AS level, CAST(greatest(CAST(268435456 AS BIGINT) * CAST(pow(10, level - 1) AS BIGINT), 10995116277760 // CAST(pow(10, 4 - level) AS BIGINT)) AS BIGINT) AS target
FROM (VALUES (1), (2), (3)) t(level)""")
def kv_level_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    goal = compaction.level_targets(10 << 40, Options())
    return spark.createDataFrame([(n, goal[n]) for n in (1, 2, 3)], "level int, target long")


@query(f"""WITH {LOG}, {RUNS}, {TABLES}, n AS (SELECT lvl, min_key, lag(max_key) OVER (PARTITION BY lvl ORDER BY min_key, id) AS before FROM tables)
SELECT lvl, NOT bool_or(coalesce(before >= min_key, false)) AS movable FROM n GROUP BY lvl""")
def kv_movable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.neighbours(_tables(spark, sf_dir))


@query(f"WITH {LOG}, {RUNS}, {TABLES} SELECT lvl, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS tables FROM tables GROUP BY lvl")
def kv_level_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.level_sizes(_tables(spark, sf_dir))


@query(f"WITH {LOG}, {RUNS}, {TABLES} SELECT lvl, min(min_key) AS min_key, max(max_key) AS max_key FROM tables GROUP BY lvl")
def kv_set_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonemap.set_range(_tables(spark, sf_dir), "lvl")


@query(f"""WITH {LOG}, {RUNS}, {TABLES} SELECT lvl, CAST(least(sum(keys), 4096 * CAST(sum(keys) AS BIGINT) // CAST(sum(bytes) AS BIGINT)) AS BIGINT) AS keys FROM tables GROUP BY lvl""")
def kv_estimate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.estimated(_tables(spark, sf_dir), 4096, "lvl")


@query(f"""WITH RECURSIVE {LOG}, {LATEST}, o AS (
  SELECT k, op, v, strlen(k) + coalesce(strlen(v), 0) AS b, row_number() OVER (ORDER BY k) AS i FROM newest
), walk(i, part, size) AS (
  SELECT CAST(1 AS BIGINT), 0, (SELECT b FROM o WHERE i = 1)
  UNION ALL
  SELECT w.i + 1, CASE WHEN w.size >= {SPLIT_BYTES} THEN w.part + 1 ELSE w.part END, CASE WHEN w.size >= {SPLIT_BYTES} THEN 0 ELSE w.size END + o.b
  FROM walk w JOIN o ON o.i = w.i + 1
)
SELECT o.k, o.op, CAST(w.part AS INTEGER) AS part FROM o JOIN walk w USING (i)""")
def kv_output_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = snapshot.latest(_log(spark, sf_dir), drop_tombstones=False, key="k").select("k", "op", "v")
    return compaction.split(newest, SPLIT_BYTES, ranges=1).select("k", "op", F.col("part").cast("int").alias("part"))


CHANGES = """changes AS (
  SELECT user_id % 40 AS id, event_id AS ord, CASE WHEN event_type IN ('error', 'view') THEN 2 ELSE 1 END AS op, CAST(event_id % 5 AS INTEGER) AS lvl FROM events)"""


@query(f"WITH {CHANGES} SELECT id, lvl FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM changes) WHERE rn = 1 AND op = 1")
def kv_catalog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.replay(_changes(spark, sf_dir)).select("id", "lvl")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type").isin("error", "view"), 2).otherwise(1)
    return _events(spark, sf_dir).select((F.col("user_id") % 40).alias("id"), F.col("event_id").alias("ord"), op.alias("op"), (F.col("event_id") % 5).cast("int").alias("lvl"))


@query(f"""WITH {CHANGES}, live AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM changes) WHERE rn = 1 AND op = 1)
SELECT DISTINCT id FROM changes WHERE id NOT IN (SELECT id FROM live)""")
def kv_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _changes(spark, sf_dir)
    return zonemap.orphans(changes.select("id").distinct(), catalog.replay(changes).select("id"), "id")


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select((F.col("event_id") + 1).alias("lsn"), ~F.col("event_id").isin(*BAD), "event_id").toDF("lsn", "valid", "event_id")


FLAGGED = f"flagged AS (SELECT event_id + 1 AS lsn, event_id NOT IN {BAD} AS valid, event_id FROM events)"


@query(f"WITH {FLAGGED} SELECT lsn, event_id FROM flagged WHERE lsn < coalesce((SELECT min(lsn) FROM flagged WHERE NOT valid), 9223372036854775807)")
def kv_corruption_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.cut(_flagged(spark, sf_dir)).select("lsn", "event_id")


@query(f"""WITH {FLAGGED}, d AS (SELECT min(lsn) FILTER (WHERE NOT valid) AS first_bad, max(lsn) FILTER (WHERE valid) AS last_good FROM flagged)
SELECT first_bad, last_good, CASE WHEN first_bad IS NULL THEN 'none' WHEN last_good IS NULL OR last_good < first_bad THEN 'torn' ELSE 'mid' END AS damage FROM d""")
def kv_torn_or_mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.diagnose(_flagged(spark, sf_dir))


@query(f"""WITH {LOG}, {RUNS} SELECT (SELECT CAST(sum(bytes) AS DOUBLE) FROM meta) / (SELECT CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS DOUBLE) FROM log) AS write_amp""")
def kv_write_amp(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = _meta(spark, sf_dir).agg(F.sum("bytes").cast("double").alias("w"))
    user = _log(spark, sf_dir).agg(F.sum(zonemap.octets()).cast("double").alias("u"))
    return written.crossJoin(user).select((F.col("w") / F.col("u")).alias("write_amp"))


@query(f"""WITH {LOG}, {RUNS}, asked AS (SELECT d.k, m.run, EXISTS (SELECT 1 FROM dedup x WHERE x.run = m.run AND x.k = d.k) AS has FROM (SELECT DISTINCT k FROM log) d JOIN meta m ON d.k BETWEEN m.min_key AND m.max_key)
SELECT k, count(*) AS probed, count(*) FILTER (WHERE has) AS held, 0::BIGINT AS missed, true AS adds_up FROM asked GROUP BY k""")
def kv_bloom_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of filters that were written and read again: what depends on the hash is only that excluded, held and falsely kept tables add up."""
    runs, _ = saved(_log(spark, sf_dir).select("run", "k").distinct())  # the keys that flushing keeps
    filters, _ = saved(bloom.build(runs))
    ranges = runs.groupBy("run").agg(F.min("k").alias("min_key"), F.max("k").alias("max_key"))
    counts = bloom.probe_counts(runs.select("k"), runs, ranges, filters)
    return counts.select("k", "probed", "held", "missed", (F.col("probed") == F.col("negative") + F.col("held") + F.col("false_positive")).alias("adds_up"))


@query(f"""WITH {LOG}, {LATEST} SELECT l.k, l.seq, l.v IS NOT DISTINCT FROM n.v AS ok FROM log l JOIN newest n ON l.k = n.k WHERE l.op = 1""")
def kv_verify_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).withColumnRenamed("v", "value")
    return snapshot.verify_reads(log, log.filter("op = 1").select("k", "seq", "value"), key="k").select("k", "seq", "ok")


@query("""SELECT event_id, CAST(greatest(1, ceil(length(bin(event_id)) / 7.0)) AS INTEGER) AS varint, CAST(ceil((30 + strlen(props)) / 8.0) * 8 AS BIGINT) AS record_size,
lpad(CAST(event_id AS VARCHAR), 20, '0') AS name FROM events""")
def kv_scalar_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return e.select("event_id", scalar.uvarint_size(F.col("event_id")).alias("varint"), scalar.record_size(F.octet_length("props")).alias("record_size"), scalar.table_name(F.col("event_id")).alias("name"))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey AS k, o_orderkey AS seq, o_orderstatus AS v FROM o WHERE rn = 1 AND o_orderstatus <> 'F'""")
def orders_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot.latest(oplog.from_orders(spark.read.parquet(f"{sf_dir}/orders.parquet")), key="k").select("k", "seq", "v")


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
HIST = f"hist AS (SELECT event_type, CASE WHEN ns <= 0 THEN 0 ELSE CAST(ceil(ln(ns) / ln(1.01::DOUBLE)) + 1 AS BIGINT) END AS bucket, count(*) AS n FROM (SELECT event_type, CAST(floor(value * 1000000) AS BIGINT) AS ns FROM events) GROUP BY 1, 2)"


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.histogram(_events(spark, sf_dir), "event_type", F.floor(F.col("value") * 1_000_000))


@query(f"WITH {HIST} SELECT * FROM hist")
def wl_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


@query(f"""WITH {HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM hist)
SELECT event_type, {", ".join(f"min(upper) FILTER (WHERE cum >= ceil(total * {p}::DOUBLE)) AS {n}" for n, p in SHARES.items())}
FROM (SELECT *, CASE WHEN bucket <= 0 THEN 0 ELSE CAST(ceil(exp((bucket - 1) * ln(1.01::DOUBLE))) AS BIGINT) END AS upper FROM c) GROUP BY event_type""")
def wl_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.percentiles(_histogram(spark, sf_dir), "event_type", SHARES)


@query("SELECT epoch_us(time_bucket(INTERVAL 5 SECONDS, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def wl_window_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.windows(_events(spark, sf_dir), F.col("ts").cast("timestamp"), "5 seconds", "event_type")


@query("""SELECT event_type, count(*) AS total, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS slow,
CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM events GROUP BY event_type""")
def wl_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.outcomes(_events(spark, sf_dir), "event_type", slow=F.col("value") > 50, failed=F.col("event_type") == "error").withColumnRenamed("n", "total")


@query("""WITH r AS (SELECT user_id, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) -
row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY event_id) AS island FROM events),
g AS (SELECT user_id, failed, count(*) AS n FROM r GROUP BY user_id, failed, island)
SELECT user_id, CAST(coalesce(max(n) FILTER (WHERE failed), 0) AS BIGINT) AS streak, coalesce(max(n) FILTER (WHERE failed), 0) >= 10 AS alarm FROM g GROUP BY user_id""")
def wl_failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.streaks(_events(spark, sf_dir), "user_id", "event_id", F.col("event_type") == "error")


@query("""WITH b AS (SELECT event_id, list_transform(string_split('u' || lpad(CAST(user_id AS VARCHAR), 7, '0'), ''), lambda c: CAST(ascii(c) AS HUGEINT)) AS octets FROM events),
h AS (SELECT event_id, CAST(list_reduce(list_prepend(CAST(14695981039346656037 AS HUGEINT), octets), lambda h, x: xor(h, x) * 1099511628211 % 18446744073709551616) % 8 AS BIGINT) AS shard FROM b)
SELECT shard, event_id FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY event_id DESC) AS rn FROM h) WHERE rn <= 100""")
def wl_ring_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last keys written of every shard; a key's shard follows from the FNV-1a hash of its bytes."""
    log = _log(spark, sf_dir).withColumn("event_id", F.col("seq") - 1)
    return workload.ring(log, scalar.fnv1a_shard(F.col("k"), 8), "event_id").select("shard", "event_id")


@query("SELECT i AS arrival, CAST(i * 1000000000 // 7000 AS BIGINT) AS due_ns FROM range(5000) t(i)")
def wl_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.schedule(spark, 7000, 5000)


@query("""WITH s AS (SELECT epoch_us(ts) AS moment, 1 AS d FROM events UNION ALL SELECT epoch_us(ts) + 1800000000, -1 FROM events)
SELECT CAST(max(r) AS BIGINT) AS peak FROM (SELECT sum(d) OVER (ORDER BY moment, d DESC ROWS UNBOUNDED PRECEDING) AS r FROM s)""")
def wl_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return workload.backlog(_events(spark, sf_dir), at, at + 1_800_000_000)


@query(f"WITH {LOG}, {LATEST} SELECT k, v FROM newest WHERE op = 1")
def kv_engine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log committed to an engine in five batches, each flushed, all compacted, and scanned."""
    log = _log(spark, sf_dir).select(F.col("k").cast("binary").alias("key"), "seq", "op", F.col("v").cast("binary").alias("value"))
    engine = Engine(spark, f"{shared_dir(spark).rstrip('/')}/engine-{uuid.uuid4().hex}").start()
    last = log.agg(F.max("seq")).first()[0] or 0
    size = -(-last // 5)
    for first in range(0, last, max(1, size)):
        upto = min(last, first + size)
        engine.append(log.filter((F.col("seq") > first) & (F.col("seq") <= upto)), upto - first)
        engine.flush()
    engine.compact()
    return engine.scan().select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


@query(f"WITH {LOG}, {LATEST} SELECT k, seq, op, v FROM newest")
def kv_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest version per key, kept by a streaming aggregate over the events."""
    table = _events(spark, sf_dir)
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque*")  # a pattern, as the table may be one file
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    view = ingest.latest_view(oplog.from_events(stream).withColumnsRenamed({"k": "key", "v": "value"}))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/latest")

    view.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/latest").withColumnsRenamed({"key": "k", "value": "v"})


@query("SELECT CAST(i AS BIGINT) AS id, lpad(CAST(i % 700 + 1 AS VARCHAR), 10, '0') AS key FROM range(5000) t(i)")
def wl_counter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.keys(spark, 5000, "seq", wrap=700)


# -- the engine's log, catalog and maintenance --------------------------------------------------------------------------------------


def _octets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as the engine stores it."""
    return _log(spark, sf_dir).select(F.col("k").cast("binary").alias("key"), "seq", "op", F.col("v").cast("binary").alias("value"))


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _filled(spark: SparkSession, sf_dir: str, batches: int = 5, options: Options | None = None, maintain: bool = True) -> Engine:
    """A new engine with the log committed in batches of equal numbers of sequences; without ``maintain``, all of it stays in the log."""
    log, engine = _octets(spark, sf_dir), Engine(spark, _folder(spark, "engine"), options).start()
    last = log.agg(F.max("seq")).first()[0] or 0
    size = max(1, -(-last // batches))
    for first in range(0, last, size):
        upto = min(last, first + size)
        engine.append(log.filter((F.col("seq") > first) & (F.col("seq") <= upto)), upto - first, maintain=maintain)
    return engine


#: The first three of five batches of equal size, as SQL.
THREE_BATCHES = "(SELECT 3 * ((max(seq) + 4) // 5) FROM log)"


@query(f"""WITH {LOG}, kept AS (SELECT * FROM log WHERE seq <= {THREE_BATCHES}),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM kept) WHERE rn = 1) SELECT k, v FROM newest WHERE op = 1""")
def kv_recover_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fourth of five log batches is damaged: records no longer have their checksums. Recovery that truncates keeps the batches before it."""
    engine = _filled(spark, sf_dir)
    engine.stop()
    size = -(-engine.committed // 5)
    # full units before it may be flushed by now; the newest full unit and the open one are in the log, and with them this batch, if there are so many
    for mark in [m for unit in engine.units() for m in unit if m["first"] == 3 * size + 1]:
        path = f"{engine.folder}/log/{mark['first']:020d}-{mark['last']:020d}"
        text = engine.files.read(f"{path}/_COMMIT")
        rows, _ = saved(spark.read.parquet(path).withColumn("value", F.lit(b"damaged")))
        rows.write.mode("overwrite").parquet(path)
        engine.files.create(f"{path}/_COMMIT", text)
    again = Engine(spark, engine.folder, Options(corruption="truncate")).start()
    return _texts(again.scan())


@query(f"""WITH {LOG}, kept AS (SELECT * FROM log WHERE seq <= {THREE_BATCHES}),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM kept) WHERE rn = 1) SELECT k, v FROM newest WHERE op = 1""")
def kv_snapshot_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot taken after three batches, read after two more were committed, flushed, compacted and vacuumed."""
    log, engine = _octets(spark, sf_dir), Engine(spark, _folder(spark, "engine"), Options(l0_trigger=2)).start()
    last = log.agg(F.max("seq")).first()[0] or 0
    size = max(1, -(-last // 5))
    part = lambda n: log.filter((F.col("seq") > n * size) & (F.col("seq") <= min(last, (n + 1) * size)))
    for n in range(3):
        engine.append(part(n), size)
        engine.flush()
    with engine.snapshot() as then:
        for n in (3, 4):
            engine.append(part(n), min(last, (n + 1) * size) - n * size)
            engine.flush()
            engine.compact()
            engine.vacuum()
        seen, _ = saved(_texts(then.scan()))
    return seen


@query(f"WITH {LOG}, {LATEST} SELECT k || chr(9) || v AS line FROM newest WHERE op = 1")
def kv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, path = _filled(spark, sf_dir), _folder(spark, "export")
    engine.export(path, escape=False)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query("""SELECT * FROM (VALUES ('a', 'two', true), ('b', NULL, false), ('c', '', true), ('never', NULL, false), ('long', NULL, false)) t(k, v, found)""")
def kv_engine_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set, overwrite, delete (also of an unknown key), empty values, and gets of present, deleted, unknown and oversized keys."""
    with Engine(spark, _folder(spark, "engine")) as engine:
        engine.set(b"a", b"one")
        engine.write([(b"a", 1, b"two"), (b"b", 1, b"x"), (b"c", 1, b"")])
        engine.delete(b"b")
        engine.delete(b"unknown")
        keys = {"a": b"a", "b": b"b", "c": b"c", "never": b"never", "long": b"l" * 5000}
        rows = [(name, None if (got := engine.get(key))[0] is None else got[0].decode(), got[1]) for name, key in keys.items()]
    return spark.createDataFrame(rows, "k string, v string, found boolean")


@query(f"""WITH {LOG}, n AS (SELECT CAST(max(seq) AS DOUBLE) AS rows, CAST(sum(strlen(k) + coalesce(strlen(v), 0)) AS DOUBLE) AS bytes FROM log)
SELECT 'commits' AS name, 5::DOUBLE AS value UNION ALL SELECT 'commit_records', rows FROM n UNION ALL SELECT 'user_bytes_written', bytes FROM n UNION ALL SELECT 'flushes', 1
UNION ALL SELECT 'committed', rows FROM n UNION ALL SELECT 'checkpoint', rows FROM n UNION ALL SELECT 'log_batches', 0 UNION ALL SELECT 'retained_files', 5 UNION ALL SELECT 'read_only', 0""")
def kv_engine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and gauges of five commits and a flush of them all; no write flushes by itself, whatever the size."""
    engine = _filled(spark, sf_dir, maintain=False)
    engine.flush()
    named = F.col("name").isin("commits", "commit_records", "user_bytes_written", "flushes", "committed", "checkpoint", "log_batches", "retained_files", "read_only")
    return engine.metrics().filter(named).select("name", "value")


@query(f"WITH {LOG}, {LATEST} SELECT k, v FROM newest WHERE op = 1")
def kv_stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of writes, ingested and, with its progress lost, replayed: every batch is committed once."""
    table, engine = _events(spark, sf_dir), Engine(spark, _folder(spark, "engine")).start()
    writes = lambda df: oplog.from_events(df).select(F.col("k").cast("binary").alias("key"), "op", F.col("v").cast("binary").alias("value"), F.col("seq").alias("arrival"))
    for _ in range(2):
        stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque*")
        ingest.ingest(writes(stream), engine, _folder(spark, "stream")).awaitTermination()
    if engine.committed != table.count():
        raise AssertionError("a replayed batch was committed again")
    return _texts(engine.scan())


@query("SELECT epoch_us(time_bucket(INTERVAL 5 SECONDS, ts)) AS start_us, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def wl_stream_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of every window, as a streaming query writes it."""
    table, folder = _events(spark, sf_dir), _folder(spark, "report")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque*")
    report = ingest.window_report(stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("outcome")))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("append").parquet(f"{folder}/rows")

    report.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    seen = spark.read.parquet(f"{folder}/rows").select(F.unix_micros("window.start").alias("start_us"), "outcome", F.col("count").alias("n"))
    return seen.groupBy("start_us", "outcome").agg(F.max("n").alias("n"))  # updates of a window grow


@query(f"WITH {LOG}, {RUNS} SELECT run FROM (SELECT run, row_number() OVER (ORDER BY run DESC) AS nth FROM meta) WHERE nth > 1")
def kv_flush_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as full units of flushing: all but the newest one are due."""
    full = [r["run"] for r in _meta(spark, sf_dir).orderBy("run").collect()]
    return spark.createDataFrame([(n,) for n in compaction.flushable(full, 1)], "run long")


UNIT_BYTES = 16_384


@query(f"""WITH RECURSIVE {LOG}, b AS (SELECT CAST((seq - 1) // 128 AS BIGINT) AS batch, sum(strlen(k) + coalesce(strlen(v), 0)) AS n FROM log GROUP BY 1),
walk(batch, unit, size) AS (
  SELECT CAST(0 AS BIGINT), 0, (SELECT n FROM b WHERE batch = 0)
  UNION ALL
  SELECT w.batch + 1, CASE WHEN w.size + b.n > {UNIT_BYTES} THEN w.unit + 1 ELSE w.unit END, CASE WHEN w.size + b.n > {UNIT_BYTES} THEN b.n ELSE w.size + b.n END FROM walk w JOIN b ON b.batch = w.batch + 1
) SELECT batch, CAST(unit AS INTEGER) AS unit FROM walk""")
def kv_flush_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commit batches rolled into units of flushing by size."""
    sizes = oplog.batches(_log(spark, sf_dir), Options().batch_requests).groupBy("batch").agg(F.sum(zonemap.octets()).alias("n")).orderBy("batch").collect()
    units = oplog.rolled([r["n"] for r in sizes], UNIT_BYTES)
    return spark.createDataFrame([(sizes[i]["batch"], n) for n, unit in enumerate(units) for i in unit], "batch long, unit int")


@query(f"WITH {LOG} SELECT CAST((seq - 1) // 128 AS BIGINT) AS batch, max(seq) AS max_lsn FROM log GROUP BY 1 HAVING max(seq) < {CHECKPOINT_SEQ}")
def kv_log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = oplog.batches(_log(spark, sf_dir), Options().batch_requests).groupBy("batch").agg(F.max("seq").alias("max_lsn"))
    return recovery.expired(files, CHECKPOINT_SEQ)


@query(f"WITH {LOG} SELECT seq, seq % 1000 <> 0 AS valid FROM log")
def kv_log_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamped records, of which every thousandth is then changed: its checksum tells."""
    stamped = oplog.stamped(_octets(spark, sf_dir))
    changed = stamped.withColumn("key", F.when(F.col("seq") % 1000 == 0, F.concat("key", F.lit(b"!"))).otherwise(F.col("key")))
    return oplog.checked(changed).select("seq", "valid")


@query("SELECT event_id AS entry, props AS data FROM events")
def kv_log_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries split into parts of four bytes, the order of which is lost, and put together again; an entry without its last part is left out."""
    data = F.col("props").cast("binary")
    n = F.greatest(F.ceil(F.octet_length("props") / 4), F.lit(1)).cast("int")
    parts = _events(spark, sf_dir).select(F.col("event_id").alias("entry_lsn"), data.alias("d"), n.alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    parts = parts.select("entry_lsn", "part", (F.col("part") == F.col("n") - 1).alias("last"), F.substring("d", F.col("part") * 4 + 1, F.lit(4)).alias("data"))
    torn = spark.createDataFrame([(-1, 0, False, b"torn")], "entry_lsn long, part int, last boolean, data binary")
    return recovery.reassemble(parts.unionByName(torn)).select(F.col("entry_lsn").alias("entry"), F.col("data").cast("string").alias("data"))


@query(f"""WITH {FLAGGED} SELECT * FROM (VALUES ('at', (SELECT count(*) FROM flagged WHERE lsn = 500) > 0), ('from', (SELECT count(*) FROM flagged WHERE lsn >= 7001 AND valid) > 0), ('beyond', false)) t(asked, found)""")
def kv_log_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record by its place, and whether a sound record begins after a damaged one or after the end."""
    log = _flagged(spark, sf_dir)
    at = recovery.record_at(log, 500).agg((F.count("*") > 0).alias("found"))
    named = [("at", at), ("from", recovery.any_from(log, BAD[0] + 1)), ("beyond", recovery.any_from(log, 1 << 40))]
    parts = [df.select(F.lit(name).alias("asked"), "found") for name, df in named]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH {CHANGES}, live AS (SELECT id, lvl, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM changes) WHERE rn = 1 AND op = 1)
SELECT id, lvl, row_number() OVER (ORDER BY lvl, CASE WHEN lvl = 0 THEN -ord END, lpad(CAST(id AS VARCHAR), 20, '0')) AS place FROM live""")
def kv_catalog_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live tables in the order they are probed."""
    live = catalog.replay(_changes(spark, sf_dir)).withColumn("min_key", scalar.table_name(F.col("id")))
    return catalog.listed(live).select("id", "lvl", "place")


@query(f"""WITH {CHANGES}, live AS (SELECT id, lvl FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM changes) WHERE rn = 1 AND op = 1)
SELECT id, lvl, (SELECT max(id) + 1 FROM changes) AS next_id FROM live""")
def kv_catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes, newest of each table, as edits of a catalog that is snapshotted on the way and opened again; ids of removed tables stay used."""
    newest = F.row_number().over(Window.partitionBy("id").orderBy(F.col("ord").desc()))
    rows = _changes(spark, sf_dir).withColumn("nth", newest).filter("nth = 1").orderBy("ord").collect()  # a row a table
    edits = catalog.Catalog(Files(spark), _folder(spark, "catalog"), stale_limit=8)
    edits.create()
    table = lambda r: {"ver": 1, "id": r["id"], "lvl": r["lvl"], "path": "", "minKey": "", "maxKey": "", "keys": 0, "sizeBytes": 0}
    for r in rows:
        edits.edit([{"op": ADD, "table": table(r)}])
        if r["op"] != ADD:
            edits.edit([{"op": REMOVE, "table": table(r)}])
    again = catalog.Catalog(Files(spark), edits.folder)
    live = again.open().all()
    return spark.createDataFrame([(t["id"], t["lvl"], again.next_id()) for t in live], "id long, lvl int, next_id long")


@query(f"""WITH {LOG}, {RUNS}, {TABLES}, l0 AS (SELECT * FROM tables WHERE lvl = 0 ORDER BY id LIMIT 3), r AS (SELECT min(min_key) AS lo, max(max_key) AS hi, count(*) AS n FROM l0)
SELECT id, 1 AS target FROM l0, r WHERE n = 3 UNION ALL SELECT t.id, 1 FROM tables t, r WHERE n = 3 AND t.lvl = 1 AND t.min_key <= r.hi AND t.max_key >= r.lo""")
def kv_pick_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the next compaction: the three oldest of level 0, once there are three, and what they overlap in level 1."""
    tables = [compaction.Table(t["id"], t["lvl"], t["min_key"].encode(), t["max_key"].encode(), t["bytes"], t["keys"]) for t in _tables(spark, sf_dir).orderBy("id").collect()]
    plan = compaction.pick(tables, Options(l0_trigger=3))
    return spark.createDataFrame([(t.id, plan.target) for t in plan.inputs] if plan else [], "id long, target int")


@query(f"WITH {LOG}, {RUNS}, {TABLES} SELECT id, CASE WHEN lvl = 2 THEN 3 WHEN lvl = 1 THEN 2 ELSE 1 END AS lvl FROM tables")
def kv_trivial_move(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every table by itself is movable: only its level changes, by an edit of the catalog, and no data is written."""
    engine = Engine(spark, _folder(spark, "engine")).start()
    metas = [{"ver": 1, "id": t["id"] + 1, "lvl": t["lvl"], "path": "/tables/none", "ts": "2024-01-01T00:00:00+00:00", "minKey": catalog.text_of(t["min_key"].encode()), "maxKey": catalog.text_of(t["max_key"].encode()), "keys": t["keys"], "sizeBytes": t["bytes"]} for t in _tables(spark, sf_dir).collect()]
    engine.catalog.edit([{"op": ADD, "table": m} for m in metas])
    for t in engine.catalog.version.plan_tables():
        engine.execute(compaction.Plan(t.level, t.level + 1, (t,)))
    return engine.tables().select((F.col("id") - 1).alias("id"), "lvl")


@query(f"WITH {LOG} SELECT k, seq, op FROM log")
def kv_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs as sources of one merge; the order is checked on the way: a row that is out of order is left out.

    The runs are one table and one source of the plan, however many there are.
    """
    log = _log(spark, sf_dir).select(F.col("k").alias("key"), "seq", "op")
    merged = snapshot.merge([log]).withColumn("at", F.monotonically_increasing_id())
    place, ordered = F.struct("seq", "op"), Window.partitionBy("key").orderBy("at")
    good = F.coalesce(F.lag(place).over(ordered) >= place, F.lit(True))
    return merged.withColumn("good", good).filter("good").select(F.col("key").alias("k"), "seq", "op")


BLOCK_BYTES = 512


@query(f"""WITH {LOG}, {LATEST}, placed AS (SELECT k, CAST((sum(strlen(k) + coalesce(strlen(v), 0)) OVER (ORDER BY k) - strlen(k) - coalesce(strlen(v), 0)) // {BLOCK_BYTES} AS BIGINT) AS block FROM newest),
ends AS (SELECT block, min(k) AS first_key, max(k) AS last_key FROM placed GROUP BY block), n AS (SELECT *, lead(first_key) OVER (ORDER BY block) AS next_key FROM ends),
d AS (SELECT *, list_filter(generate_series(1, 8), lambda i: substr(last_key, i, 1) <> substr(next_key, i, 1))[1] AS pos FROM n)
SELECT block, first_key, last_key, CASE WHEN pos < 8 THEN substr(next_key, 1, pos) ELSE last_key END AS separator FROM d""")
def kv_sparse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the newest versions in key order, and the shortest separator of each from the next."""
    newest = snapshot.latest(_log(spark, sf_dir), drop_tombstones=False, key="k")
    return zonemap.sparse_index(zonemap.blocks(newest, BLOCK_BYTES))


@query(f"WITH {LOG}, {LATEST} SELECT k, seq FROM newest WHERE k >= '{UPPER}' ORDER BY k LIMIT 1")
def kv_block_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seek by the sparse index: the block whose separator is first not below the key, and in it and the next one the first row from the key on."""
    blocked = zonemap.blocks(snapshot.latest(_log(spark, sf_dir), drop_tombstones=False, key="k"), BLOCK_BYTES)
    found = zonemap.find_block(zonemap.sparse_index(blocked), UPPER).first()
    rows = blocked.limit(0) if found is None else blocked.filter(F.col("block").between(found["block"], found["block"] + 1))
    return snapshot.seek(rows, UPPER, key="k").select("k", "seq")


@query("SELECT event_id, 100 + row_number() OVER (ORDER BY event_id) AS seq FROM events")
def kv_assign_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oplog.assign_seq(_events(spark, sf_dir).select("event_id"), "event_id", 100)


@query(f"WITH {LOG} SELECT seq, hex(k) || '00' || printf('%016X', ~seq) || printf('%02X', 255 - op) AS internal FROM log")
def kv_internal_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("seq", F.hex(scalar.internal_key(F.col("k").cast("binary"), F.col("seq"), F.col("op"))).alias("internal"))


@query("""SELECT * FROM (VALUES ('size 16MiB', '16777216'), ('size 7', '7'), ('env', 'KV_MEMTABLE_CAPACITY_BYTES'), ('digits', '1,234,567.5'), ('duration', '2.50ms'), ('segment', '0000000004000002.log'),
('option fanout', '10'), ('option memtable_bytes', '67108864'), ('config server.port', '3'), ('config memtable.capacityBytes', '16777216'), ('bad option', 'fanout must be 2 at least')) t(name, value)""")
def kv_text_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, names, formats, options and layered configuration, by value."""
    spec = {"server.port": ("port", "80"), "memtable.capacityBytes": ("bytes", "64MiB")}
    layered = config.load(spec, "KV", {"server.port": "1", "memtable.capacityBytes": "16MiB"}, {"KV_SERVER_PORT": "2"}, {"server.port": "3"})
    try:
        bad = str(Options(fanout=1))
    except ValueError as e:
        bad = str(e)
    rows = [("size 16MiB", scalar.parse_bytes("16MiB")), ("size 7", scalar.parse_bytes("7")), ("env", scalar.env_name("KV", "memtable.capacityBytes")), ("digits", scalar.group_digits("1234567.5"))]
    rows += [("duration", scalar.format_duration(2_500_000)), ("segment", scalar.segment_name(1, 2)), ("option fanout", Options().fanout), ("option memtable_bytes", Options().memtable_bytes)]
    rows += [*[(f"config {k}", v) for k, v in layered.items()], ("bad option", bad)]
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "name string, value string")


# -- the workload -------------------------------------------------------------------------------------------------------------------

OUTCOMES = ["purchase", "signup", "click", "error"]


@query("""SELECT event_type, count(*) AS n, CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 ELSE 4 END AS rank FROM events GROUP BY event_type""")
def wl_outcome_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workload.outcomes(_events(spark, sf_dir), "event_type").withColumn("rank", workload.outcome_rank(F.col("event_type"), OUTCOMES)).orderBy("rank")


@query("""WITH r AS (SELECT event_id * 1000000 AS due_ns, event_id * 1000000 + CAST(floor(value * 1000) AS BIGINT) - 20000 AS start_ns FROM events)
SELECT CAST(sum(greatest(start_ns - due_ns, 0)) AS BIGINT) AS wait_ns, CAST(max(greatest(start_ns - due_ns, 0)) AS BIGINT) AS max_wait_ns, count(*) FILTER (WHERE start_ns > due_ns) AS late FROM r""")
def wl_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = (F.col("event_id") * 1_000_000).alias("due_ns")
    return workload.waits(_events(spark, sf_dir).select(due, (F.col("event_id") * 1_000_000 + F.floor(F.col("value") * 1000) - 20_000).alias("start_ns")))


@query("""WITH r AS (SELECT event_type, CAST(sum(CAST(floor(value * 1000000) AS BIGINT)) AS BIGINT) AS busy, CAST(max(event_id) - min(event_id) AS BIGINT) * 1000000 AS elapsed FROM events GROUP BY event_type)
SELECT event_type, CASE WHEN elapsed = 0 THEN 1.0::DOUBLE ELSE least(greatest(CAST(busy AS DOUBLE) / CAST(elapsed * 4 AS DOUBLE), 0), 1) END AS utilisation FROM r""")
def wl_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    busy = _events(spark, sf_dir).groupBy("event_type").agg(F.sum(F.floor(F.col("value") * 1_000_000)).alias("busy"), ((F.max("event_id") - F.min("event_id")) * 1_000_000).alias("elapsed"))
    return busy.select("event_type", workload.utilisation(F.col("busy"), 4, F.col("elapsed")).alias("utilisation"))


@query("""WITH r AS (SELECT i, CASE WHEN i % 7 = 0 THEN 0 ELSE 10 END AS scheduled, i % 3 * 2000000 AS overrun, i % 4 * 1500000 AS p99, i % 5 * 2 AS backlog, i % 6 / 5.0::DOUBLE AS util, i % 2 * 3000000 AS wait FROM range(840) t(i)),
s AS (SELECT *, overrun > 2000000 AS late_end, overrun > 2000000 OR (p99 > 2000000 AND backlog > 2) AS behind FROM r)
SELECT i AS id, CASE WHEN scheduled = 0 THEN NULL
  WHEN behind AND util >= 0.8 THEN CASE WHEN late_end THEN 'server or workers too slow for the rate' ELSE 'server or workers too slow at times' END
  WHEN behind AND wait >= greatest(2000000, overrun // 2) THEN CASE WHEN late_end THEN 'generator limits the rate' ELSE 'generator under pressure at times' END
  WHEN behind THEN 'generator or host scheduling delays starts'
  WHEN p99 > 2000000 AND wait < 2000000 AND util < 0.5 THEN 'scheduling jitter' END AS diagnosis FROM s""")
def wl_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of reports of a run at 1,000 requests a second, and what limits each."""
    i = F.col("id")
    report = spark.range(840).select(
        "id",
        F.when(i % 7 == 0, 0).otherwise(10).alias("scheduled"),
        (i % 3 * 2_000_000).alias("overrun_ns"),
        (i % 4 * 1_500_000).alias("start_p99_ns"),
        (i % 5 * 2).alias("max_backlog"),
        (i % 6 / 5.0).alias("utilisation"),
        (i % 2 * 3_000_000).alias("wait_ns"),
        (i % 2 * 3_000_000).alias("max_wait_ns"),
    )
    return workload.diagnose(report, 1000.0).select("id", "diagnosis")


@query("""SELECT CAST(i AS BIGINT) AS id, CASE i % 5 WHEN 0 THEN 36 WHEN 1 THEN 36 WHEN 2 THEN 26 WHEN 3 THEN 10 ELSE 30 END AS length, CASE i % 5 WHEN 0 THEN '4' WHEN 1 THEN '7' WHEN 3 THEN right(lpad(CAST(i + 1 AS VARCHAR), 10, '0'), 1) END AS mark FROM range(1000) t(i)""")
def wl_mixed_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all kinds in turn: their lengths, the version digit of uuids, and the last digit of counters."""
    turn = F.col("id") % 5
    mark = F.when(turn < 2, F.substring("key", 15, 1)).when(turn == 3, F.substring("key", 10, 1))
    return generate.keys(spark, 1000).select("id", F.length("key").alias("length"), mark.alias("mark"))


@query("""SELECT CAST(i AS BIGINT) AS id, md5('0:' || i) AS own, 'user' || i % 10000 AS user, 2 AS places, 128 AS bio, true AS ip FROM range(1000) t(i)""")
def wl_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated payloads, parsed again."""
    j = F.from_json("value", "id string, user string, loc array<double>, bio string, ip string")
    ip = j["ip"].rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.|$)){4}$")
    return generate.payloads(spark, 1000).select("id", j["id"].alias("own"), j["user"].alias("user"), F.size(j["loc"]).alias("places"), F.length(j["bio"]).alias("bio"), ip.alias("ip"))


@query("""SELECT op, outcome, CAST(n AS BIGINT) AS n FROM (VALUES ('put', 'success', 40), ('get', 'success', 4), ('scan', 'success', 1), ('put', 'rejected', 1)) t(op, outcome, n)""")
def wl_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the load generator against an engine: puts in batches, a get for every ten puts that must read the value written last, a scan, and a write that is too large."""
    with Engine(spark, _folder(spark, "engine")) as engine:
        done = load.run(engine, load.plan(spark, 40, 10))
    return workload.outcomes(done, "op", "outcome")
