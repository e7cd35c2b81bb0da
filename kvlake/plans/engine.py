"""The engine: a folder with a log, sorted tables and a catalog, read and written through Spark.

Writes are batches: one batch is one log folder and becomes visible whole, by its commit mark. Batches of ``memtable_bytes`` together
are a unit of flushing; once more than ``cached_immutables`` units are full, a write flushes the oldest into level-0 tables, moves
the checkpoint and compacts until all levels are within their targets. ``flush`` and ``compact`` do so by hand. Reads take a snapshot when
they are planned: the batches and tables of that moment. Replaced files stay until ``vacuum``, which spares what open snapshots hold.

Files: ``LOCK``, ``catalog/`` (sources.catalog), ``tables/<id>/``, ``log/<first>-<last>/`` with ``_COMMIT``: a JSON mark of the batch's
sequences, records, bytes and checksum, written after its rows. A folder without a mark is an aborted write. Every step leaves a folder
that ``start`` can recover from.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kvlake.operators import bloom, compaction, recovery, snapshot
from kvlake.operators.zonemap import octets
from kvlake.schema import ADD, CHECKPOINT, DELETE, LEVELS, LOGGED, OPLOG, REMOVE, SET, TABLE, BelowHorizon, Corrupt, Locked, NotStarted, Options, ReadOnly
from kvlake.sources import oplog
from kvlake.sources.catalog import Catalog, key_of, text_of
from kvlake.sources.store import Files

MARK = "_COMMIT"


class Engine:
    def __init__(self, spark: SparkSession, folder: str, options: Options | None = None):
        self.spark, self.folder, self.options = spark, folder.rstrip("/"), options or Options()
        self.files = Files(spark)
        self.catalog = Catalog(self.files, f"{self.folder}/catalog", self.options.stale_records)
        self.committed = 0
        self.failure: Exception | None = None
        self.counters: Counter[str] = Counter()
        self._id = uuid.uuid4().hex
        self._started = False
        self._marks: list[dict] = []
        self._dead: list[str] = []
        self._pins: Counter[str] = Counter()

    # -- life cycle ---------------------------------------------------------------------------------------------------------------

    def start(self, takeover: bool = False) -> Engine:
        """Take the folder's lock, replay the catalog, remove what no state names, and recover the log after the checkpoint.

        A folder whose engine died still has its lock: ``takeover`` says that this is so. Without a catalog, a folder with
        tables or log batches is not touched. Torn tails of the log are cut; damage in mid-log follows ``options.corruption``.
        """
        self._lock(takeover)
        try:
            for d in ("log", "tables"):
                self.files.mkdirs(f"{self.folder}/{d}")
            if not self.catalog.exists():
                if self.files.names(f"{self.folder}/tables") or self.files.names(f"{self.folder}/log"):
                    raise Corrupt(f"{self.folder} has data and no catalog")
                self.catalog.create()
            v = self.catalog.open()
            live = {t["path"].split("/tables/")[1].split("/")[0] for t in v.tables.values()}
            for name in self.files.names(f"{self.folder}/tables"):
                if name not in live:
                    self.files.delete(f"{self.folder}/tables/{name}")
            self._marks, self._dead, self._pins, self.failure = self._recovered(), [], Counter(), None
        except Exception:
            self._unlock()
            raise
        self.committed = self._marks[-1]["last"] if self._marks else v.last_seq
        self._started = True
        return self

    def stop(self) -> None:
        if self._started:
            self._started = False
            self._unlock()

    def err(self) -> Exception | None:
        """The log failure that made the engine read-only, if any."""
        return self.failure

    def __enter__(self) -> Engine:
        return self.start()

    def __exit__(self, *_: object) -> None:
        self.stop()

    def _lock(self, takeover: bool) -> None:
        self.files.mkdirs(self.folder)
        path = f"{self.folder}/LOCK"
        if takeover:
            self.files.delete(path)
        try:
            self.files.create(path, json.dumps({"engine": self._id, "application": self.spark.sparkContext.applicationId}).encode())
        except FileExistsError as e:
            raise Locked(f"{self.folder} is held by {self.files.read(path).decode()}") from e

    def _held(self) -> bool:
        path = f"{self.folder}/LOCK"
        return self.files.exists(path) and json.loads(self.files.read(path))["engine"] == self._id

    def _unlock(self) -> None:
        if self._held():
            self.files.delete(f"{self.folder}/LOCK")

    def _recovered(self) -> list[dict]:
        """Marks of the sound batches after the checkpoint. Aborted batches, flushed ones and those that recovery cuts are deleted."""
        last_seq, marks = self.catalog.version.last_seq, []
        for name in self.files.names(f"{self.folder}/log"):
            path = f"{self.folder}/log/{name}"
            if not self.files.exists(f"{path}/{MARK}") or int(name.split("-")[1]) <= last_seq:
                self.files.delete(path)
                continue
            try:
                mark = json.loads(self.files.read(f"{path}/{MARK}"))
            except ValueError:
                first, last = map(int, name.split("-"))
                mark = {"first": first, "last": last, "count": -1, "bytes": 0, "crc": 0}
            marks.append(mark)
        if not marks:
            return []
        before = [last_seq, *[m["last"] for m in marks]]
        joined = [m["first"] <= b + 1 for m, b in zip(marks, before, strict=False)]  # the first batch may straddle the checkpoint
        said = self.spark.createDataFrame([(m["first"], m["count"], m["crc"], j) for m, j in zip(marks, joined, strict=True)], "lsn long, said long, sum long, joined boolean")
        rows = self.spark.read.schema(LOGGED).option("ignoreCorruptFiles", True).parquet(*[self._batch(m) for m in marks])
        lsn = F.regexp_extract("_metadata.file_path", r"/(\d{20})-\d{20}/[^/]*$", 1).cast("long")
        seen = oplog.checked(rows.withColumn("lsn", lsn)).groupBy("lsn").agg(F.count_if("valid").alias("good"), F.count("*").alias("n"), F.sum("crc").alias("crc"))
        sound = (F.col("good") == F.col("said")) & (F.col("n") == F.col("said")) & (F.col("crc") == F.col("sum")) & F.col("joined")
        entries = said.join(seen, "lsn", "left").select("lsn", F.coalesce(sound, F.lit(False)).alias("valid"))
        kept = {r["lsn"] for r in recovery.recover(entries, policy=self.options.corruption).collect()}
        for m in marks:
            if m["first"] not in kept:
                self.files.delete(self._batch(m))
        return [m for m in marks if m["first"] in kept]

    # -- writes -------------------------------------------------------------------------------------------------------------------

    def set(self, key: bytes, value: bytes) -> None:
        self.write([(key, SET, value)])

    def delete(self, key: bytes) -> None:
        self.write([(key, DELETE, None)])

    def write(self, writes: Iterable[tuple[bytes, int, bytes | None]]) -> int:
        """Commit one batch of (key, op, value) and return its last sequence. All or nothing."""
        writes = list(writes)
        self._ready(write=True)
        for key, _, value in writes:
            oplog.check(key, value)
        return self.append(oplog.rows(self.spark, writes, self.committed + 1).coalesce(1), len(writes)) if writes else self.committed

    def append(self, rows: DataFrame, count: int, source: dict | None = None, maintain: bool = True) -> int:
        """Commit rows that carry the next ``count`` sequences. ``source`` is kept in the mark. Without ``maintain``, full units stay in the log until a later write or flush.

        Rows with other sequences are an error and change nothing; a failing log makes the engine read-only.
        """
        self._ready(write=True)
        first, last = self.committed + 1, self.committed + count
        path, seen = f"{self.folder}/log/{first:020d}-{last:020d}", Observation()
        began = time.perf_counter()
        sums = [F.count("*").alias("count"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum(octets("key", "value")).alias("bytes"), F.sum("crc").alias("crc")]
        try:
            if not self._held():
                raise Locked(f"another engine took {self.folder}")
            rows = oplog.stamped(rows).observe(seen, *sums)
            rows.write.option("parquet.block.size", self.options.segment_bytes).parquet(path)
            mark = {k: int(v or 0) for k, v in seen.get.items()}
            if (mark["first"], mark["last"], mark["count"]) != (first, last, count):
                self.files.delete(path)
                raise ValueError(f"a batch of sequences {mark['first']} to {mark['last']}, {mark['count']} rows, where {first} to {last} were due")
            self.files.create(f"{path}/{MARK}", json.dumps(mark | ({"source": source} if source else {})).encode())
        except ValueError:
            raise
        except Exception as e:
            self.failure = e
            raise ReadOnly("the log cannot be written") from e
        self._marks.append(mark | ({"source": source} if source else {}))
        self.committed = last
        self._count(commits=1, commit_records=count, commit_seconds=time.perf_counter() - began, user_bytes_written=mark["bytes"])
        if maintain:
            self._maintain()
        return last

    def last_of(self, name: str) -> int:
        """The newest committed batch number of a named source (streams replay batches after a failure); -1 if there is none."""
        flushed = self.catalog.version.sources.get(name, -1)
        return max([flushed, *[m["source"]["batch"] for m in self._marks if m.get("source", {}).get("name") == name]])

    # -- reads --------------------------------------------------------------------------------------------------------------------

    def view(self, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        """All record versions that may matter for [lower, upper): unflushed log and overlapping tables, at the committed sequence."""
        self._ready()
        return self._now().view(lower, upper)

    def get(self, key: bytes) -> tuple[bytes | None, bool]:
        self._ready()
        self._count(gets=1, probes=len(self.catalog.version.point(key)))
        return self._now().get(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return snapshot.multi_get(self.view(), keys, self.committed).select("key", "value")

    def scan(self, lower: bytes | None = None, upper: bytes | None = None, limit: int | None = None) -> DataFrame:
        """Live (key, value) of [lower, upper) in key order."""
        self._ready()
        return self._now().scan(lower, upper, limit)

    def as_of(self, seq: int, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        """The scan as it was at a sequence. Flushed tables keep one version a key, so sequences below the flushed one are refused."""
        if seq < self.catalog.version.last_seq:
            raise BelowHorizon(f"sequence {seq} is below the flushed sequence {self.catalog.version.last_seq}")
        return snapshot.scan(self.view(lower, upper), lower, upper, seq).select("key", "value")

    def history(self, key: bytes) -> DataFrame:
        return snapshot.history(self.view(key, key + b"\x00"), key)

    @contextmanager
    def snapshot(self) -> Iterator[Snapshot]:
        """The database of this moment, for reads that run later: vacuum spares its files until the block ends."""
        self._ready()
        now = self._now()
        held = [*[self._batch(m) for m in now.marks], *[t["path"] for t in now.tables()]]
        self._pins.update(held)
        try:
            yield now
        finally:
            self._pins.subtract(held)

    # -- background work ----------------------------------------------------------------------------------------------------------

    def flush(self) -> int:
        """Move the whole log into level-0 tables and return the number of keys written."""
        self._ready(write=True)
        return self._flush(self._marks)

    def _flush(self, marks: list[dict]) -> int:
        """Move the oldest batches into level-0 tables, and the checkpoint behind them."""
        began, v, last = time.perf_counter(), self.catalog.version, marks[-1]["last"] if marks else self.catalog.version.last_seq
        pending = snapshot.latest(self._log(marks), last, drop_tombstones=False)
        metas = self._write_tables(pending, 0, sum(m["bytes"] for m in marks), last - v.last_seq) if marks else []
        sources = {m["source"]["name"]: m["source"]["batch"] for m in marks if "source" in m}
        checkpoint = {"seq": last, "lsn": last, "tid": self._top(metas)} | ({"sources": v.sources | sources} if v.sources or sources else {})
        self.catalog.edit([*[{"op": ADD, "table": m} for m in metas], {"op": CHECKPOINT, "checkpoint": checkpoint}])
        self._marks = self._marks[len(marks) :]
        self._dead += [self._batch(m) for m in marks]
        self._count(flushes=1, flush_seconds=time.perf_counter() - began, flush_bytes_written=sum(m["sizeBytes"] for m in metas))
        return sum(m["keys"] for m in metas)

    def units(self) -> list[list[dict]]:
        """The unflushed batches as units of flushing, oldest first; the last one is still open."""
        return [[self._marks[i] for i in unit] for unit in oplog.rolled([m["bytes"] for m in self._marks], self.options.memtable_bytes)]

    def _maintain(self) -> None:
        """Flush the oldest full units beyond ``cached_immutables``, each by itself, then compact."""
        due = compaction.flushable(self.units()[:-1], self.options.cached_immutables)
        for unit in due:
            self._flush(unit)
        if due:
            self.compact()

    def compact(self) -> list[compaction.Plan]:
        """Run compactions until none is due; the plans that ran. Each moves data a level down, so they end."""
        done = []
        while plan := compaction.pick(self.catalog.version.plan_tables(), self.options):
            self.execute(plan)
            done.append(plan)
        return done

    def execute(self, plan: compaction.Plan) -> None:
        self._ready(write=True)
        began, v = time.perf_counter(), self.catalog.version
        inputs = [v.tables[t.id] for t in plan.inputs]
        if compaction.movable(plan):
            self.catalog.edit([{"op": ADD, "table": t | {"lvl": plan.target}} for t in inputs])
            self._count(moves=1)
            return
        drop = compaction.can_drop_tombstones(plan, v.plan_tables())
        merged = compaction.compact(self._tables(inputs), drop)
        size = sum(t["sizeBytes"] for t in inputs)
        metas = self._write_tables(merged, plan.target, size, compaction.estimate_keys(list(plan.inputs), size))
        gone = [{"op": REMOVE, "table": {"id": t["id"], "lvl": t["lvl"]}} for t in inputs]
        self.catalog.edit([*gone, *[{"op": ADD, "table": m} for m in metas]])
        self._dead += [t["path"] for t in inputs]
        self._count(compactions=1, compaction_seconds=time.perf_counter() - began, compaction_bytes_read=size, compaction_bytes_written=sum(m["sizeBytes"] for m in metas))

    def vacuum(self) -> int:
        """Delete replaced tables and flushed log batches that no open snapshot holds. Plans made outside of snapshots before the last flush or compaction must not run afterwards."""
        dead = [path for path in self._dead if self._pins[path] <= 0]
        self._dead = [path for path in self._dead if self._pins[path] > 0]
        for path in dead:
            self.files.delete(path)
        return len(dead)

    def tables(self) -> DataFrame:
        """The live tables, by level; newest first at level 0."""
        rows = [(t["ver"], t["id"], t["lvl"], t["path"], datetime.fromisoformat(t["ts"]), key_of(t["minKey"]), key_of(t["maxKey"]), t["keys"], t["sizeBytes"]) for t in self.catalog.version.all()]
        return self.spark.createDataFrame(rows, TABLE)

    def metrics(self) -> DataFrame:
        """(name, level, value): counters since the engine was made, and gauges of the log and of every level (level is null elsewhere)."""
        v, units = self.catalog.version, self.units()
        names = ["commits", "commit_records", "commit_seconds", "user_bytes_written", "gets", "probes", "flushes", "flush_seconds", "flush_bytes_written", "moves", "compactions", "compaction_seconds", "compaction_bytes_read", "compaction_bytes_written"]
        size = lambda marks: sum(m["bytes"] for m in marks)
        gauges = {"read_only": self.failure is not None, "committed": self.committed, "checkpoint": v.last_seq, "log_batches": len(self._marks), "log_bytes": size(self._marks)}
        gauges |= {"open_unit_bytes": size(units[-1]), "full_units": len(units) - 1, "retained_files": len(self._dead), "pinned_files": sum(n > 0 for n in self._pins.values())}
        rows = [(n, None, float(self.counters[n])) for n in names] + [(n, None, float(x)) for n, x in gauges.items()]
        for n in range(LEVELS):
            rows += [(k, n, float(x)) for k, x in (("tables", len(v.level(n))), ("table_bytes", sum(t["sizeBytes"] for t in v.level(n))), ("table_keys", sum(t["keys"] for t in v.level(n))))]
        return self.spark.createDataFrame(rows, "name string, level int, value double")

    def export(self, path: str, lower: bytes | None = None, upper: bytes | None = None, escape: bool = True) -> None:
        """Write a scan as text lines of key, tab, value. Tabs, newlines and backslashes are escaped unless ``escape`` is false."""
        plain = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n") if escape else c
        self.scan(lower, upper).select(F.concat_ws("\t", *[plain(F.col(c).cast("string")) for c in ("key", "value")]).alias("value")).write.text(path)

    # -- parts --------------------------------------------------------------------------------------------------------------------

    def _ready(self, write: bool = False) -> None:
        if not self._started:
            raise NotStarted("start() first")
        if write and self.failure:
            raise ReadOnly("an earlier log write failed") from self.failure

    def _count(self, **more: float) -> None:
        for k, n in more.items():
            self.counters[k] += n

    def _now(self) -> Snapshot:
        return Snapshot(self, list(self._marks), self.catalog.version, self.committed)

    def _batch(self, mark: dict) -> str:
        return f"{self.folder}/log/{mark['first']:020d}-{mark['last']:020d}"

    def _log(self, marks: list[dict], after: int | None = None) -> DataFrame:
        """Rows of log batches after the checkpoint."""
        if not marks:
            return self.spark.createDataFrame([], OPLOG)
        rows = self.spark.read.schema(OPLOG).option("parquet.page.verify-checksum.enabled", True).parquet(*[self._batch(m) for m in marks])
        return recovery.after(rows, self.catalog.version.last_seq if after is None else after)

    def _tables(self, tables: list[dict]) -> DataFrame:
        return self.spark.read.schema(OPLOG).option("parquet.page.verify-checksum.enabled", True).parquet(*[t["path"] for t in tables])

    def _top(self, metas: list[dict]) -> int:
        return max([self.catalog.version.top_id, *[m["id"] for m in metas]])

    def _write_tables(self, records: DataFrame, level: int, size: int, keys: int) -> list[dict]:
        """Sorted tables of about the target size with disjoint key ranges, and their catalog entries. size and keys: what the records have at most."""
        first = self.catalog.next_id()
        path = f"{self.folder}/tables/{first:020d}"
        self.files.delete(path)  # of an attempt that failed
        parts = max(1, -(-size // self.options.table_bytes))
        # ranges of keys alone, so that no key lies in two tables
        dealt = records.repartition(1) if parts == 1 else records.repartitionByRange(parts, "key")
        numbered = dealt.sortWithinPartitions("key", F.col("seq").desc()).withColumn("part", F.spark_partition_id())
        bits = self.options.bloom_bits_per_key
        fpp = (1 - math.exp(-bloom.probes(bits) / bits)) ** bloom.probes(bits)
        options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.expected.ndv#key": str(max(1, keys // parts)), "parquet.bloom.filter.fpp#key": f"{max(fpp, 1e-6):.6f}"}
        numbered.write.partitionBy("part").options(**options).parquet(path)
        written = self.spark.read.schema(numbered.schema).parquet(path)
        metas = written.groupBy("part").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("keys"), F.sum(octets("key", "value")).alias("size")).orderBy("lo").collect()
        now = datetime.now(UTC).isoformat()
        return [
            {"ver": 1, "id": first + i, "lvl": level, "path": f"{path}/part={m['part']}", "ts": now, "minKey": text_of(bytes(m["lo"])), "maxKey": text_of(bytes(m["hi"])), "keys": m["keys"], "sizeBytes": m["size"]}
            for i, m in enumerate(metas)
        ]


class Snapshot:
    """Reads of one moment: its log batches, its tables and its committed sequence."""

    def __init__(self, engine: Engine, marks: list[dict], version, committed: int):
        self.engine, self.marks, self.version, self.committed = engine, marks, version, committed

    def tables(self) -> list[dict]:
        return list(self.version.tables.values())

    def _rows(self, tables: list[dict]) -> DataFrame:
        out = self.engine._log(self.marks, self.version.last_seq)
        return out.unionByName(self.engine._tables(tables)) if tables else out

    def view(self, lower: bytes | None = None, upper: bytes | None = None) -> DataFrame:
        return snapshot.visible(self._rows(self.version.range(lower, upper)), self.committed)

    def get(self, key: bytes) -> tuple[bytes | None, bool]:
        if len(key) > oplog.MAX_KEY_BYTES:
            return None, False
        value, found = snapshot.point(snapshot.get(self._rows(self.version.point(key)), key, self.committed))
        return (None if value is None else bytes(value)), found

    def scan(self, lower: bytes | None = None, upper: bytes | None = None, limit: int | None = None) -> DataFrame:
        return snapshot.scan(self.view(lower, upper), lower, upper, self.committed, limit=limit).select("key", "value")
