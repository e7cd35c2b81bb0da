"""The engine end to end: writes, reads, recovery, flush, compaction, catalog rules."""

import random
import shutil

import pytest

from kvlake.operators import compaction
from kvlake.operators.compaction import Plan, Table
from kvlake.plans.engine import Engine
from kvlake.schema import ADD, CHECKPOINT, REMOVE, BelowHorizon, Corrupt, Locked, NotStarted, Options, ReadOnly
from kvlake.sources import oplog
from kvlake.sources.catalog import Catalog, Version, parse, text_of
from kvlake.sources.store import Files
from kvlake.streaming import ingest

MIB = 1 << 20


def scan(engine, *bounds):
    return [(bytes(r["key"]), bytes(r["value"])) for r in engine.scan(*bounds).collect()]


def test_life_of_keys(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db")) as e:
        e.write([(b"b", 1, b"old-b"), (b"d", 1, b"old-d"), (b"e", 1, b"old-e"), (b"gone", 1, b"x")])
        e.delete(b"gone")
        e.flush()
        e.write([(b"a", 1, b"new-a"), (b"b", 1, b"new-b"), (b"d", 2, None)])
        want = [(b"a", b"new-a"), (b"b", b"new-b"), (b"e", b"old-e")]
        assert scan(e) == want
        assert scan(e, b"b", b"e") == [(b"b", b"new-b")]
        assert e.get(b"d") == (None, False) and e.get(b"gone") == (None, False)
        early = e.scan()
        e.flush()
        with pytest.raises(BelowHorizon):
            e.as_of(1)
        assert [tuple(map(bytes, r)) for r in early.collect()] == want  # planned before the flush
        e.vacuum()
        committed = e.committed
    with pytest.raises(NotStarted):
        e.scan()
    with Engine(spark, str(tmp_path / "db")) as again:
        assert again.committed == committed
        assert scan(again) == want
        assert again.get(b"e") == (b"old-e", True)
        assert {(r["name"], r["level"]): r["value"] for r in again.metrics().collect()}["tables", 0] == 2
        assert [r["lvl"] for r in again.tables().collect()] == [0, 0]


def test_recovery_takes_rows_after_the_checkpoint(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db")) as e:
        e.set(b"a", b"1")
        e.flush()
        e.write([(b"a", 1, b"2"), (b"c", 1, b"3")])
    with Engine(spark, str(tmp_path / "db")) as e:
        assert scan(e) == [(b"a", b"2"), (b"c", b"3")]
        assert e.committed == 3


def test_failed_log_makes_it_read_only(spark, tmp_path):
    taken = tmp_path / "db" / "log" / f"{2:020d}-{2:020d}"
    with Engine(spark, str(tmp_path / "db")) as e:
        e.set(b"a", b"1")
        taken.mkdir()  # the next batch's place is taken
        with pytest.raises(ReadOnly):
            e.set(b"b", b"2")
        with pytest.raises(ReadOnly):
            e.delete(b"a")
        assert e.err() is not None and e.get(b"a") == (b"1", True)
    with Engine(spark, str(tmp_path / "db")) as e:  # an aborted batch does not outlive a restart
        assert not taken.exists()
        e.set(b"b", b"2")
        assert scan(e) == [(b"a", b"1"), (b"b", b"2")]
        with pytest.raises(ValueError, match="were due"):
            e.append(oplog.rows(spark, [(b"c", 1, b"3")], 9), 1)
        e.set(b"c", b"3")
        assert e.err() is None


class Died(Exception):
    pass


class Mortal(Files):
    """Files that die after a number of changes."""

    def __init__(self, spark, steps):
        super().__init__(spark)
        self.steps = steps

    def _step(self):
        if self.steps == 0:
            raise Died
        self.steps -= 1

    def create(self, path, data):
        self._step()
        super().create(path, data)

    def delete(self, path):
        self._step()
        super().delete(path)


def test_death_between_any_two_steps(spark, tmp_path):
    """However many file steps a run gets before it dies, a new engine finds all acknowledged writes."""
    batches = [[(b"a", 1, b"1"), (b"b", 1, b"2")], [(b"a", 2, None)], [(b"c", 1, b"3"), (b"b", 1, b"4")]]
    for steps in range(40):
        folder, model, acked = str(tmp_path / f"db{steps}"), {}, 0
        e = Engine(spark, folder, Options(l0_trigger=2, stale_records=3))
        e.files = e.catalog.files = Mortal(spark, steps)
        finished = False
        try:
            e.start()
            for batch in batches:
                e.write(batch)
                acked += 1
                e.flush()
                e.compact()
                e.vacuum()
            finished = True
        except (Died, ReadOnly):
            pass
        again = Engine(spark, folder).start(takeover=True)
        done = [b for b in batches if b][: max(acked, [0, 2, 3, 5].index(again.committed))]
        for batch in done:
            model.update({k: v for k, _, v in batch})
        assert acked <= [0, 2, 3, 5].index(again.committed) <= acked + 1
        assert scan(again) == sorted((k, v) for k, v in model.items() if v is not None), steps
        again.write([(b"z", 1, b"9")])
        assert again.get(b"z") == (b"9", True)
        again.stop()
        if finished:
            break
    assert finished


def test_one_engine_at_a_time(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db")) as e:
        with pytest.raises(Locked):
            Engine(spark, str(tmp_path / "db")).start()
        other = Engine(spark, str(tmp_path / "db")).start(takeover=True)
        other.set(b"a", b"1")
        with pytest.raises(ReadOnly):
            e.set(b"b", b"2")
        other.stop()
    shutil.rmtree(tmp_path / "db" / "catalog")
    with pytest.raises(Corrupt):
        Engine(spark, str(tmp_path / "db")).start()
    assert list((tmp_path / "db" / "log").iterdir()) and not (tmp_path / "db" / "LOCK").exists()


def damage(folder, first, last):
    """Replace the rows of a log batch by others."""
    path = folder / "log" / f"{first:020d}-{last:020d}"
    for f in path.glob("*.parquet"):
        f.write_bytes(f.read_bytes()[:-20])
        (path / f".{f.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("policy", ["stop", "truncate"])
def test_damaged_batches(spark, tmp_path, policy):
    db = tmp_path / "db"
    with Engine(spark, str(db)) as e:
        for i in range(1, 5):
            e.set(f"k{i}".encode(), b"v")
    damage(db, 4, 4)
    with Engine(spark, str(db)) as e:  # a torn tail is cut under either policy
        assert [k for k, _ in scan(e)] == [b"k1", b"k2", b"k3"]
        e.set(b"k5", b"v")
    damage(db, 2, 2)
    again = Engine(spark, str(db), Options(corruption=policy))
    if policy == "stop":
        with pytest.raises(Corrupt) as x:
            again.start()
        assert x.value.lsn == 2 and not (db / "LOCK").exists()
    else:
        assert again.start().committed == 1 and [k for k, _ in scan(again)] == [b"k1"]
        again.set(b"k6", b"v")
        assert again.get(b"k6") == (b"v", True)
        again.stop()


def test_full_units_are_flushed(spark, tmp_path):
    """Batches of 2 MiB: two fill a unit of 5 MiB; one full unit stays in the log, older ones become tables."""
    big = b"x" * (2 * MIB)
    with Engine(spark, str(tmp_path / "db"), Options(memtable_bytes=5 * MIB, cached_immutables=1)) as e:
        sizes = []
        for i in range(7):
            e.set(f"k{i}".encode(), big)
            sizes.append((len(e.catalog.version.tables), [len(u) for u in e.units()]))
        assert sizes == [(0, [1]), (0, [2]), (0, [2, 1]), (0, [2, 2]), (1, [2, 1]), (1, [2, 2]), (2, [2, 1])]
        assert [k for k, _ in scan(e)] == [f"k{i}".encode() for i in range(7)]
        assert len(list((tmp_path / "db" / "log").iterdir())) == 7
    with Engine(spark, str(tmp_path / "db")) as e:  # flushed batches are removed at the latest at the next start
        assert len(list((tmp_path / "db" / "log").iterdir())) == 3 and e.committed == 7


def test_snapshots_keep_their_files(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db"), Options(l0_trigger=2)) as e:
        e.set(b"a", b"1")
        e.flush()
        with e.snapshot() as then:
            e.write([(b"a", 1, b"2"), (b"b", 1, b"3")])
            e.flush()
            e.compact()
            e.vacuum()
            assert [tuple(map(bytes, r)) for r in then.scan().collect()] == [(b"a", b"1")] and then.get(b"b") == (None, False)
            assert scan(e) == [(b"a", b"2"), (b"b", b"3")]
        assert e.vacuum() == 1


def test_damaged_tables_are_an_error(spark, tmp_path):
    with Engine(spark, str(tmp_path / "db")) as e:
        e.write([(f"k{i}".encode(), 1, b"value" * 20) for i in range(200)])
        e.flush()
        [f] = (tmp_path / "db" / "tables").glob("*/*/*.parquet")
        data = bytearray(f.read_bytes())
        data[100] ^= 0xFF
        f.write_bytes(data)
        (f.parent / f".{f.name}.crc").unlink()
        with pytest.raises(Exception, match="(?i)crc|checksum|corrupt|could not read page"):
            scan(e)


def test_random_work_matches_a_model(spark, tmp_path):
    r, model = random.Random(3), {}
    with Engine(spark, str(tmp_path / "db"), Options(l0_trigger=2, table_bytes=60)) as e:
        for _ in range(5):
            writes = []
            for _ in range(25):
                k = f"k{r.randrange(20):02d}".encode()
                v = None if r.random() < 0.3 else f"v{r.randrange(999)}".encode()
                writes.append((k, 1 if v is not None else 2, v))
                model[k] = v
            e.write(writes)
            e.flush()
            e.compact()
        assert scan(e) == sorted((k, v) for k, v in model.items() if v is not None)
        tables = e.catalog.version.level(1)
        assert all(a["maxKey"] < b["minKey"] for a, b in zip(tables, tables[1:], strict=False)) and len(tables) > 1


def test_stream_ingest(spark, tmp_path):
    rows = spark.createDataFrame([(b"a", 1, b"1", 1), (b"b", 1, b"2", 2), (b"a", 2, None, 3), (b"", 1, b"x", 4)], "key binary, op int, value binary, arrival int")
    rows.write.parquet(str(tmp_path / "in"))
    with Engine(spark, str(tmp_path / "db")) as e:
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        ingest.ingest(stream, e, str(tmp_path / "cp"), flush_rows=1).awaitTermination()
        assert scan(e) == [(b"b", b"2")]
        assert len(e.catalog.version.tables) == 1
        committed = e.committed
        for _ in range(2):  # the stream's progress is lost: its batches are replayed, and committed once
            shutil.rmtree(tmp_path / "cp")
            ingest.ingest(stream, e, str(tmp_path / "cp")).awaitTermination()
        assert e.committed == committed and e.last_of("stream") == 0
    with Engine(spark, str(tmp_path / "db")) as e:
        assert e.last_of("stream") == 0 and e.last_of("other") == -1


def t(i, level, lo, hi, size=MIB):
    return Table(i, level, lo.encode(), hi.encode(), size)


@pytest.mark.parametrize(
    "tables, level, ids",
    [
        ([t(1, 0, "a", "c"), t(2, 0, "d", "f"), t(3, 0, "g", "i"), t(4, 1, "a", "z")], None, []),
        ([t(1, 0, "b", "c"), t(2, 0, "c", "d"), t(3, 0, "d", "e"), t(4, 0, "e", "f"), t(5, 0, "x", "y"), t(6, 1, "a", "b"), t(7, 1, "f", "g"), t(8, 1, "m", "n")], 0, [1, 2, 3, 4, 6, 7]),
        ([t(1, 1, "a", "c", 200 * MIB), t(2, 1, "m", "n", 200 * MIB), t(3, 2, "b", "d", 2000 * MIB), t(4, 2, "m", "o", 100 * MIB)], 1, [2, 4]),
        ([t(1, 4, "a", "z", MIB * MIB)], None, []),
    ],
)
def test_picking(tables, level, ids):
    plan = compaction.pick(tables, Options())
    assert (plan.level if plan else None, sorted(x.id for x in plan.inputs) if plan else []) == (level, ids)


def test_targets():
    assert compaction.level_targets(1 << 30, Options()) == [0, 256 * MIB, 2560 * MIB, 25600 * MIB, 0]
    assert compaction.level_targets(10 << 40, Options()) == [0, (10 << 40) // 1000, (10 << 40) // 100, (10 << 40) // 10, 0]


def test_moves_and_tombstones():
    apart = tuple(t(i, 0, k, k) for i, k in enumerate("abcd"))
    assert compaction.movable(Plan(0, 1, apart))
    assert not compaction.movable(Plan(3, 4, (t(1, 3, "a", "b"),)))
    assert not compaction.movable(Plan(0, 1, (t(1, 0, "a", "c"), t(2, 0, "b", "d"))))
    plan = Plan(0, 1, (t(1, 0, "a", "c"), t(2, 0, "a", "b")))
    assert not compaction.can_drop_tombstones(plan, [*plan.inputs, t(3, 2, "b", "b")])
    assert compaction.can_drop_tombstones(plan, [*plan.inputs, t(3, 2, "x", "x")])
    same = Plan(1, 2, (t(1, 1, "a", "b"),))
    assert not compaction.can_drop_tombstones(same, [*same.inputs, t(9, 1, "b", "b")])


def test_estimate():
    four = [Table(i, 0, b"a", b"b", 1000, 100) for i in range(4)]
    assert [compaction.estimate_keys(four, n) for n in (MIB, 1000)] == [400, 100]
    assert compaction.estimate_keys([Table(1, 0, b"a", b"b", 0, 2)], 5) == 2


def add(i, level=0, lo="a", hi="b"):
    return {"op": ADD, "table": {"ver": 1, "id": i, "lvl": level, "path": f"p{i}", "minKey": text_of(lo.encode()), "maxKey": text_of(hi.encode()), "keys": 1, "sizeBytes": 1}}


def checkpoint(seq, lsn):
    return {"op": CHECKPOINT, "checkpoint": {"seq": seq, "lsn": lsn}}


def test_versions():
    v = Version().apply([add(2), add(5, 1, "m", "p"), add(1, 1, "a", "c"), add(3, 1, "e", "g")])
    assert [x["id"] for x in v.level(1)] == [1, 3, 5]
    assert [x["id"] for x in v.point(b"f")] == [3]
    assert [x["id"] for x in v.range(b"b", b"f")] == [2, 1, 3] and [x["id"] for x in v.range(b"b", b"e")] == [2, 1]
    v = v.apply([add(2, 1, "x", "z")])
    assert not v.level(0) and len(v.level(1)) == 4
    v = v.apply([add(7), {"op": REMOVE, "table": {"id": 7, "lvl": 1}}, checkpoint(17, 42)])
    assert v.top_id == 7 and 7 not in v.tables
    for bad in ([checkpoint(16, 41)], [checkpoint(18, 43), add(9)]):
        with pytest.raises(ValueError, match="checkpoint"):
            v.apply(bad)


def test_catalog_file(spark, tmp_path):
    path = tmp_path / "catalog"
    c = Catalog(Files(spark), str(path), stale_limit=5)
    c.create()
    c.edit([add(50), add(40), add(60), add(3, 1), checkpoint(1, 1)])
    for _ in range(8):
        c.edit([add(70), {"op": REMOVE, "table": {"id": 70, "lvl": 0}}])
    assert c.records < 12 and len(list(path.glob("*.jsonl"))) < 4
    again = Catalog(Files(spark), str(path))
    state = again.open()
    assert [x["id"] for x in state.level(0)] == [60, 40, 50] and state.last_seq == 1 and state.top_id == 70 and again.next_id() == 71
    with pytest.raises(FileExistsError):  # two writers of one number
        again.edit([add(80)])
        c.edit([add(81)])
    assert parse(b'{"op": 3}\n{"op": 1, "tab')[1] > 0
    (path / ".leftover.tmp").write_bytes(b"{")
    c = Catalog(Files(spark), str(path), stale_limit=1000)
    assert c.open().top_id == 80 and not (path / ".leftover.tmp").exists()
    c.edit([add(90)])
    c.edit([add(91)])
    last = sorted(path.glob("*.edit.jsonl"))
    last[-1].write_bytes(last[-1].read_bytes() + b'{"op": 1, "table": {"id"')
    (path / f".{last[-1].name}.crc").unlink(missing_ok=True)
    assert Catalog(Files(spark), str(path)).open().top_id == 91  # a torn line is cut
    with pytest.raises(Corrupt):
        parse(b'{"op": 2, "table": {"id": 1}}\n{not-json}\n')
    last[-2].unlink()
    with pytest.raises(Corrupt):
        Catalog(Files(spark), str(path)).open()


def test_compacts_until_no_level_is_over_its_target(spark, tmp_path):
    def table(n):
        key = text_of(f"k{n:04d}".encode())
        return {"ver": 1, "id": n, "lvl": 1, "path": f"none/{n}", "ts": "2024-01-01T00:00:00+00:00", "minKey": key, "maxKey": key, "keys": 1, "sizeBytes": 200 * MIB}

    with Engine(spark, str(tmp_path / "db")) as e:
        e.catalog.edit([{"op": ADD, "table": table(n)} for n in range(1, 121)])
        assert len(e.compact()) > 100  # disjoint tables: only moves
        assert compaction.pick(e.catalog.version.plan_tables(), e.options) is None
        goal = compaction.level_targets(0, e.options)
        sizes = {n: sum(t["sizeBytes"] for t in e.catalog.version.level(n)) for n in (1, 2, 3)}
        assert all(sizes[n] <= goal[n] for n in sizes) and sum(sizes.values()) == 120 * 200 * MIB
