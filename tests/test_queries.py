"""Every query that SQL can express against DuckDB, on the smallest tables."""

import dataclasses
import datetime
import os
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from kvlake import queries
from kvlake.plans.engine import Engine
from kvlake.schema import MAX_KEY_BYTES, MAX_VALUE_BYTES, Options

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    found = db.execute(queries.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == names
    want = sorted(repr(tuple(r[at.index(n)] for n in names)) for r in found.fetchall())
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


@pytest.mark.parametrize("count", [0, 1, 7, 13])
def test_all_of_level_0_is_compacted(spark, tmp_path, count):
    """The newest third of the runs, against plain Python; keys beyond the older runs' ranges lose their tombstones."""
    r = random.Random(count)
    at = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(count * 1000):
        user = r.randrange(900) if i // 1000 < count // 2 else r.randrange(300, 1200)
        rows.append((i, at, user, r.choice(["error", "view", "click"]), 1.0, f"p{i}"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    first = count - -(-count // 3)
    ranges, newest = [], {}
    for n in range(first):
        users = [f"u{x[2]:07d}" for x in rows[n * 1000 : (n + 1) * 1000]]
        ranges.append((min(users), max(users)))
    for i, _, user, kind, _, props in rows[first * 1000 :]:
        newest[f"u{user:07d}"] = (i + 1, 2, None) if kind == "error" else (i + 1, 1, f"{kind}|{props}")
    want = sorted((k, *x) for k, x in newest.items() if x[1] == 1 or any(a <= k <= b for a, b in ranges))
    got = sorted(tuple(x) for x in queries.QUERIES["kv_compact_l0"](spark, str(tmp_path)).select("k", "seq", "op", "v").collect())
    assert got == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(con.execute(queries.ORACLES["kv_compact_l0"]).fetchall()) == want


def _events(spark, folder, rows, pad=0):
    """A table of (event_id, user_id, event_type), and the same as a view of DuckDB; properties are ``pad`` bytes longer than they need be."""
    at = datetime.datetime(2024, 1, 1)
    full = [(i, at, user, kind, 1.0, f"p{i}" + "." * pad) for i, user, kind in rows]
    spark.createDataFrame(full, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return con


def test_runs_are_merged_in_one_plan(spark, tmp_path):
    """The plan does not grow with the number of runs; rows that are equal are in order."""
    con = _events(spark, tmp_path, [(i // 2 * 1000, 0 if i % 4 < 2 else i % 7, "error" if i % 3 == 0 else "view") for i in range(60)])
    df = queries.QUERIES["kv_merge_runs"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert sorted(tuple(r) for r in df.select("k", "seq", "op").collect()) == sorted(con.execute(queries.ORACLES["kv_merge_runs"]).fetchall())


def _small_units(monkeypatch):
    """Engines of the queries have the smallest units of flushing that options allow: 4 MiB and 4 KiB."""
    least = MAX_KEY_BYTES + MAX_VALUE_BYTES
    monkeypatch.setattr(queries, "Engine", lambda spark, folder, options=None: Engine(spark, folder, dataclasses.replace(options or Options(), memtable_bytes=least)))


@pytest.mark.parametrize(("count", "pad"), [(0, 0), (3, 0), (6, 0), (40, 250_000), (40, 300_000)])
def test_fourth_batch_is_damaged_wherever_it_lies(spark, tmp_path, monkeypatch, count, pad):
    """With no fourth batch, and with one or two batches a unit, so that units before it are flushed."""
    _small_units(monkeypatch)
    con = _events(spark, tmp_path, [(i, i % 7, "error" if i % 9 == 8 else "view") for i in range(count)], pad)
    got = queries.QUERIES["kv_recover_engine"](spark, str(tmp_path)).select("k", "v").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(queries.ORACLES["kv_recover_engine"]).fetchall())


def test_metrics_are_of_one_flush(spark, tmp_path, monkeypatch):
    """Five commits of two full units and an open one, and one flush."""
    _small_units(monkeypatch)
    con = _events(spark, tmp_path, [(i, i % 7, "error" if i % 9 == 8 else "view") for i in range(40)], 250_000)
    got = queries.QUERIES["kv_engine_metrics"](spark, str(tmp_path)).select("name", "value").collect()
    assert sorted(tuple(r) for r in got) == sorted(con.execute(queries.ORACLES["kv_engine_metrics"]).fetchall())


@pytest.mark.parametrize("missing", ["tiktoken", "public_tokenizers", "ahocorasick", "pyarrow", "corpus_pipeline", "kvlake.llm"])
def test_engine_queries_need_no_other_package(missing):
    """Whatever the training-data operators cannot import, the engine's queries stay."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split()
    assert [int(out[0]), int(out[1])] == [len(queries.QUERIES), len(queries.ORACLES)]
