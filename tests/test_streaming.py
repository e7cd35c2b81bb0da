"""Streaming views over files that arrive in two batches."""

from kvlake.operators import recovery
from kvlake.streaming import ingest


def drain(df, mode, path):
    seen = []
    df.writeStream.outputMode(mode).foreachBatch(lambda rows, _: seen.extend(rows.collect())).option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return seen


def test_latest_view_updates(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("a", 2, 2, None), ("b", 3, 1, "y")], "key string, seq long, op int, value string")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    view = ingest.latest_view(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    assert sorted(tuple(r) for r in drain(view, "update", str(tmp_path / "cp"))) == [("a", 2, 2, None), ("b", 3, 1, "y")]


def test_window_report(spark, tmp_path):
    rows = spark.createDataFrame([(0, "ok"), (4, "ok"), (4, "bad"), (7, "ok"), (60, "ok")], "s int, outcome string").selectExpr("timestamp_seconds(s) as ts", "outcome")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    report = ingest.window_report(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    got = {(r["window"]["start"].second, r["outcome"]): r["count"] for r in drain(report, "update", str(tmp_path / "cp"))}
    assert got[(0, "ok")] == 2 and got[(0, "bad")] == 1 and got[(5, "ok")] == 1


def test_expired_log_files(spark):
    files = spark.createDataFrame([("a", 3), ("b", 9)], "name string, max_lsn long")
    assert [r["name"] for r in recovery.expired(files, 9).collect()] == ["a"]
