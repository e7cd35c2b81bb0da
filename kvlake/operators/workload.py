"""Workload analytics: outcomes, log-bucket latency histograms, windows, streaks, backlog and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH = 1.01
STREAK = 10
RING = 100


def bucket(ns: Column) -> Column:
    """Histogram bucket of a latency: each bucket is 1 % wider than the one before; 0 ns and less is bucket 0."""
    return F.when(ns <= 0, F.lit(0).cast("long")).otherwise((F.ceil(F.ln(ns) / F.ln(F.lit(WIDTH))) + 1).cast("long"))


def upper_bound(index: Column) -> Column:
    """Largest latency of a bucket, at most 2^63 - 1 ns."""
    upper = F.exp((index - 1) * F.ln(F.lit(WIDTH)))
    return F.when(index <= 0, F.lit(0).cast("long")).when(upper >= float(1 << 63), F.lit((1 << 63) - 1)).otherwise(F.ceil(upper).cast("long"))


def histogram(df: DataFrame, by: str, ns: Column) -> DataFrame:
    """(by, bucket, n): partial counts merge, so this is one small shuffle however many rows there are."""
    return df.groupBy(by, bucket(ns).alias("bucket")).agg(F.count("*").alias("n"))


def percentiles(hist: DataFrame, by: str, shares: dict[str, float]) -> DataFrame:
    """For every group the upper bound of the first bucket whose cumulative count reaches ceil(share * total)."""
    upto = Window.partitionBy(by).orderBy("bucket")
    cum = hist.withColumn("cum", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(by)))
    found = cum.groupBy(by).agg(*[F.min(F.when(F.col("cum") >= F.ceil(F.col("total") * p), F.col("bucket"))).alias(name) for name, p in shares.items()])
    return found.select(by, *[upper_bound(F.col(name)).alias(name) for name in shares])


def outcomes(df: DataFrame, *by: str, **totals: Column) -> DataFrame:
    """Requests of each outcome, and how many of them fulfil further conditions."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(name) for name, c in totals.items()])


def outcome_rank(kind: Column, order: list[str]) -> Column:
    """Place of an outcome class in a fixed order; unknown classes come last."""
    out = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        out = F.when(kind == name, i).otherwise(out)
    return out


def utilisation(busy_ns: Column, workers: int, elapsed_ns: Column) -> Column:
    """Share of the workers' time that was spent on requests, in 0..1."""
    return F.least(F.greatest(F.try_divide(busy_ns.cast("double"), elapsed_ns * workers), F.lit(0.0)), F.lit(1.0))


def windows(df: DataFrame, at: Column, length: str, *by: str) -> DataFrame:
    """Counts in tumbling windows."""
    return df.groupBy(F.window(at, length).alias("w"), *by).agg(F.count("*").alias("n")).withColumn("start_us", F.unix_micros(F.col("w.start"))).drop("w")


def _slices(df: DataFrame, order: str, slices: int) -> Column:
    """Number of a row's slice: the order is cut at approximate quantiles, so no slice holds much more than its share; nulls come first."""
    shares = [i / slices for i in range(1, slices)]
    cuts = df.agg(F.percentile_approx(order, shares, 10 * slices)).first()[0] or []  # a sketch; ``slices`` values
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda cut: cut <= F.col(order))) if cuts else F.lit(0)


def streaks(df: DataFrame, by: str, order: str, failed: Column, slices: int = 256) -> DataFrame:
    """Longest run of consecutive failures of every group, and whether it reaches the alarm threshold; a null is no failure.

    A group's rows are walked in slices of the order, each by itself, so a hot group is not one task's work. A run that crosses slices is
    put together from slice totals: it begins after the last success of the slices before.
    """
    rows = df.select(by, order, F.coalesce(failed, F.lit(False)).alias("failed"))
    rows = rows.withColumn("slice", _slices(rows, order, slices))
    at = Window.partitionBy(by, "slice").orderBy(order)
    placed = rows.withColumn("at", F.row_number().over(at).cast("long")).withColumn("good", F.when(~F.col("failed"), F.col("at")))
    since = F.col("at") - F.coalesce(F.max("good").over(at.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    each = placed.withColumn("since", since).groupBy(by, "slice").agg(F.count("*").alias("n"), F.max("since").alias("inner"), F.min("good").alias("first_good"), F.max("good").alias("last_good"))
    before = Window.partitionBy(by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    summed = each.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("good_at", F.col("begin") + F.col("last_good"))
    carried = F.col("begin") - F.coalesce(F.max("good_at").over(before), F.lit(0))
    crossing = carried + F.coalesce(F.col("first_good") - 1, F.col("n"))
    longest = summed.select(by, F.greatest("inner", crossing).alias("streak")).groupBy(by).agg(F.max("streak").cast("long").alias("streak"))
    return longest.withColumn("alarm", F.col("streak") >= STREAK)


def ring(df: DataFrame, shard: Column, order: str, size: int = RING) -> DataFrame:
    """The last ``size`` rows of every shard; a group limit prunes before the shuffle."""
    nth = F.row_number().over(Window.partitionBy("shard").orderBy(F.col(order).desc()))
    return df.withColumn("shard", shard).withColumn("__nth", nth).filter(F.col("__nth") <= size).drop("__nth")


def schedule(spark: SparkSession, rate: int, count: int) -> DataFrame:
    """Due times of an open-loop schedule: arrival i at i / rate seconds."""
    return spark.range(count).select(F.col("id").alias("arrival"), F.expr(f"id * 1000000000 div {rate}").alias("due_ns"))


def scheduled_count(rate: float, seconds: float) -> int:
    """Arrivals of a run: those due before its end, one at least."""
    arrivals = rate * seconds
    if not math.isfinite(arrivals) or arrivals >= 2.0**64:
        raise ValueError("the schedule is out of range")
    return max(1, math.ceil(math.nextafter(arrivals, -math.inf)))


def waits(df: DataFrame) -> DataFrame:
    """Queueing of requests (due_ns, start_ns): total, largest and late ones."""
    late = F.greatest(F.col("start_ns") - F.col("due_ns"), F.lit(0))
    return df.agg(F.sum(late).cast("long").alias("wait_ns"), F.max(late).alias("max_wait_ns"), F.count_if(late > 0).alias("late"))


def backlog(df: DataFrame, opened: Column, closed: Column, slots: int = 256) -> DataFrame:
    """Largest number of requests open at once; at equal times opens count before closes.

    Two levels: times are cut at quantiles into ``slots`` spans, each span is walked by itself, and what was open before it comes from a
    prefix sum over span totals. So no window holds much more than its share of the times, bursts included.
    """
    steps = df.select(F.explode(F.array(F.struct(opened.alias("at"), F.lit(1).alias("d")), F.struct(closed.alias("at"), F.lit(-1).alias("d")))).alias("s")).select("s.at", "s.d")
    sums = steps.groupBy("at").agg(F.sum(F.when(F.col("d") > 0, 1).otherwise(0)).alias("opens"), F.sum("d").alias("net"))
    spans = sums.withColumn("span", _slices(steps, "at", slots))
    before_span = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # a row a span
    totals = spans.groupBy("span").agg(F.sum("net").alias("t")).select("span", F.coalesce(F.sum("t").over(before_span), F.lit(0)).alias("base"))
    before = Window.partitionBy("span").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    walked = spans.withColumn("running", F.coalesce(F.sum("net").over(before), F.lit(0))).join(F.broadcast(totals), "span")
    return walked.agg(F.max(F.col("base") + F.col("running") + F.col("opens")).cast("long").alias("peak"))


def lag_limit_ns(rate: float) -> int:
    """How late starts may be: two arrival intervals, a millisecond at least."""
    return max(1_000_000, 2 * int(1e9 / rate))


def diagnose(report: DataFrame, rate: float) -> DataFrame:
    """report with ``diagnosis``, null where nothing limits the run.

    report: scheduled, overrun_ns (how late the last start was), start_p99_ns, max_backlog, utilisation (0..1), wait_ns and
    max_wait_ns (time that scheduling was blocked).
    """
    lag = lag_limit_ns(rate)
    late_end = F.col("overrun_ns") > lag
    behind = late_end | ((F.col("start_p99_ns") > lag) & (F.col("max_backlog") > max(2, math.ceil(rate * lag / 1e9))))
    blocked = F.col("wait_ns") >= F.greatest(F.lit(lag), F.expr("overrun_ns div 2"))
    verdict = (
        F.when(F.col("scheduled") == 0, None)
        .when(behind & (F.col("utilisation") >= 0.8), F.when(late_end, "server or workers too slow for the rate").otherwise("server or workers too slow at times"))
        .when(behind & blocked, F.when(late_end, "generator limits the rate").otherwise("generator under pressure at times"))
        .when(behind, "generator or host scheduling delays starts")
        .when((F.col("start_p99_ns") > lag) & (F.col("max_wait_ns") < lag) & (F.col("utilisation") < 0.5), "scheduling jitter")
    )
    return report.withColumn("diagnosis", verdict)
