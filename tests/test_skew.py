"""Skew-safe scans against the direct window, on fixtures derived from the
driver's tables with hot keys, heavy timestamp ties (whole hours or minutes
share one timestamp), and NULL keys, times and values."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF_SMALL
from kestrel.functions.scans import count_at_or_before, prefix_before, previous_in_order
from kestrel.operators import graph
from kestrel.operators.timeseries import cooldown, trailing_count
from kestrel.sources import tables as T


def _hot_logs(spark, unit):
    """Logs with timestamps truncated to ``unit`` (ties) and two users."""
    logs = T.load_logs(spark, SF_SMALL)
    return logs.select("event_id", F.date_trunc(unit, "timestamp").cast("timestamp_ntz").alias("timestamp"),
                       (F.col("user_id") % 2).alias("user_id"), "service", "error_count")


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _with_nulls(rows):
    """Every 11th service, every 13th time and every 17th user is NULL."""
    blank = {"service": 11, "timestamp": 13, "user_id": 17}
    return rows.select(*[F.when(F.col("event_id") % blank[c] != 0, F.col(c)).alias(c) if c in blank else c for c in rows.columns])


@pytest.fixture(params=["true", "false"])
def coalesced(spark, request):
    """Ranges put together, and each by itself, so that keys and windows cross their borders."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, old)


def test_trailing_count_with_ties_and_nulls(spark, coalesced):
    rows = _with_nulls(_hot_logs(spark, "minute").select("event_id", "timestamp", "service"))
    for keys in (["service"], []):
        for w_us in (300 * 10**6, 3600 * 10**6):
            direct = rows.withColumn("window_count", F.when(F.col("timestamp").isNull(), F.lit(0)).otherwise(
                F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(F.unix_micros(F.col("timestamp").cast("timestamp")))
                                       .rangeBetween(-(w_us - 1), 0))))
            got = trailing_count(rows, w_us, keys)
            assert got.columns == direct.columns
            assert _same(got, direct), (keys, w_us)


def test_trailing_count_small_cells(spark):
    """Cells much smaller than the window: many cells per lookup."""
    rows = T.load_logs(spark, SF_SMALL).select("event_id", "timestamp", "service")
    w_us = 7200 * 10**6
    direct = rows.withColumn("window_count", F.count(F.lit(1)).over(
        Window.partitionBy("service").orderBy(F.unix_micros(F.col("timestamp").cast("timestamp")))
        .rangeBetween(-(w_us - 1), 0)))
    got = trailing_count(rows, w_us, ["service"], cell_us=60 * 10**6)
    assert _same(got, direct)


def test_previous_in_order_with_ties_and_nulls(spark):
    rows = _with_nulls(_hot_logs(spark, "hour"))
    direct = rows.withColumn("prev", F.lag("service").over(
        Window.partitionBy("user_id").orderBy("timestamp", "event_id")))
    for n in ("1", "8", "40"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = previous_in_order(rows, "user_id", ["timestamp", "event_id"], "service", "prev")
        assert _same(got.select(*direct.columns), direct), n
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_previous_value_null_is_not_an_earlier_one(spark):
    rows = spark.createDataFrame([(1, 10, "a"), (1, 11, None), (1, 12, "c")], "k int, t int, v string")
    got = {r["t"]: r["prev"] for r in previous_in_order(rows, "k", ["t"], "v", "prev").collect()}
    assert got == {10: None, 11: "a", 12: None}


def _greedy(rows, seconds):
    fired, last = set(), {}
    for key, n, t in sorted(rows, key=lambda r: (str(r[0]), r[2] is None, r[2], r[1])):
        if t is not None and (key not in last or t >= last[key] + seconds):
            last[key] = t
            fired.add((key, n))
    return fired


def test_cooldown_segments_equal_the_greedy_rule(spark):
    rng = random.Random(7)
    start = datetime(2024, 1, 1)
    for span, segment in ((400, 5), (4000, 7), (4000, 100_000), (60, 3)):
        rows = [(rng.choice(["a", "a", "b", None]), i, rng.randrange(span * 4) / 4 if rng.random() < 0.95 else None)
                for i in range(300)]
        df = spark.createDataFrame([(k, i, None if t is None else start + timedelta(seconds=t)) for k, i, t in rows],
                                   "service string, event_id long, timestamp timestamp_ntz")
        for seconds in (10, 37):
            got = {(r["service"], r["event_id"]) for r in cooldown(df, seconds, segment_points=segment).collect()}
            assert got == _greedy(rows, seconds), (span, segment, seconds)


def test_cooldown_goes_on_after_earlier_firings(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", i, start + timedelta(seconds=10 * i)) for i in range(10)],
                               "service string, event_id long, timestamp timestamp_ntz")
    whole = {r["event_id"] for r in cooldown(df, 25).collect()}
    head = cooldown(df.where("event_id < 4"), 25)
    last = head.groupBy("service").agg(F.max(F.unix_micros(F.col("fired_at").cast("timestamp"))).alias("last_us"))
    tail = cooldown(df.where("event_id >= 4"), 25, last=last)
    assert whole == {r["event_id"] for r in head.unionByName(tail).collect()}


def test_prefix_before_two_levels(spark):
    tot = spark.range(0, 500).select(F.lit("a").alias("k"), (F.col("id") * 7).alias("pos"),
                                     (F.col("id") % 13).alias("v"))
    got = prefix_before(tot, ["k"], "pos", "v", span=50)
    want = tot.select("k", "pos", F.coalesce(F.sum("v").over(
        Window.partitionBy("k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_before"))
    assert _same(got, want)


def test_count_at_or_before_ties_lookup_after_point(spark):
    pts = spark.createDataFrame([("a", 10, 3), ("a", 20, 2), ("b", 10, 5)], "k string, _t long, _c long")
    looks = spark.createDataFrame([("a", 10, 1), ("a", 9, 2), ("a", 25, 3), ("b", 5, 4), (None, 5, 5)],
                                  "k string, _x long, _id long")
    got = {r["_id"]: r["_r"] for r in count_at_or_before(pts, looks, ["k"], cell_us=7)
           .where("_probe = 1").collect()}
    assert got == {1: 3, 2: 0, 3: 5, 4: 0, 5: 0}


def test_edge_obs_match_with_repeated_timestamps(spark):
    """Store and log rows sharing timestamps: dedupe keeps counts and min seq."""
    e = T.load_edges(spark, SF_SMALL)
    e = e.select("from_service", "to_service",
                 F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "seq")
    got = graph.edge_obs_match(e, e)
    a, b = e.alias("a"), e.alias("b")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    brute = (a.join(b, (F.col("a.from_service") == F.col("b.from_service"))
                    & (F.col("a.to_service") == F.col("b.to_service"))
                    & (F.abs(us(F.col("a.ts")) - us(F.col("b.ts"))) < 1000))
             .groupBy(F.col("a.seq").alias("log_seq"))
             .agg(F.min("b.seq").alias("matched_seq"), F.count(F.lit(1)).alias("candidates")))
    assert _same(got.select("log_seq", "matched_seq", "candidates"), brute)
