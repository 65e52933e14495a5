"""Streams with state of their own: out-of-order candidates, late, missing and early diagnoses, counters, deltas."""

import os
import random
import tempfile
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel.operators import timeseries
from kestrel.streaming import pipeline as S
from kestrel.streaming import stateful

T0 = datetime(2024, 3, 1, 12, 0, 0)
CANDIDATES = "service string, event_id long, timestamp timestamp_ntz"


def _tmp():
    return tempfile.mkdtemp(prefix="kestrel-test-")


def _stream(spark, folder, schema, parts):
    """A folder of one file per part, read one file a micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):        # files are taken in the order of their times
            if f.endswith(".parquet") and os.path.getmtime(f"{folder}/{f}") > 1e9:
                os.utime(f"{folder}/{f}", (1000 + i, 1000 + i))
    return S.read_table_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


@pytest.mark.parametrize("start", [None, 20])
def test_cooldown_with_timers_takes_candidates_in_any_order(spark, start):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b"]), i, T0 + timedelta(milliseconds=rng.randrange(3_600_000))) for i in range(400)]
    # Arrival: by event time, each up to nine minutes late (the watermark is ten behind).
    arrived = sorted(rows, key=lambda r: r[2] + timedelta(seconds=rng.randrange(540)))
    parts = [arrived[i:i + 80] for i in range(0, 400, 80)]
    parts.append([("end", -1, T0 + timedelta(days=1)), (None, 900, T0), ("hot", 901, None)])
    parts.append([("end", -2, T0 + timedelta(days=2))])
    stateful.use_rocksdb(spark)
    last = None
    if start is not None:
        last = spark.createDataFrame([("hot", int((T0 - datetime(1970, 1, 1)).total_seconds() * 1e6) + start * 1_000_000)], "service string, last_us long")
    d = _tmp()
    fired = stateful.cooldown_with_timers(_stream(spark, d + "/in", CANDIDATES, parts), 30, slice_seconds=20, last=last)
    S.write_parquet(fired, d + "/out", d + "/ck").awaitTermination()
    got = {(r["service"], r["event_id"]) for r in spark.read.parquet(d + "/out").where("event_id >= 0").collect()}
    want = timeseries.cooldown(spark.createDataFrame(rows, CANDIDATES), 30, last=last)
    assert got == {(r["service"], r["event_id"]) for r in want.collect()} and len(got) > 100


class _Handle:
    """State of one key, each call to it counted."""

    def __init__(self):
        self.timers, self.calls = set(), 0

    def _state(self):
        handle, held = self, {}

        class State:
            def __getattr__(self, name):
                handle.calls += 1
                return {"exists": lambda: () in held, "get": lambda: held[()], "update": lambda v: held.update({(): v}),
                        "containsKey": held.__contains__, "getValue": held.__getitem__, "updateValue": held.__setitem__,
                        "removeKey": held.pop, "keys": lambda: iter([*held])}[name]
        return State()

    def getValueState(self, *_):
        return self._state()

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class _Clock(int):
    getCurrentWatermarkInMs = getExpiryTimeInMs = int.__int__


def _folded(processor, handle, batches):
    """Firings of ``batches``: (watermark in ms, (us, id) pairs that arrive before it moves there)."""
    processor.init(handle)
    out = []
    for watermark, rows in batches:
        if rows:
            frame = pd.DataFrame(rows, columns=["us", "event_id"])
            list(processor.handleInputRows(("a",), iter([frame[:len(rows) // 2], frame[len(rows) // 2:]]), None))
        for t in sorted(t for t in handle.timers if t <= watermark):
            for f in processor.handleExpiredTimer(("a",), _Clock(watermark), _Clock(t)):
                out += [(pd.Timestamp(at).value // 1000, i) for at, i in zip(f["fired_at"], f["event_id"])]
            handle.timers.discard(t)
    return out


def _chased(rows, cooldown_us):
    rows = sorted(rows)
    return [rows[i] for i in timeseries.greedy_chase(np.array([r[0] for r in rows]), cooldown_us)]


def test_cooldown_over_many_slices_takes_few_calls_to_the_state():
    rows = [(i * 61_000_000, i) for i in range(3000)]        # each in a slice of its own
    handle = _Handle()
    got = _folded(stateful.CooldownProcessor(90_000_000, 60_000_000), handle, [(0, rows[::-1]), (10**9, [])])
    assert got == _chased(rows, 90_000_000) and len(got) == 1500
    assert handle.calls < 100


def test_cooldown_folds_overlapping_runs_as_the_watermark_passes(monkeypatch):
    monkeypatch.setattr(stateful, "RUN", 7, raising=False)
    rng = random.Random(8)
    rows = [(rng.randrange(3_600_000) * 1000, i) for i in range(900)]
    arrived = sorted(rows, key=lambda r: r[0] + rng.randrange(300_000_000))
    handle, batches = _Handle(), []
    for i in range(0, 900, 60):
        newest = max(r[0] for r in arrived[:i + 60])
        batches.append((newest // 1000 - 300_001, arrived[i:i + 60]))
    got = _folded(stateful.CooldownProcessor(13_000_000, 20_000_000), handle, [*batches, (10**8, [])])
    assert got == _chased(rows, 13_000_000) and not handle.timers


def test_diagnoses_late_missing_and_early(spark):
    minutes = lambda m: T0 + timedelta(minutes=m)        # noqa: E731
    fired = [[("a", 1, minutes(0)), ("a", 2, minutes(1))], [("a", 3, minutes(30)), ("a", 4, minutes(31)), ("b", 5, minutes(32))],
             [("end", -1, minutes(3000))], [("end", -2, minutes(6000))]]
    found = [[(2, minutes(-3), "early"), (3, minutes(20), "too early")],
             [(1, minutes(9), "late"), (4, minutes(45), "too late"), (9, minutes(40), "of no firing")],
             [(-5, minutes(3000), "")], [(-6, minutes(6000), "")]]
    d = _tmp()
    f = _stream(spark, d + "/fired", "service string, event_id long, fired_at timestamp_ntz", fired)
    g = _stream(spark, d + "/found", "event_id long, diagnosed_at timestamp_ntz, raw string", found)
    S.write_parquet(stateful.diagnosed_firings(f, g), d + "/out", d + "/ck").awaitTermination()
    got = {r["event_id"]: (r["raw"], r["paged"]) for r in spark.read.parquet(d + "/out").where("event_id > 0").collect()}
    assert got == {1: ("late", False), 2: ("early", False), 3: (None, True), 4: (None, True), 5: (None, True)}


def _lines(spark, folder, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(folder)


def test_counters_are_heard_while_the_ingest_runs(spark):
    good = '{{"request_id": {}, "timestamp": "2024-03-01T12:00:0{}", "service": "a", "level": "{}", "latency": 5.0, "message": "x"}}'
    d, counters = _tmp(), stateful.LiveCounters()
    spark.streams.addListener(counters)
    try:
        for lines in ([good.format(1, 1, "ERROR"), good.format(2, 2, "INFO"), "{broken"], ["{broken", "{again"], [good.format(2, 2, "INFO")]):
            _lines(spark, d + "/in", lines)
            S.ingest_to_tables(stateful.observed(S.submissions_stream(spark, d + "/in")), d + "/out").awaitTermination()
            assert counters.wait()
    finally:
        spark.streams.removeListener(counters)
    m = S.ingest_metrics(spark, d + "/out").first()
    assert (m["submitted"], m["accepted"], m["refused"], m["repeated"], m["errors"]) == (6, 2, 3, 1, 1)
    assert counters.totals() == {"submitted": 6, "refused": 3, "errors": 1}


def test_submissions_without_a_request_id_are_all_kept(spark):
    line = '{{"timestamp": "2024-03-01T12:00:00", "service": "{}", "latency": 5.0, "message": "{}"}}'
    d = _tmp()
    for _ in range(2):            # the second time they are repeated
        _lines(spark, d + "/in", [line.format("a", "x"), line.format("b", "x"), line.format("a", "y")])
        S.ingest_to_tables(S.submissions_stream(spark, d + "/in"), d + "/out").awaitTermination()
    assert sorted((r["service"], r["message"]) for r in S.ingested(spark, d + "/out").collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_node_state_writes_what_changed(spark):
    schema = "from_service string, cpu_percent double, memory_percent double, ts timestamp_ntz, seq long"
    many = [[(f"n{i}", float(i), 1.0, T0, i) for i in range(50)], [("n7", 70.0, 2.0, T0, 100)], [("n7", 1.0, 1.0, T0, 60), ("n8", 80.0, 2.0, T0, 101)],
            [("n9", None, 2.0, T0, 102)], [("n9", 90.0, 2.0, T0, 103)]]
    d = _tmp()
    stream = _stream(spark, d + "/in", schema, many)
    S.node_state_to_table(stream, d + "/state", d + "/ck", compact_every=2).awaitTermination()
    deltas = {r["epoch"]: r["count"] for r in spark.read.parquet(d + "/state/delta").groupBy("epoch").count().collect()}
    assert deltas[0] == 50 and sum(deltas.values()) <= 54
    rows = lambda: sorted(tuple(r) for r in S.node_state(spark, d + "/state").select("service", "current_cpu", "seq").collect())     # noqa: E731
    want = {f"n{i}": (float(i), i) for i in range(50)} | {"n7": (70.0, 100), "n8": (80.0, 101), "n9": (90.0, 103)}
    assert rows() == sorted((k, *v) for k, v in want.items())
    for epoch in (1, 3):          # a replay, with and without its snapshot
        old = spark.read.schema(S.NODE_STATE + ", epoch long").parquet(d + "/state/delta").where(F.col("epoch") == epoch).drop("epoch")
        S.node_state_epoch(spark.createDataFrame(old.collect(), S.NODE_STATE), epoch, d + "/state", 2)
    assert rows() == sorted((k, *v) for k, v in want.items())
