"""Streams with state of their own: cooldown with timers, diagnoses that arrive later, live counters."""

from __future__ import annotations

import threading
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType, TimestampType

from kestrel.fixed import COOLDOWN_SECONDS
from kestrel.operators.timeseries import greedy_chase
from kestrel.sources.files import judged_submissions

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "10 minutes"


# ---- J4: cooldown with timers ---------------------------------------------------

FIRED = StructType([StructField("service", StringType()), StructField("fired_at", TimestampType()), StructField("event_id", LongType())])


RUN = 4096              # candidates of a waiting run
NEVER = 1 << 62         # after any time


class CooldownProcessor(StatefulProcessor):
    """Greedy cooldown of one key over candidates in any order within the watermark.

    A micro-batch's candidates wait as runs in order of time, ``RUN`` at most to a
    run, in a map from a run's first and last time and its number to its (time, id)
    pairs.  A timer stands at the end of the first time slice that holds any.
    When the watermark has passed a slice nothing can be added to it: then all
    slices that it has passed are folded from the last firing, run by run, as many
    together as overlap, and runs without later candidates are dropped.  The calls
    to the state grow with the runs, neither with the slices nor with their squares.
    """

    def __init__(self, cooldown_us: int, slice_us: int):
        self.cooldown_us, self.slice_us = cooldown_us, slice_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType([StructField("us", LongType())]))
        # The timer that stands (ms), up to where all is folded (us), runs so far.
        self.progress = handle.getValueState("progress", StructType([StructField(c, LongType()) for c in ("timer", "folded", "runs")]))
        pairs = StructType([StructField("us", ArrayType(LongType())), StructField("ids", ArrayType(LongType()))])
        self.waiting = handle.getMapState("runs", StructType([StructField(c, LongType()) for c in ("first", "last", "run")]), pairs)

    def _slice_end_ms(self, us: int) -> int:
        return (us // self.slice_us + 1) * self.slice_us // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["us", "event_id"])
        us, ids = new["us"].tolist(), new["event_id"].tolist()
        timer, folded, runs = self.progress.get() if self.progress.exists() else (NEVER, -NEVER, 0)
        for at in range(0, len(us), RUN):
            part = us[at:at + RUN]
            self.waiting.updateValue((part[0], part[-1], runs), (part, ids[at:at + RUN]))
            runs += 1
        end = self._slice_end_ms(us[0])
        if end < timer:
            if timer != NEVER:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(end)
            timer = end
        self.progress.update((timer, folded, runs))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        end = passed * 1000 // self.slice_us * self.slice_us
        _, folded, runs = self.progress.get()
        last = self.last.get()[0] if self.last.exists() else None
        waiting = sorted(tuple(k) for k in self.waiting.keys())
        due = [k for k in waiting if k[0] < end]
        rest = min((k[0] for k in waiting if k[0] >= end), default=NEVER)        # the first time that stays
        us, ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for i, k in enumerate(due):
            own_us, own_ids = (np.array(x, np.int64) for x in self.waiting.getValue(k))
            if k[1] < end:
                self.waiting.removeKey(k)
            else:
                rest = min(rest, int(own_us[np.searchsorted(own_us, end)]))
            new = slice(np.searchsorted(own_us, folded), np.searchsorted(own_us, end))
            us, ids = np.concatenate([us, own_us[new]]), np.concatenate([ids, own_ids[new]])
            order = np.lexsort((ids, us))
            us, ids = us[order], ids[order]
            # Nothing before the next run's first time is still to come.
            n = np.searchsorted(us, due[i + 1][0] if i + 1 < len(due) else end)
            picks = greedy_chase(us[:n], self.cooldown_us, None if last is None else last + self.cooldown_us)
            if picks:
                last = int(us[picks[-1]])
                yield pd.DataFrame({"service": [key[0]] * len(picks), "fired_at": pd.to_datetime(us[picks], unit="us", utc=True),
                                    "event_id": ids[picks]})
            us, ids = us[n:], ids[n:]
        if last is not None:
            self.last.update((last,))
        timer = NEVER
        if rest != NEVER:
            timer = self._slice_end_ms(rest)
            self.handle.registerTimer(timer)
        self.progress.update((timer, max(folded, end), runs))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.last.update((int(initialState["last_us"].max()),))

    def close(self) -> None:
        pass


def cooldown_with_timers(candidates: DataFrame, seconds: int = COOLDOWN_SECONDS, watermark: str = WATERMARK,
                         slice_seconds: int = 60, last: DataFrame | None = None) -> DataFrame:
    """Cooldown firings (service, fired_at, event_id) of a stream of candidates (service, event_id, timestamp).

    Equal to the batch ``cooldown`` for candidates that are at most ``watermark``
    behind the newest one, in whatever order they arrive; those further behind
    are dropped, as are candidates without a service or time.  A firing is emitted when the
    watermark has passed its slice.  ``last`` (service, last_us) starts the keys
    from earlier firings.  Needs the RocksDB state store (``use_rocksdb``).
    """
    c = candidates.select("service", "event_id", F.col("timestamp").cast("timestamp").alias("timestamp"))
    c = c.where(F.col("service").isNotNull() & F.col("timestamp").isNotNull()).withWatermark("timestamp", watermark)
    keyed = c.select("service", "event_id", F.unix_micros("timestamp").alias("us"), "timestamp").groupBy("service")
    start = last.select("service", "last_us").groupBy("service") if last is not None else None
    return keyed.transformWithStateInPandas(CooldownProcessor(seconds * 1_000_000, slice_seconds * 1_000_000), FIRED, "Append",
                                            "EventTime", start)


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


# ---- J5: diagnoses that arrive after their firing ---------------------------------

def diagnosed_firings(fired: DataFrame, diagnoses: DataFrame, early: str = "5 minutes", late: str = "10 minutes",
                      watermark: str = WATERMARK) -> DataFrame:
    """Each firing (service, event_id, fired_at) with its diagnosis (event_id, diagnosed_at, raw), both streams.

    A diagnosis belongs to the firing of its event if it comes from ``early``
    before to ``late`` after it; the join's state is bounded by that interval and the
    watermarks.  A firing whose time is up without one comes out with NULLs:
    nobody diagnosed it, so a human is paged (``paged``).
    """
    f = fired.select("service", "event_id", F.col("fired_at").cast("timestamp").alias("fired_at")).withWatermark("fired_at", watermark)
    d = diagnoses.select(F.col("event_id").alias("d_event"), F.col("diagnosed_at").cast("timestamp").alias("diagnosed_at"), "raw")
    d = d.withWatermark("diagnosed_at", watermark)
    within = F.expr(f"event_id = d_event AND diagnosed_at >= fired_at - INTERVAL {early} AND diagnosed_at <= fired_at + INTERVAL {late}")
    return f.join(d, within, "left_outer").select(
        "service", "event_id", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"),
        F.col("diagnosed_at").cast("timestamp_ntz").alias("diagnosed_at"), "raw", F.col("raw").isNull().alias("paged"))


# ---- J7: live counters ---------------------------------------------------------------

INGEST_COUNTERS = "ingest"


def observed(raw: DataFrame) -> DataFrame:
    """A stream of submissions that counts what passes: rows, those that will be refused, errors among the good ones."""
    judged = judged_submissions(raw).observe(
        INGEST_COUNTERS, F.count(F.lit(1)).alias("submitted"), F.count("reason").alias("refused"),
        F.count_if(F.col("reason").isNull() & F.coalesce(F.col("level") == "ERROR", F.lit(False))).alias("errors"))
    return judged.select(*raw.columns)


class LiveCounters(StreamingQueryListener):
    """Running totals of a query's observed counters, as its progress comes in: no job of their own.

    A micro-batch that is replayed replaces its counts.  ``wait`` returns once
    the query's end was heard, since progress is reported after the fact.
    """

    def __init__(self, name: str = INGEST_COUNTERS):
        self.name, self.batches, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        counted = event.progress.observedMetrics.get(self.name)
        if counted is not None:
            self.batches[event.progress.id, event.progress.batchId] = counted.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def wait(self, seconds: float = 30) -> bool:
        return self.ended.wait(seconds)

    def totals(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counted in list(self.batches.values()):
            for k, v in counted.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out
