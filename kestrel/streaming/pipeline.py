"""Structured Streaming versions of ingest, detection and action.

Each builder returns a streaming DataFrame or a started StreamingQuery;
sinks are Parquet folders with checkpoints on shared storage, so a restart
(or a lost executor) resumes from the last committed micro-batch.  The
streams' results equal their batch twins in ``kestrel.operators``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kestrel.fixed import BURST_MIN_ERRORS, BURST_WINDOW_MINUTES, COOLDOWN_SECONDS
from kestrel.functions.exprs import error_flag
from kestrel.operators.rules import action_gate, diagnosis_parse
from kestrel.operators.timeseries import cooldown, greedy_chase
from kestrel.session import materialize
from kestrel.sources.files import SUBMISSION_SCHEMA, bulk_id, by_date, judged_submissions, split_submissions

WATERMARK = "10 minutes"


def event_time(df: DataFrame, col: str = "timestamp") -> DataFrame:
    """Watermarks need TIMESTAMP, not TIMESTAMP_NTZ (session zone is UTC)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def read_table_stream(spark: SparkSession, folder: str, schema, glob: str | None = None,
                      files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


# ---- J1 / J2: ingest and dedupe --------------------------------------------------

def submissions_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(SUBMISSION_SCHEMA).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record"))
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.json(folder)


def ingest(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, refused) submissions; the good ones typed, with a store id (without a request_id, of their content) and the
    error flag."""
    good, bad = split_submissions(raw)
    content = ["timestamp", "service", "level", "latency_ms", "message"]
    rows = good.select("request_id", bulk_id(content, "timestamp", "request_id").alias("id"), "timestamp", "service", "level",
                       "latency_ms", "message", error_flag(F.col("level")).alias("error_count"))
    return rows, bad


INGEST_SCHEMA = ("request_id long, id string, timestamp timestamp_ntz, service string, level string, latency_ms double, "
                 "message string, error_count int")
QUARANTINE_SCHEMA = "reason string, line string"
METRICS_SCHEMA = "submitted long, accepted long, refused long, repeated long, errors long"


def ingest_to_tables(raw: DataFrame, base: str, available_now: bool = True):
    """Ingest with deduplication: good rows go to ``base/store``, refused ones to ``base/quarantine``, counters to
    ``base/metrics``, each micro-batch to its own epoch folder, which a replay overwrites.

    An id is stored once: within the batch by an aggregate, against what
    earlier epochs stored by an anti join over the batch's dates only.
    Nothing is late: a row of any time is compared with the store.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # Counters come with the writes, not by jobs of their own.
        sent, kept = Observation(), Observation()
        judged = judged_submissions(batch).observe(sent, F.count(F.lit(1)).alias("submitted"), F.count("reason").alias("refused"))
        raw_rows = materialize(judged.select(*batch.columns), "submissions")            # read for good and refused rows
        good, bad = ingest(raw_rows)
        first = good.groupBy("id").agg(F.min(F.struct(*[c for c in good.columns if c != "id"])).alias("r"))
        rows = first.select("id", "r.*").withColumn("dt", F.to_date("timestamp"))
        if epoch:
            lo, hi = good.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
            if lo:
                old = stored(spark, base).where((F.col("epoch") < epoch) & F.col("dt").between(F.lit(lo), F.lit(hi)))
                rows = rows.join(old.select("id"), "id", "left_anti")
        rows = rows.observe(kept, F.count(F.lit(1)).alias("accepted"), F.coalesce(F.sum("error_count"), F.lit(0)).alias("errors"))
        by_date(materialize(rows, "ingest")).write.mode("overwrite").partitionBy("dt").parquet(f"{base}/store/epoch={epoch}")
        (bad.select("reason", F.coalesce("_corrupt_record", F.to_json(F.struct("request_id", "timestamp", "service", "level", "latency", "message"))).alias("line"))
         .write.mode("overwrite").parquet(f"{base}/quarantine/epoch={epoch}"))
        submitted, refused, accepted = (int(o.get[c]) for o, c in ((sent, "submitted"), (sent, "refused"), (kept, "accepted")))
        one = [(submitted, accepted, refused, submitted - refused - accepted, int(kept.get["errors"]))]
        spark.createDataFrame(one, METRICS_SCHEMA).write.mode("overwrite").parquet(f"{base}/metrics/epoch={epoch}")

    w = raw.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint")
    return (w.trigger(availableNow=True) if available_now else w).start()


def stored(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(f"{INGEST_SCHEMA}, epoch long, dt date").parquet(f"{base}/store")


def ingested(spark: SparkSession, base: str) -> DataFrame:
    """Every stored submission, once."""
    return stored(spark, base).drop("epoch")


def quarantined(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(f"{QUARANTINE_SCHEMA}, epoch long").parquet(f"{base}/quarantine")


def ingest_metrics(spark: SparkSession, base: str) -> DataFrame:
    """Counters over all micro-batches."""
    m = spark.read.schema(f"{METRICS_SCHEMA}, epoch long").parquet(f"{base}/metrics")
    return m.agg(*[F.sum(c).alias(c) for c in ("submitted", "accepted", "refused", "repeated", "errors")])


# ---- J3: burst detection ------------------------------------------------------------

def burst_stream(logs: DataFrame, minutes: int = BURST_WINDOW_MINUTES, slide_minutes: int = 1,
                 min_errors: int = BURST_MIN_ERRORS) -> DataFrame:
    """Sliding-window error counts; windows are emitted once the watermark
    passes their end (append mode), so each appears exactly once."""
    # Every event must advance event time.  A filter on error_count would be
    # pushed below the watermark (and into the scan), so errors are counted
    # inside the aggregate instead.
    events = event_time(logs).withWatermark("timestamp", WATERMARK)
    win = F.window("timestamp", f"{minutes} minutes", f"{slide_minutes} minutes")
    return (events.groupBy(win.alias("w")).agg(F.count_if(F.col("error_count") >= 1).alias("errors"))
            .where(F.col("errors") > min_errors)
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "errors"))


# ---- J4: stateful cooldown -------------------------------------------------------------

COOLDOWN_OUT = "service string, fired_at timestamp_ntz, event_id long"
COOLDOWN_STATE = "last_us long"


def _cooldown_fn(cooldown_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(pdfs), ignore_index=True).sort_values(["_us", "event_id"], kind="stable")
        fired = rows.iloc[greedy_chase(rows["_us"].to_numpy(), cooldown_us,
                                      None if last is None else last + cooldown_us)]
        if len(fired):
            state.update((int(fired["_us"].iloc[-1]),))
        yield pd.DataFrame({"service": [key[0]] * len(fired), "fired_at": fired["timestamp"].to_numpy(),
                            "event_id": fired["event_id"].to_numpy()})
    return fn


def cooldown_stream(candidates: DataFrame, seconds: int = COOLDOWN_SECONDS, key: str = "service") -> DataFrame:
    """Greedy cooldown per key with the last firing time as state.

    Within a micro-batch a key's candidates are folded in time order (the
    binary-search chase of ``greedy_chase``, no per-row Python loop); the
    state carries the last firing to the next batch, so for in-order input
    the firings equal the batch ``cooldown`` whatever the trigger sizes.
    """
    c = candidates.select(F.col(key).alias("service"), "event_id", "timestamp",
                          F.unix_micros(F.col("timestamp").cast("timestamp")).alias("_us"))
    return c.groupBy("service").applyInPandasWithState(
        _cooldown_fn(seconds * 1_000_000), COOLDOWN_OUT, COOLDOWN_STATE, "append",
        GroupStateTimeout.NoTimeout)


def cooldown_to_table(candidates: DataFrame, path: str, checkpoint: str, seconds: int = COOLDOWN_SECONDS,
                      key: str = "service"):
    """Cooldown firings of a stream, each micro-batch in its own epoch folder.

    A micro-batch is folded by the batch operator (bounded segments, also of
    a hot key); what earlier epochs fired last is its start, a maximum per key.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        last = None
        if epoch:
            old = batch.sparkSession.read.schema(f"{COOLDOWN_OUT}, epoch long").parquet(path).where(F.col("epoch") < epoch)
            last = old.groupBy(key).agg(F.max(F.unix_micros(F.col("fired_at").cast("timestamp"))).alias("last_us"))
        cooldown(batch, seconds, key, last=last).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return (candidates.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# ---- J5: actions -------------------------------------------------------------------------

def actions_stream(diagnoses: DataFrame) -> DataFrame:
    """Parse stored diagnoses and keep the confident ones as actions."""
    return action_gate(diagnosis_parse(diagnoses))


def incident_actions(fired: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Actions for a stream of firings: each one's stored diagnosis, parsed and gated."""
    return actions_stream(fired.select("event_id").join(diagnoses, "event_id"))


def write_idempotent(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True, mode: str = "append"):
    """foreachBatch sink writing each micro-batch to its own epoch folder.

    A replayed epoch overwrites its own folder, so the sink is exactly-once
    with respect to the checkpoint.
    """
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch_id}")

    w = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()


# ---- J6: live node state -----------------------------------------------------------------

def node_state_stream(edges: DataFrame) -> DataFrame:
    latest = F.max_by(F.struct("cpu_percent", "memory_percent", "ts", "seq"), "seq")
    return (edges.where(F.col("cpu_percent").isNotNull())
            .groupBy(F.col("from_service").alias("service")).agg(latest.alias("s"))
            .select("service", F.col("s.cpu_percent").alias("current_cpu"),
                    F.col("s.memory_percent").alias("current_memory"), F.col("s.ts").alias("last_updated"), F.col("s.seq").alias("seq")))


NODE_STATE = "service string, current_cpu double, current_memory double, last_updated timestamp_ntz, seq long"


def node_state(spark: SparkSession, base: str, upto: int | None = None) -> DataFrame:
    """The newest state of every node below ``base``: the newest snapshot and the deltas after it (of epochs <= ``upto``)."""
    most = F.lit(True) if upto is None else F.col("epoch") <= upto
    deltas = spark.read.schema(f"{NODE_STATE}, epoch long").parquet(f"{base}/delta").where(most)
    rows = deltas.drop("epoch")
    snapshots = _snapshots(spark, base)
    if snapshots is not None:
        older = snapshots.where(most)
        newest = older.select(F.max("epoch")).first()[0]
        if newest is not None:
            rows = deltas.where(F.col("epoch") > newest).drop("epoch").unionByName(older.where(F.col("epoch") == newest).drop("epoch"))
    latest = rows.groupBy("service").agg(F.max_by(F.struct("current_cpu", "current_memory", "last_updated", "seq"), "seq").alias("s"))
    return latest.select("service", "s.*")


def _snapshots(spark: SparkSession, base: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/snapshot")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(f"{NODE_STATE}, epoch long").parquet(f"{base}/snapshot")


def node_state_epoch(batch: DataFrame, epoch: int, base: str, compact_every: int) -> None:
    """One epoch: the nodes that changed, and every ``compact_every`` epochs a snapshot of all.  A replay overwrites what
    the epoch wrote with the same rows; deltas are kept, a snapshot only spares reading them."""
    batch.write.mode("overwrite").parquet(f"{base}/delta/epoch={epoch}")
    if (epoch + 1) % compact_every == 0:
        whole = materialize(node_state(batch.sparkSession, base, epoch), "node-state")
        whole.write.mode("overwrite").parquet(f"{base}/snapshot/epoch={epoch}")


def node_state_to_table(edges: DataFrame, base: str, checkpoint: str, compact_every: int = 16):
    """Live node state in update mode: an epoch writes the nodes it changed, not the state."""
    def sink(batch: DataFrame, epoch: int) -> None:
        node_state_epoch(batch, epoch, base, compact_every)

    return (node_state_stream(edges).writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def write_parquet(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    return (stream.writeStream.format("parquet").outputMode(mode)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path))
