"""Scaling probe: generated logs (K1) at growing n, headline operators on
each, wall time and shuffle bytes per operator from Spark's event log.

    python tools/scale_probe.py SCRATCH_DIR [n ...]

SCRATCH_DIR receives the generated tables and the event log (use a fresh
folder per run).  Prints one JSON line per (n, operator) with wall time,
shuffle bytes written and the longest task.  Aggregating
operators (ATE, forecast fit, correlations) should keep shuffle bytes flat
in n (partial aggregation: one row per group per map task); the trailing
window scales with the error rows it must count.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from kestrel.operators import aggregates, causal, clean, synth  # noqa: E402
from kestrel.operators import timeseries as ts  # noqa: E402
from kestrel.session import build_session  # noqa: E402
from kestrel.sources.tables import edges_from_logs  # noqa: E402

OPERATORS = {
    "ate_linear": lambda logs: causal.ate_linear(logs),
    "corr_matrix": lambda logs: causal.corr_matrix(logs),
    "forecast_fit": lambda logs: ts.forecast_fit(logs, ["service"]),
    "error_burst_60m": lambda logs: ts.error_burst(logs, minutes=60),
    "ate_hetero": lambda logs: causal.ate_hetero(logs),
    "placebo_refute": lambda logs: causal.placebo_refute(logs, simulations=20),
    "pc_tests": lambda logs: causal.pc_tests(logs),
    "effect_scan": lambda logs: causal.effect_scan(logs),
    "status_timeline": lambda logs: ts.status_timeline(logs),
    "burst_sliding": lambda logs: ts.burst_sliding(logs),
    "service_rank": lambda logs: aggregates.service_rank(logs.where(F.col("error_count") >= 1)),
    "distinct_messages": lambda logs: aggregates.distinct_messages(
        logs.where(F.col("error_count") >= 1), k=5, newest_first=True),
    "latest_error": lambda logs: clean.latest_error(logs),
    "recent_logs": lambda logs: clean.recent_logs(logs, 10),
    # A hot cell: a year of rows on one timestamp, all services together
    # (about 1M rows per cell at 4M), counted over 60 min.
    "burst_hot_year": lambda logs: ts.trailing_count(_hot(logs), 3600 * 10**6, []),
    "cooldown": lambda logs: ts.cooldown(logs.where(F.col("error_count") >= 1), 30),
    "edges_view": lambda logs: edges_from_logs(logs.withColumns(
        {"user_id": F.col("event_id") % 3, "cpu_percent": F.lit(1.0), "memory_percent": F.lit(1.0)})),
}


def _hot(logs):
    return logs.select("event_id", F.date_trunc("year", "timestamp").cast("timestamp_ntz").alias("timestamp"),
                       "service")


def shuffle_bytes_by_description(log_dir: str) -> tuple[dict[str, int], dict[str, int]]:
    """Shuffle bytes written and the longest task (ms) per job description,
    from the event log."""
    stage_job, job_desc, out, longest = {}, {}, {}, {}
    for path in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True):
        if os.path.isdir(path):
            continue
        with open(path) as f:
            for line in f:
                e = json.loads(line)
                kind = e.get("Event")
                if kind == "SparkListenerJobStart":
                    desc = (e.get("Properties") or {}).get("spark.job.description", "")
                    job_desc[e["Job ID"]] = desc
                    for sid in e.get("Stage IDs", []):
                        stage_job[sid] = e["Job ID"]
                elif kind == "SparkListenerTaskEnd":
                    tm = e.get("Task Metrics") or {}
                    m = tm.get("Shuffle Write Metrics") or {}
                    desc = job_desc.get(stage_job.get(e.get("Stage ID")), "")
                    out[desc] = out.get(desc, 0) + int(m.get("Shuffle Bytes Written", 0))
                    longest[desc] = max(longest.get(desc, 0), int(tm.get("Executor Run Time", 0)))
    return out, longest


def main() -> None:
    scratch = sys.argv[1]
    sizes = [int(x) for x in sys.argv[2:]] or [1_000_000, 4_000_000]
    log_dir = os.path.join(scratch, "eventlog")
    os.makedirs(log_dir, exist_ok=True)
    spark = build_session(master="local[8]", shuffle_partitions=16, app_name="kestrel-scale",
                          extra={"spark.eventLog.enabled": "true", "spark.eventLog.dir": log_dir,
                                 "spark.eventLog.compress": "false",
                                 "spark.eventLog.rolling.enabled": "false",
                                 "spark.checkpoint.dir": os.path.join(scratch, "ckpt")})
    times = {}
    for n in sizes:
        path = os.path.join(scratch, f"logs_{n}")
        spark.sparkContext.setJobDescription(f"generate {n}")
        synth.synth_logs(spark.range(n).withColumnRenamed("id", "event_id")).write.parquet(path)
        logs = spark.read.parquet(path)
        for name, op in OPERATORS.items():
            desc = f"{name} {n}"
            spark.sparkContext.setJobDescription(desc)
            t0 = time.perf_counter()
            op(logs).write.format("noop").mode("overwrite").save()
            times[desc] = round(time.perf_counter() - t0, 3)
    spark.sparkContext.setJobDescription(None)
    spark.stop()
    shuffled, longest = shuffle_bytes_by_description(log_dir)
    for desc, sec in times.items():
        name, n = desc.rsplit(" ", 1)
        print(json.dumps({"operator": name, "n": int(n), "sec": sec,
                          "shuffle_bytes": shuffled.get(desc, 0), "longest_task_ms": longest.get(desc, 0)}))


if __name__ == "__main__":
    main()
