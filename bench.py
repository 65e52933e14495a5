"""Benchmark the headline queries; prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query after one warm-up, default 3).
Each run executes the whole plan into the no-op sink (nothing collected).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Headline: the queries whose total is the metric.  Every other registered query of the log side is run and timed
# once, and reported beside them (BENCH_ALL=0 leaves them out).
HEADLINE = [
    "recent_errors", "service_rank", "incident_stats", "corr_matrix", "ate_linear", "ate_hetero",
    "placebo_refute", "pc_tests", "effect_scan", "error_burst", "error_burst_global", "burst_sliding",
    "cooldown", "forecast_horizon", "slo_breach", "status_timeline", "lag_panel", "topology_edges",
    "node_state", "edge_last100", "edge_obs_match", "knn_batch", "scenario_match", "guardrail_audit",
    "action_gate", "incident_context", "edges_view",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from kestrel.plans.queries import QUERIES
    from kestrel.session import build_session
    from kestrel.sources import tables

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                          app_name="kestrel-bench")
    times, others = {}, {}
    names = [n for n in QUERIES if n not in HEADLINE] if os.environ.get("BENCH_ALL", "1") != "0" else []
    for name in [*HEADLINE, *names]:
        fn = QUERIES[name]
        if name in HEADLINE:
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        samples = []
        for _ in range(runs if name in HEADLINE else 1):
            if name == "edges_view":
                tables._STORED.clear()        # its table is written once per application: time that, too
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        (times if name in HEADLINE else others)[name] = round(statistics.median(samples), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 4),
                      "unit": "sec", "queries": times, "others": others, "sf": sf, "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
