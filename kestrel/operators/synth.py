"""Synthetic data generators, distributed.

Both take a spine DataFrame of row ids (e.g. a table's keys) so the work
is partitioned like the input; draws use Spark's seeded ``rand``/``randn``,
which are deterministic per partition, so a recomputed partition after a
lost executor yields the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.fixed import AFFECTED, SERVICES


def _exp(scale: float, seed: int) -> Column:
    return -scale * F.log(1.0 - F.rand(seed))


def _choice(values: list[str], seed: int) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(F.rand(seed) * len(values)) + 1).cast("int"))


def synth_logs(spine: DataFrame, id_col: str = "event_id", start: str = "2024-01-01 00:00:00",
               step_seconds: int = 30, incident_after_hours: float = 18.0, seed: int = 42) -> DataFrame:
    """Logs with a known causal chain lock -> pool wait -> latency -> errors.

    Row i is at start + i * step.  After the incident start, lock time is
    exponential with scale 2.0 (0.1 before) and 70 % of rows come from three
    affected services.
    """
    t0 = F.expr(f"TIMESTAMP_NTZ '{start}'")
    ts = t0 + F.make_dt_interval(secs=(F.col(id_col) * step_seconds).cast("double"))
    incident = F.col(id_col) * step_seconds > incident_after_hours * 3600
    df = spine.select(F.col(id_col).alias("event_id"), ts.alias("timestamp"), incident.alias("_inc"))
    df = df.withColumn("db_lock_time", F.when(F.col("_inc"), _exp(2.0, seed + 1)).otherwise(_exp(0.1, seed + 2)))
    df = df.withColumn("pool_wait_ms", F.greatest(F.lit(0.0), 50 * F.col("db_lock_time") + 10 * F.randn(seed + 3)))
    df = df.withColumn("latency_ms", 20 + 2 * F.col("pool_wait_ms") + _exp(10.0, seed + 4))
    p = 1.0 / (1.0 + F.exp(-(F.col("latency_ms") - 200.0) / 50.0))
    df = df.withColumn("error_count", F.when(F.rand(seed + 5) < p, 1).otherwise(0))
    affected = F.col("_inc") & (F.rand(seed + 6) > 0.3)
    df = df.withColumn("service", F.when(affected, _choice(AFFECTED, seed + 7))
                       .otherwise(_choice(SERVICES, seed + 8)))
    return df.select(
        "event_id", "timestamp", "service", "db_lock_time", "pool_wait_ms", "latency_ms",
        F.col("error_count").cast("int").alias("error_count"),
        F.when(F.col("error_count") == 1, "ERROR").when(F.col("latency_ms") > 100, "WARN")
         .otherwise("INFO").alias("level"),
        F.when(F.col("error_count") == 1, F.lit("Request timeout"))
         .otherwise(F.concat(F.lit("Request completed in "), F.col("latency_ms").cast("int").cast("string"),
                             F.lit("ms"))).alias("message"))


def synth_scm(spine: DataFrame, id_col: str = "event_id", start: str = "2024-01-01 00:00:00",
              seed: int = 42, service: str = "service-a") -> DataFrame:
    """Structural model: cpu, memory -> latency -> errors (true slope 0.05).

    ``error_count`` is clamped at 0 as in the reference; ``error_raw`` keeps
    the unclamped value for unbiased recovery tests.
    """
    t0 = F.expr(f"TIMESTAMP_NTZ '{start}'")
    df = spine.select(F.col(id_col).alias("row_id"),
                      (t0 + F.make_dt_interval(secs=F.col(id_col) * F.lit(60.0))).alias("timestamp"),
                      F.lit(service).alias("service_name"),
                      (10 + 80 * F.rand(seed + 1)).alias("cpu_percent"),
                      (20 + 60 * F.rand(seed + 2)).alias("memory_percent"))
    df = df.withColumn("latency_ms", 0.5 * F.col("cpu_percent") + 0.3 * F.col("memory_percent")
                       + 5 * F.randn(seed + 3))
    df = df.withColumn("error_raw", 0.05 * F.col("latency_ms") + 2 * F.randn(seed + 4))
    return df.withColumn("error_count", F.greatest(F.lit(0.0), F.col("error_raw")))
