"""Aggregations, sorts and top-k over logs and actions.

Every aggregate here is a partial + final hash aggregate: the shuffle
carries one row per group per map task, whatever the data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def system_status(logs: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Total logs, logs with errors, processed, remediations (one row)."""
    status = logs.agg(F.count(F.lit(1)).alias("total_logs"),
                      F.count_if(F.col("error_count") > 0).alias("error_logs"))
    status = status.withColumn("processed", F.col("total_logs"))
    if actions is None:
        return status.withColumn("remediations", F.lit(0).cast("bigint"))
    return status.withColumn("remediations", actions.select(F.count(F.lit(1))).scalar())


def service_rank(errors: DataFrame) -> DataFrame:
    """Errors per service, most first; rank 1 is the investigation target.

    The window runs over the aggregate (one row per service), not raw logs.
    """
    counts = errors.groupBy("service").agg(F.count(F.lit(1)).alias("errors"))
    w = Window.orderBy(F.col("errors").desc(), F.col("service"))
    return counts.withColumn("rank", F.row_number().over(w))


def incident_stats(errors: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Mean latency, error count and count/100 per service and overall."""
    return (errors.rollup("service")
            .agg(F.avg(latency).alias("avg_latency"),
                 F.count(F.lit(1)).alias("error_total"))
            .select(F.coalesce(F.col("service"), F.lit("ALL")).alias("service"),
                    F.round("avg_latency", 6).alias("avg_latency"),
                    "error_total",
                    (F.col("error_total") / 100.0).alias("error_rate_norm")))


def distinct_messages(errors: DataFrame, k: int = 3, newest_first: bool = False,
                      by_service: bool = True) -> DataFrame:
    """First ``k`` distinct messages in time order (oldest or newest first).

    Distinct first (an aggregate), then a top-k per service; Spark inserts a
    partial WindowGroupLimit before the shuffle.
    """
    keys = ["service", "message"] if by_service else ["message"]
    firsts = errors.groupBy(*keys).agg(
        (F.max if newest_first else F.min)(F.struct("timestamp", "event_id")).alias("seen"))
    order = F.col("seen").desc() if newest_first else F.col("seen").asc()
    part = [F.col("service")] if by_service else []
    w = Window.partitionBy(*part).orderBy(order, F.col("message"))
    return (firsts.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= k)
            .select(*(["service"] if by_service else []), "position", "message",
                    F.col("seen.timestamp").alias("seen_at")))


def error_rate_corr(logs: DataFrame) -> DataFrame:
    """Share of errors and Pearson corr(db_lock_time, error_count)."""
    return logs.agg(F.round(F.avg("error_count"), 8).alias("error_rate"),
                    F.round(F.corr("db_lock_time", F.col("error_count").cast("double")), 8)
                    .alias("corr_lock_error"))


def top_k_history(actions: DataFrame, n: int = 20, per: str | None = None) -> DataFrame:
    """Newest ``n`` actions, newest first; per target when ``per`` is given."""
    order = [F.col("timestamp").desc(), F.col("event_id").desc()]
    if per is None:
        return actions.orderBy(*order).limit(n)
    w = Window.partitionBy(per).orderBy(*order)
    return actions.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)
