"""Projections, filters and cleaning of log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.fixed import METRICS
from kestrel.functions.exprs import col_or_null, derive_level, error_flag, iso_text, to_number

LOG_COLUMNS = ["event_id", "timestamp", "service", "level", "message",
               "latency_ms", "db_lock_time", "pool_wait_ms", "error_count"]


def normalise_telemetry(df: DataFrame, cols: list[str] = METRICS) -> DataFrame:
    """Coerce metric columns to double; bad text and NaN become NULL.

    ``latency`` (the controller's name) is accepted as an alias of
    ``latency_ms``; an absent metric column becomes a NULL column.
    """
    out = df
    if "latency" in df.columns:
        out = out.withColumn("latency_ms", F.coalesce(col_or_null(out, "latency_ms", "string"),
                                                      F.col("latency")))
    return out.withColumns({c: to_number(col_or_null(out, c)) for c in cols})


def drop_incomplete(df: DataFrame, cols: list[str] = METRICS) -> DataFrame:
    """Drop rows missing any of ``cols``."""
    return df.na.drop(subset=cols)


def with_error_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("error_count", error_flag(F.col("level")))


def with_derived_level(df: DataFrame) -> DataFrame:
    return df.withColumn("level", derive_level(F.col("error_count"), F.col("latency_ms")))


def resolve_now(df: DataFrame, now: Column | None, ts: str = "timestamp") -> Column:
    """``now`` as data: the given literal, else the newest timestamp."""
    if now is not None:
        return now
    return df.select(F.max(ts)).scalar()


def recent_errors(logs: DataFrame, minutes: int = 30, now: Column | None = None) -> DataFrame:
    """Errors strictly newer than ``now - minutes``; message plus metadata."""
    cutoff = resolve_now(logs, now) - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    cols = [c for c in LOG_COLUMNS if c in logs.columns]
    return logs.where((F.col("error_count") >= 1) & (F.col("timestamp") > cutoff)).select(*cols)


def filter_service(df: DataFrame, service: str | None) -> DataFrame:
    """Equality filter on service; None or 'All' means no filter."""
    if service is None or service == "All":
        return df
    return df.where(F.col("service") == service)


def recent_logs(df: DataFrame, n: int = 10) -> DataFrame:
    """Newest ``n`` logs, total order (timestamp desc, event_id desc)."""
    return df.orderBy(F.col("timestamp").desc(), F.col("event_id").desc()).limit(n)


def log_cards(df: DataFrame, score: str | None = None) -> DataFrame:
    """Display projection: service, minute-precision time, 50-char message."""
    cols = [F.col("event_id"), F.col("service"),
            F.substring(iso_text(F.col("timestamp")), 1, 16).alias("time_label"),
            F.substring(F.col("message"), 1, 50).alias("message_label")]
    if score is not None:
        cols.append(F.round(F.col(score), 2).alias("score_label"))
    return df.select(*cols)


def latest_error(logs: DataFrame) -> DataFrame:
    """The newest error row (ties broken by event_id); one row."""
    cols = [c for c in LOG_COLUMNS if c in logs.columns]
    row = F.max_by(F.struct(*cols), F.struct("timestamp", "event_id"))
    return logs.where(F.col("error_count") >= 1).agg(row.alias("r")).select("r.*").where(
        F.col("event_id").isNotNull())
