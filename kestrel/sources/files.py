"""File sources and sinks for logs, submissions, the log store and feedback
(SURVEY §2.1).  Paths are shared-storage folders (the checkpoint folder on a
cluster); nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (DateType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType, TimestampNTZType)

from kestrel.functions.exprs import iso_text

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

LOGS_SCHEMA = StructType([
    StructField("event_id", LongType()), StructField("timestamp", TimestampNTZType()),
    StructField("service", StringType()), StructField("level", StringType()),
    StructField("message", StringType()), StructField("latency_ms", DoubleType()),
    StructField("db_lock_time", DoubleType()), StructField("pool_wait_ms", DoubleType()),
    StructField("error_count", IntegerType())])

SUBMISSION_SCHEMA = StructType([
    StructField("request_id", LongType()), StructField("timestamp", StringType()),
    StructField("service", StringType()), StructField("level", StringType()),
    StructField("latency", DoubleType()), StructField("message", StringType()),
    StructField("_corrupt_record", StringType())])

LOG_STORE_COLUMNS = ["id", "event_id", "timestamp", "service", "level", "message",
                     "latency_ms", "db_lock_time", "pool_wait_ms", "error_count"]


# ---- CSV ------------------------------------------------------------------

def write_logs_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("timestampNTZFormat", TS_FORMAT).csv(path))


def read_logs_csv(spark: SparkSession, path: str, schema: StructType = LOGS_SCHEMA) -> DataFrame:
    """Header CSV with an explicit schema (no inference pass over the data)."""
    return (spark.read.schema(schema).option("header", True)
            .option("timestampNTZFormat", TS_FORMAT).option("mode", "PERMISSIVE").csv(path))


def by_date(df: DataFrame, files_per_date: int = 8) -> DataFrame:
    """``df`` (with ``dt``) dealt out by date and a hash of the row, ahead of a write partitioned by ``dt``: a
    date gets at most ``files_per_date`` files per write, and a hot date is split over as many tasks."""
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map" not in t]), F.lit(files_per_date))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "dt", salt)


# ---- JSON submissions --------------------------------------------------------

def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log submissions, typed; malformed lines keep their text."""
    return (spark.read.schema(SUBMISSION_SCHEMA).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


# A date (calendar or ISO week, with dashes or without), then optionally any one separator, a time of day (with colons or
# without, from hours to any number of decimals) and an offset: what datetime.fromisoformat takes.
ISO_PATTERN = (r"^(?:(\d{4})-(\d{2})-(\d{2})|(\d{4})(\d{2})(\d{2})|(\d{4})-W(\d{2})(?:-(\d))?|(\d{4})W(\d{2})(\d)?)"
               r"(?:[\s\S](?:(\d{2})(?::(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?|(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)?)"
               r"(Z|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?)?)?$")


def iso_timestamp(text):
    """ISO-8601 text as a UTC wall-clock time; NULL where it isn't one.  A time without an offset is UTC, a week
    without a day begins on Monday, decimals beyond microseconds are cut off."""
    # The parts by one pass of the pattern, then one expression over them.
    names = ["year", "month", "day", "week_year", "week", "week_day", "hour", "minute", "second", "decimals", "sign",
             "off_hour", "off_minute", "off_second", "off_decimals"]
    groups = ["$1$4", "$2$5", "$3$6", "$7$10", "$8$11", "$9$12", "$13$17", "$14$18", "$15$19", "$16$20", "$22", "$23", "$24", "$25", "$26"]
    parts = F.split(F.regexp_replace(text, ISO_PATTERN, "|".join(groups)), "[|]")

    def whole(p):
        v = {n: p[i] for i, n in enumerate(names)}

        def number(name, default=0):
            return F.when(v[name] == "", F.lit(default)).otherwise(v[name].try_cast("int"))

        def micros(*hms, decimals):
            h, m, s = map(number, hms)
            inside = (h < 24) & (m < 60) & (s < 60)
            return F.when(inside, ((h * 60 + m) * 60 + s).cast("long") * 1_000_000 + F.rpad(F.substring(v[decimals], 1, 6), 6, "0").cast("int"))

        # Week w of a year begins w - 1 weeks after the Monday on or before 4 January; a year without a week 53 has none.
        week, day = number("week", 1), number("week_day", 1)
        monday = F.date_trunc("week", F.concat(v["week_year"], F.lit("-01-04")).try_cast("timestamp_ntz")).cast("date")
        of_week = F.date_add(monday, (week - 1) * 7 + day - 1)
        of_week = F.when(week.between(1, 53) & day.between(1, 7) & (F.weekofyear(of_week) == week), of_week)
        date = F.when(v["week_year"] != "", of_week).otherwise(F.concat_ws("-", v["year"], v["month"], v["day"]).try_cast("date"))
        away = micros("off_hour", "off_minute", "off_second", decimals="off_decimals") * F.when(v["sign"] == "-", -1).otherwise(1)
        return F.unix_micros(date.cast("timestamp")) + micros("hour", "minute", "second", decimals="decimals") - away

    utc = F.get(F.transform(F.array(parts), whole), F.lit(0))
    return F.when(text.rlike(ISO_PATTERN), F.timestamp_micros(utc)).cast("timestamp_ntz")


def judged_submissions(raw: DataFrame) -> DataFrame:
    """``raw`` plus ``_ts``, its time, and ``reason``, the first one to refuse it (NULL: it is good)."""
    typed = raw.select("*", iso_timestamp(F.col("timestamp")).alias("_ts"))
    reason = (F.when(F.col("_corrupt_record").isNotNull(), "malformed")
              .when(F.col("service").isNull(), "missing_service")
              .when(F.col("_ts").isNull(), "bad_timestamp")
              .when(F.col("latency").isNull(), "missing_latency")
              .when(F.col("message").isNull(), "missing_message"))
    return typed.withColumn("reason", reason)


def split_submissions(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine).  Good rows: well-formed JSON with service, an ISO
    timestamp of any form, latency and message; ``level`` defaults to INFO;
    ``latency`` -> latency_ms.  The quarantine keeps the first reason."""
    typed = judged_submissions(raw)
    good = typed.where(F.col("reason").isNull()).select(
        "request_id", F.col("_ts").alias("timestamp"), "service",
        F.coalesce(F.col("level"), F.lit("INFO")).alias("level"),
        F.col("latency").alias("latency_ms"), "message")
    bad = typed.where(F.col("reason").isNotNull()).select("reason", "_corrupt_record", "request_id", "timestamp", "service", "level", "latency", "message")
    return good, bad


# ---- log store -----------------------------------------------------------------

STORE_SCHEMA = StructType([StructField("id", StringType()), *LOGS_SCHEMA, StructField("dt", DateType())])


def content_id(columns: list[str]):
    """An id for a row that brings none: a digest of its values."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"))


def store_id(content: list[str], ts_col: str = "timestamp", service_col: str = "service"):
    """``{iso timestamp}_{service}``; a row without a time has the digest of its ``content`` for it."""
    return F.concat_ws("_", F.coalesce(iso_text(F.col(ts_col)), content_id(content)), F.col(service_col))


def bulk_id(content: list[str], ts_col: str = "timestamp", index_col: str = "event_id"):
    """``log_{iso timestamp}_{index}``: two logs of a service at one time stay two.  A row without an index has the digest
    of its ``content`` for it."""
    index = F.coalesce(F.col(index_col).cast("string"), content_id(content))
    return F.concat_ws("_", F.lit("log"), iso_text(F.col(ts_col)), index)


def log_store_append(spark: SparkSession, path: str, batch: DataFrame, exists: bool, bulk: bool = False) -> DataFrame:
    """Append a batch to the partitioned Parquet store; an existing id is kept.

    Ids are ``{iso timestamp}_{service}``, or with ``bulk``
    ``log_{iso timestamp}_{event_id}`` (a digest of the row in place of a
    missing time or index); within the batch the lowest
    event_id wins (an aggregate, not a window).  The anti join reads the
    store's partitions between the batch's first and last date only (two
    dates reach the driver); rows without a time go to the partition without a date.
    """
    content = [c for c in LOG_STORE_COLUMNS if c != "id"]
    b = batch.withColumn("id", bulk_id(content) if bulk else store_id(content)).withColumn("dt", F.to_date("timestamp"))
    cols = [c for c in LOG_STORE_COLUMNS if c != "id"] + ["dt"]
    first = F.min_by(F.struct(*cols), F.struct(F.col("event_id").isNull(), "event_id"))       # min_by passes over NULLs
    b = b.groupBy("id").agg(first.alias("r")).select("id", "r.*")
    if exists:
        lo, hi = batch.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()
        old = log_store(spark, path).select("dt", "id")
        here = F.col("dt").between(F.lit(lo), F.lit(hi)) if lo else F.lit(False)
        b = b.join(old.where(here | F.col("dt").isNull()).select("id"), "id", "left_anti")
    by_date(b.select(*LOG_STORE_COLUMNS, "dt")).write.mode("append").partitionBy("dt").parquet(path)
    return log_store(spark, path)


def log_store(spark: SparkSession, path: str) -> DataFrame:
    """The store's table, by its known schema (it may hold no row)."""
    return spark.read.schema(STORE_SCHEMA).parquet(path)


def log_store_scan(spark: SparkSession, path: str, columns: list[str] | None = None,
                   where=None) -> DataFrame:
    df = log_store(spark, path)
    if where is not None:
        df = df.where(where)
    return df.select(*(columns or LOG_STORE_COLUMNS))


def log_store_retention(spark: SparkSession, path: str, new_path: str, keep_after) -> DataFrame:
    """Rewrite the store keeping rows newer than ``keep_after`` (strict).

    The dt predicate prunes whole partitions; the row predicate trims the
    boundary day.  A full wipe, where no row is kept, leaves an empty store.
    """
    kept = log_store(spark, path).where((F.col("dt") >= F.to_date(keep_after)) & (F.col("timestamp") > keep_after))
    by_date(kept).write.mode("overwrite").partitionBy("dt").parquet(new_path)
    return log_store(spark, new_path)


# ---- feedback ------------------------------------------------------------------

ANALYSIS_FIELDS = ["root_cause", "confidence_score", "affected_service", "recommended_action"]


def feedback_append(feedback: DataFrame, path: str) -> None:
    """Append {timestamp, rating, event_id, analysis} as JSON lines."""
    (feedback.select("timestamp", "rating", "event_id",
                     F.struct(*ANALYSIS_FIELDS).alias("analysis"))
     .write.mode("append").option("timestampNTZFormat", TS_FORMAT).json(path))


FEEDBACK_SCHEMA = StructType([
    StructField("timestamp", TimestampNTZType()), StructField("rating", StringType()),
    StructField("event_id", LongType()),
    StructField("analysis", StructType([
        StructField("root_cause", StringType()), StructField("confidence_score", DoubleType()),
        StructField("affected_service", StringType()), StructField("recommended_action", StringType())]))])


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK_SCHEMA).option("timestampNTZFormat", TS_FORMAT).json(path)


def feedback_latest(feedback: DataFrame) -> DataFrame:
    """Latest rating per analysis (ties: positive before negative)."""
    latest = F.max_by(F.struct("timestamp", "rating", "analysis"), F.struct("timestamp", "rating"))
    return feedback.groupBy("event_id").agg(latest.alias("f")).select("event_id", "f.*")


def feedback_gold(feedback: DataFrame) -> DataFrame:
    """Analyses whose latest rating is positive: the fine-tuning gold set."""
    return feedback_latest(feedback).where(F.col("rating") == "positive").select(
        "event_id", "timestamp", *[F.col(f"analysis.{f}").alias(f) for f in ANALYSIS_FIELDS])


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return feedback_latest(feedback).groupBy("rating").agg(F.count(F.lit(1)).alias("analyses"))
