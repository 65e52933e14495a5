"""Streaming queries equal their batch twins, whatever the micro-batch sizes."""

import os
import tempfile
from datetime import datetime, timedelta

from pyspark import SparkContext
from pyspark.sql import functions as F

from kestrel import session
from kestrel.operators import timeseries
from kestrel.streaming import pipeline as S

T0 = datetime(2024, 3, 1, 12, 0, 0)
LOG_SCHEMA = ("event_id long, timestamp timestamp_ntz, service string, level string, message string, "
              "latency_ms double, db_lock_time double, pool_wait_ms double, error_count int")


def _tmp():
    return tempfile.mkdtemp(prefix="kestrel-test-")


def _write_batches(spark, rows, schema, path, chunks):
    n = len(rows)
    for i in range(chunks):
        part = rows[i * n // chunks:(i + 1) * n // chunks]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_stream_cooldown_equals_batch(spark):
    secs = [0, 5, 12, 29, 31, 33, 70, 71, 99, 101, 130, 200, 229, 230, 400]
    rows = [(svc, i * 10 + k, T0 + timedelta(seconds=s + k)) for i, s in enumerate(secs) for k, svc in
            enumerate(["a", "b"])]
    schema = "service string, event_id long, timestamp timestamp_ntz"
    batch = {(r["service"], r["event_id"]) for r in
             timeseries.cooldown(spark.createDataFrame(rows, schema), 30).collect()}
    d = _tmp()
    _write_batches(spark, rows, schema, d + "/in", 5)
    src = S.read_table_stream(spark, d + "/in", spark.read.parquet(d + "/in").schema, files_per_trigger=1)
    q = S.write_parquet(S.cooldown_stream(src, 30), d + "/out", d + "/ck")
    q.awaitTermination()
    got = {(r["service"], r["event_id"]) for r in spark.read.parquet(d + "/out").collect()}
    assert got == batch
    assert len(got) == 2 * 7          # 0, 31, 70, 101, 200, 230, 400 per key


def test_stream_burst_late_rows(spark):
    # Errors in time order, then a late error within the watermark (counts)
    # and one far behind it (dropped, as the reference never sees it).
    base = [(i, T0 + timedelta(seconds=10 * i), "a", "ERROR", "m", 1.0, 0.0, 0.0, 1) for i in range(5)]
    later = [(100, T0 + timedelta(minutes=30), "a", "INFO", "m", 1.0, 0.0, 0.0, 0)]
    late_ok = [(101, T0 + timedelta(minutes=25), "a", "ERROR", "m", 1.0, 0.0, 0.0, 1)]
    too_late = [(102, T0 + timedelta(seconds=5), "a", "ERROR", "m", 1.0, 0.0, 0.0, 1)]
    flush = [(103, T0 + timedelta(hours=2), "a", "INFO", "m", 1.0, 0.0, 0.0, 0)]
    d = _tmp()
    for chunk in (base, later, late_ok, too_late, flush):
        spark.createDataFrame(chunk, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(d + "/in")
    src = S.read_table_stream(spark, d + "/in", spark.read.parquet(d + "/in").schema, files_per_trigger=1)
    q = S.write_parquet(S.burst_stream(src), d + "/out", d + "/ck")
    q.awaitTermination()
    got = {(r["window_start"], r["errors"]) for r in spark.read.parquet(d + "/out").collect()}
    batch = {(r["window_start"], r["errors"]) for r in
             timeseries.burst_sliding(spark.createDataFrame(base + later + late_ok, LOG_SCHEMA)).collect()}
    assert got == batch and len(got) > 0


def test_stream_ingest_store_and_metrics(spark):
    d = _tmp()
    lines = ['{"request_id": 1, "timestamp": "2024-03-01T12:00:00.000000", "service": "a", "latency": 5.0, "message": "x"}',
             '{"request_id": 2, "timestamp": "2024-03-01T12:00:00.000000", "service": "a", "level": "ERROR", "latency": 6.0, "message": "y"}',
             '{"request_id": 3, "timestamp": "2024-03-01T12:00:01.000000", "service": "b", "latency": 7.0, "message": "z"}',
             '{"request_id": 4, "timestamp": "bad", "service": "b", "latency": 7.0, "message": "z"}',
             '{"request_id": 5, "timest']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(d + "/in")
    for k in range(2):          # the second run gets id 2 again, older than anything a watermark would keep, and a new one
        if k:
            more = [lines[1], '{"request_id": 9, "timestamp": "2023-01-01T00:00:00+02:00", "service": "a", "latency": 1.0, "message": "x"}']
            spark.createDataFrame([(x,) for x in more], "value string").write.mode("append").text(d + "/in")
        S.ingest_to_tables(S.submissions_stream(spark, d + "/in"), d + "/out").awaitTermination()
    out = {r["request_id"]: r for r in S.ingested(spark, d + "/out").collect()}
    assert sorted(out) == [1, 2, 3, 9]
    assert out[1]["level"] == "INFO" and str(out[9]["timestamp"]) == "2022-12-31 22:00:00"
    assert sorted(r["reason"] for r in S.quarantined(spark, d + "/out").collect()) == ["bad_timestamp", "malformed"]
    m = S.ingest_metrics(spark, d + "/out").collect()[0]
    assert (m["submitted"], m["accepted"], m["refused"], m["repeated"], m["errors"]) == (7, 4, 2, 1, 1)


def test_the_package_is_shipped_once_whichever_thread_asks_first(spark, monkeypatch):
    # A cluster's file server refuses a second file of a name; every micro-batch of a stream asks from the stream's thread.
    sent = []
    monkeypatch.setattr(SparkContext, "addPyFile", lambda self, path: sent.append(os.path.basename(path)))
    monkeypatch.setattr(session, "_SHIPPED", type(session._SHIPPED)())
    line = '{{"request_id": {}, "timestamp": "2024-03-01T12:00:00", "service": "a", "latency": 5.0, "message": "x"}}'
    d = _tmp()
    for k in range(3):
        spark.createDataFrame([(line.format(k),)], "value string").write.mode("append").text(d + "/in")
        S.ingest_to_tables(S.submissions_stream(spark, d + "/in"), d + "/out").awaitTermination()
    session.ship_package(spark)
    assert len(sent) == 1 and S.ingested(spark, d + "/out").count() == 3
