"""Contracts of ingest, store, walks, searches and rules on small frames."""

from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions.exprs import to_number
from kestrel.operators import causal, graph, rules, similarity, synth
from kestrel.session import scratch_path
from kestrel.sources import files

T0 = datetime(2024, 3, 1, 12, 0, 0)


@pytest.mark.parametrize("text,want", [
    ("2024-03-01T12:00:00", T0), ("2024-03-01 12:00:00", T0), ("2024-03-01T12:00", T0), ("2024-03-01T12", T0),
    ("2024-03-01", datetime(2024, 3, 1)), ("2024-03-01T12:00:00.123456", T0.replace(microsecond=123456)),
    ("2024-03-01T12:00:00.123", T0.replace(microsecond=123000)), ("2024-03-01T12:00:00Z", T0),
    ("2024-03-01T12:00:00.123456+00:00", T0.replace(microsecond=123456)), ("2024-03-01T14:00:00+02:00", T0),
    ("2024-03-01T14:00:00+0200", T0), ("2024-03-01T14+02", T0), ("yesterday", None), ("2024-13-01T00:00:00", None),
    ("2024-03-01T25:00:00", None), ("12:00:00", None), ("", None), (None, None),
    ("20240301T120000", T0), ("20240301", datetime(2024, 3, 1)), ("2024-W09-5T12:00:00", T0), ("2024W095T1200", T0), ("2024-W09-5", datetime(2024, 3, 1)),
    ("2024-W09", datetime(2024, 2, 26)), ("2020-W53-7", datetime(2021, 1, 3)), ("2021-W53-1", None), ("2024-W00-1", None), ("2024-W09-8", None),
    ("2024-03-01T12:00:00.1", T0.replace(microsecond=100000)), ("2024-03-01T12:00:00,12345678", T0.replace(microsecond=123456)),
    ("20240301T120000.5+0530", datetime(2024, 3, 1, 6, 30, 0, 500000)), ("2024-03-01T12:00:00-01:30:15.5", datetime(2024, 3, 1, 13, 30, 15, 500000)),
    ("2024-02-30", None), ("2024-03-01T12:60", None), ("2024-03-01T12:00:61", None), ("2024-03-01T12:00+25:00", None), ("2024-03-01T", None),
    ("2024-03-01T12:00:00.", None), ("|||", None), ("2024-0301", None), ("2024-03-01T12:00:00Z ", None)])
def test_iso_forms(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string").select(files.iso_timestamp(F.col("t")).alias("ts"))
    assert df.first()["ts"] == want


def test_iso_forms_as_the_standard_library_reads_them(spark):
    import random
    rng, forms = random.Random(2), ["%Y-%m-%d", "%Y%m%d", "%G-W%V-%u", "%GW%V%u"]
    times, offsets = ["", "T%H", "T%H:%M", " %H%M", "T%H:%M:%S", "T%H%M%S", "T%H:%M:%S.%f", "T%H%M%S,%f"], ["", "Z", "+01", "-0230", "+05:45", "-11:00:30"]
    texts = []
    for _ in range(400):
        t = datetime(rng.randrange(1980, 2040), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(24), rng.randrange(60), rng.randrange(60), rng.randrange(10**6))
        clock = rng.choice(times)
        text = t.strftime(rng.choice(forms)) + t.strftime(clock) + (rng.choice(offsets) if clock else "")
        texts.append(text[:-rng.randrange(1, 6)] if clock.endswith("%f") and text[-1].isdigit() and "+" not in text and "-" not in text[10:] else text)

    def read(text):
        try:
            t = datetime.fromisoformat(text)
        except ValueError:
            return None
        return t if t.tzinfo is None else t.astimezone(timezone.utc).replace(tzinfo=None)
    df = spark.createDataFrame([(x,) for x in texts], "t string").select("t", files.iso_timestamp(F.col("t")).alias("ts"))
    wrong = [(r["t"], r["ts"], read(r["t"])) for r in df.collect() if r["ts"] != read(r["t"])]
    assert not wrong


def test_rows_without_an_id_or_a_time_stay(spark):
    rows = spark.createDataFrame([(None, None, "a", "INFO", f"m{i % 3}", float(i % 2), None, None, 0) for i in range(12)], files.LOGS_SCHEMA)
    for bulk in (False, True):
        path = scratch_path(spark, "no_time")
        assert files.log_store_append(spark, path, rows, False, bulk=bulk).count() == 6           # six different rows
        kept = files.log_store_append(spark, path, rows, True, bulk=bulk).collect()                # which are there already
        assert sorted((r["message"], r["latency_ms"], r["service"]) for r in kept) == [(f"m{i}", j, "a") for i in range(3) for j in (0.0, 1.0)]


def test_submissions_need_latency_and_message(spark):
    rows = [(1, "2024-03-01T12:00:00", "a", None, 1.0, "m", None), (2, "2024-03-01T12:00:00", "a", "INFO", None, "m", None),
            (3, "2024-03-01T12:00:00", "a", "INFO", 1.0, None, None), (4, "2024-03-01T12:00:00", None, "INFO", 1.0, "m", None)]
    good, bad = files.split_submissions(spark.createDataFrame(rows, files.SUBMISSION_SCHEMA))
    assert [r["request_id"] for r in good.collect()] == [1]
    assert {r["request_id"]: r["reason"] for r in bad.collect()} == {2: "missing_latency", 3: "missing_message", 4: "missing_service"}


def _logs(spark, rows):
    return spark.createDataFrame([(i, t, s, "INFO", "m", 1.0, 0.0, 0.0, 0) for i, t, s in rows], files.LOGS_SCHEMA)


def test_store_reads_only_the_dates_of_a_batch(spark):
    path = scratch_path(spark, "store_dates")
    files.log_store_append(spark, path, _logs(spark, [(i, T0 + timedelta(days=i), "a") for i in range(5)]), False)
    more = _logs(spark, [(10, T0 + timedelta(days=4), "a"), (11, T0 + timedelta(days=4, hours=1), "a")])
    assert files.log_store_append(spark, path, more, True).count() == 6
    plan = files.log_store(spark, path).where(F.col("dt").between(F.lit(T0.date()), F.lit(T0.date())))
    assert "PartitionFilters: [isnotnull(dt" in plan._jdf.queryExecution().executedPlan().toString().replace("\n", "")
    wiped = files.log_store_retention(spark, path, scratch_path(spark, "wiped"), F.lit(datetime(2100, 1, 1)).cast("timestamp_ntz"))
    assert wiped.count() == 0


def test_bulk_ids_keep_logs_of_one_time(spark):
    rows = _logs(spark, [(1, T0, "a"), (2, T0, "a")])
    for bulk, n in ((False, 1), (True, 2)):
        path = scratch_path(spark, "bulk")
        assert files.log_store_append(spark, path, rows, False, bulk=bulk).count() == n


def test_reachability_follows_long_chains(spark):
    chain = spark.createDataFrame([(f"s{i:03}", f"s{i + 1:03}") for i in range(80)], "from_service string, to_service string")
    far = graph.reachability(chain).where("ancestor = 's000'").agg(F.max("hops")).first()[0]
    assert far == 80
    assert graph.ancestors(chain, "s080").count() == 80


def test_global_last_n_over_many_slices(spark):
    edges = spark.range(20_000).select((F.col("id") * 7).alias("seq"), F.lit("a").alias("from_service"))
    got = [r["seq"] for r in graph.global_last_n(edges, 500).collect()]
    assert got == [7 * i for i in range(19_999, 19_499, -1)]


def test_knn_ranks_on_the_raw_score(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0006], 0), (2, [1.0, 0.0002], 0)], "vec_id long, embedding array<double>, label int")
    q = spark.createDataFrame([(9, [1.0, 0.0], 0)], "query_id long, query_vec array<double>, query_filter int")
    assert [r["vec_id"] for r in similarity.knn(corpus, q, n=1).collect()] == [2]


def test_words_keep_accented_letters(spark):
    a, b = "Raboñ ciónciasdo", "Raboñ größe"
    out = similarity.text_embed(spark.createDataFrame([(1, a), (2, b), (3, "x")], "doc_id long, text string"))
    vectors = {r["doc_id"]: np.array(r["embedding"]) for r in out.collect()}
    assert [int((vectors[i] != 0).sum()) for i in (1, 2, 3)] == [2, 2, 1]
    assert vectors[1] @ vectors[2] > 0


def test_numbers_have_no_suffix(spark):
    df = spark.createDataFrame([("12",), ("12d",), ("1f",), (" 1.5 ",), ("-3e2",), ("NaN",), ("",), (None,)], "v string")
    assert [r[0] for r in df.select(to_number(F.col("v"))).collect()] == [12.0, None, None, 1.5, -300.0, None, None, None]


def test_missing_action_is_flagged(spark):
    d = spark.createDataFrame([(None, 0.5), ("scale_up", None), ("scale_up", 0.5)], "recommended_action string, confidence_score double")
    s = rules.validation_summary(rules.action_validate(d)).first()
    assert (s["diagnoses"], s["bad_action"], s["bad_confidence"], s["valid"]) == (3, 1, 1, 1)


def test_failed_diagnoses_name_the_service(spark):
    d = spark.createDataFrame([(1, "api", "Error code: 429"), (2, "api", "boom"), (3, None, "[1]")], "event_id long, service string, raw string")
    out = {r["event_id"]: r for r in rules.diagnosis_parse(d).collect()}
    assert [out[i]["confidence_score"] for i in (1, 2, 3)] == [0.1, 0.0, 0.0]
    assert [out[i]["affected_service"] for i in (1, 2, 3)] == ["api", "api", "unknown"]


@pytest.mark.parametrize("rule,service,latency,lock,pool,diagnosis", [
    ("T-01", "api-gateway", 4000.0, 0.0, 0.0, "Ingress Congestion"), ("T-02", "payment-db", 100.0, 850.0, 0.0, "Database Row Locking"),
    ("T-03", "redis-cache", 1200.0, 0.0, 0.0, "Cache Eviction Pressure"),
    ("T-04", "user-service", 100.0, 100.0, 500.0, "Connection Pool Exhaustion")])
def test_reference_scenarios(spark, rule, service, latency, lock, pool, diagnosis):
    table = similarity.rules_frame(spark, similarity.REFERENCE_RULES)
    schema = "event_id long, service string, latency_ms double, db_lock_time double, pool_wait_ms double"
    logs = spark.createDataFrame([(1, service, latency, lock, pool), (2, service, 10.0, 200.0, 10.0), (3, "other", latency, lock, pool)], schema)
    got = similarity.scenario_match(logs, table).collect()
    assert [(r["event_id"], r["rule_id"], r["diagnosis"]) for r in got] == [(1, rule, diagnosis)]


def test_placebo_draws_are_independent(spark):
    ids = spark.range(3000).select("id", *[causal.placebo_hash(F.col("id"), F.lit(s)).alias(f"s{s}") for s in (1, 2, 3)])
    x = np.array([r[1:] for r in ids.collect()])
    assert abs(np.corrcoef(x.T) - np.eye(3)).max() < 0.06
    assert np.ptp((x[:, 1] - x[:, 0]) % 1) > 0.9 and abs(x.mean() - 0.5) < 0.02


def test_pc_orients_a_collider_and_a_chain():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 5000))
    c = a + b + 0.5 * rng.normal(size=5000)
    d = c + 0.5 * rng.normal(size=5000)
    pairs, apart, arrows = causal.pc_search(np.corrcoef([a, b, c, d]), 5000, list("abcd"), z_crit=3.5)
    assert pairs == [(0, 2), (1, 2), (2, 3)]
    assert arrows == {(0, 2), (1, 2), (2, 3)}
    assert apart[0, 1] == () and apart[0, 3] == (2,)


def test_pc_on_twenty_variables():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=4000)]
    for i in range(1, 20):
        x.append(0.9 * x[(i - 1) // 2] + rng.normal(size=4000))
    pairs, _, _ = causal.pc_search(np.corrcoef(x), 4000, [f"v{i}" for i in range(20)], z_crit=3.5)
    assert set(pairs) >= {((i - 1) // 2, i) for i in range(1, 20)} and len(pairs) <= 21


def test_generated_minutes_take_large_ids(spark):
    big = spark.createDataFrame([(3_000_000_000,)], "event_id long")
    assert synth.synth_scm(big).count() == 1
