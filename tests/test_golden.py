"""Small golden frames from the reference's own tests and scripts (FIXTURES §4)."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kestrel.operators import clean, graph, rules, similarity, timeseries
from kestrel.operators import causal
from kestrel.operators import synth

T0 = datetime(2024, 3, 1, 12, 0, 0)
EDGE_SCHEMA = ("from_service string, to_service string, ts timestamp_ntz, latency_ms double, "
               "cpu_percent double, memory_percent double, seq long")


def ntz(dt):
    return F.expr(f"TIMESTAMP_NTZ '{dt:%Y-%m-%d %H:%M:%S.%f}'")


@pytest.fixture
def basics(spark):
    rows = [("ServiceA", "ServiceB", T0 - timedelta(seconds=20), 10.0, None, None, 1),
            ("ServiceA", "ServiceB", T0 - timedelta(seconds=5), 10.5, None, None, 2),
            ("ServiceC", "ServiceB", T0 - timedelta(seconds=2), 20.0, None, None, 3),
            ("ServiceA", "ServiceB", T0 - timedelta(seconds=1), 12.0, 55.0, None, 4)]
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def test_graph_basics(basics):
    assert graph.topology_nodes(basics).count() == 3
    assert graph.topology_edges(basics).count() == 2
    state = {r["service"]: r["current_cpu"] for r in graph.node_state(basics).collect()}
    assert state == {"ServiceA": 55.0}
    nb = graph.causal_neighbors(basics, "ServiceB", ntz(T0), 3.0).collect()
    by_up = {}
    for r in nb:
        by_up.setdefault(r["upstream"], []).append(r["ts"])
    assert set(by_up) == {"ServiceA", "ServiceC"}
    assert by_up["ServiceA"] == [T0 - timedelta(seconds=1)]


def test_neighbor_cutoff_inclusive(basics):
    # The observation exactly at the window edge (t - 5 s, window 5 s) is included.
    nb = graph.causal_neighbors(basics, "ServiceB", ntz(T0), 5.0)
    assert nb.where(F.col("upstream") == "ServiceA").count() == 2


def test_graph_volume(spark):
    rows = [(f"S{w}", "Target", T0 + timedelta(milliseconds=w * 100 + i), 10.0, None, None, w * 100 + i)
            for w in range(5) for i in range(100)]
    e = spark.createDataFrame(rows, EDGE_SCHEMA)
    assert graph.topology_nodes(e).count() == 6
    nb = graph.causal_neighbors(e, "Target", ntz(T0 + timedelta(seconds=1)), 10.0)
    assert nb.count() == 500


LOG_SCHEMA = ("event_id long, timestamp timestamp_ntz, service string, level string, message string, "
              "latency_ms double, db_lock_time double, pool_wait_ms double, error_count int")


def _errors(spark, n, gap_s=0.5, start=T0):
    rows = [(i, start + timedelta(seconds=gap_s * i), "payment-db", "ERROR", "Connection timeout", 4000.0,
             0.0, 0.0, 1) for i in range(n)]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_incident_fires_once(spark):
    logs = _errors(spark, 5)
    burst = timeseries.error_burst(logs, minutes=5)
    assert burst.where("anomaly").count() == 2          # the 4th and 5th error see > 3
    firings = timeseries.cooldown(burst.where("anomaly"), seconds=30)
    assert firings.count() == 1
    sliding = timeseries.burst_sliding(logs)
    assert sliding.count() >= 1


def test_boundary_three_errors(spark):
    burst = timeseries.error_burst(_errors(spark, 3), minutes=5)
    assert burst.where("anomaly").count() == 0
    assert timeseries.burst_sliding(_errors(spark, 3)).count() == 0


def test_trailing_window_strict_and_bucket_crossing(spark):
    # errors at 0, 299.999999 s, 300 s: the one exactly 5 min older is outside.
    rows = [(0, T0, "s", "ERROR", "m", 1.0, 0.0, 0.0, 1),
            (1, T0 + timedelta(microseconds=299_999_999), "s", "ERROR", "m", 1.0, 0.0, 0.0, 1),
            (2, T0 + timedelta(seconds=300), "s", "ERROR", "m", 1.0, 0.0, 0.0, 1)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    got = {r["event_id"]: r["errors_in_window"] for r in timeseries.error_burst(logs, 5).collect()}
    assert got == {0: 1, 1: 2, 2: 2}


def test_cooldown_greedy(spark):
    # candidates at 0, 10, 29, 30, 45, 61, 100 s -> fire at 0, 30, 61, 100
    secs = [0, 10, 29, 30, 45, 61, 100]
    rows = [("svc", i, T0 + timedelta(seconds=s)) for i, s in enumerate(secs)]
    c = spark.createDataFrame(rows, "service string, event_id long, timestamp timestamp_ntz")
    fired = sorted(r["event_id"] for r in timeseries.cooldown(c, 30).collect())
    assert fired == [0, 3, 5, 6]


def test_recent_cutoff_strict(spark):
    now = T0
    rows = [(0, now - timedelta(minutes=30), "a", "ERROR", "m", 1.0, 0.0, 0.0, 1),
            (1, now - timedelta(minutes=29), "a", "ERROR", "m", 1.0, 0.0, 0.0, 1),
            (2, now - timedelta(minutes=1), "a", "INFO", "m", 1.0, 0.0, 0.0, 0)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    got = [r["event_id"] for r in clean.recent_errors(logs, 30, ntz(now)).collect()]
    assert got == [1]


def test_knn_no_match_is_empty(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)],
                                   "vec_id long, embedding array<float>, label int")
    q = spark.createDataFrame([(99, [1.0, 0.0], 7)], "query_id long, query_vec array<float>, query_filter int")
    assert similarity.knn(corpus, q, n=5).count() == 0
    q2 = spark.createDataFrame([(99, [1.0, 0.0], 1)], "query_id long, query_vec array<float>, query_filter int")
    res = similarity.knn(corpus, q2, n=5).orderBy("rank").collect()
    assert [r["vec_id"] for r in res] == [1, 2]          # n = min(n, matches)
    assert res[0]["similarity"] == 1.0


def test_short_history_no_forecast(spark):
    rows = [(i, T0 + timedelta(minutes=i), "a", "INFO", "m", 10.0 + i, 0.0, 0.0, 0) for i in range(4)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    assert timeseries.forecast_fit(logs, ["service"]).count() == 0


def test_forecast_matches_numpy(spark):
    import numpy as np
    rows = [(i, T0 + timedelta(minutes=7 * i, seconds=i % 13), "a", "INFO", "m",
             50.0 + 0.3 * i + 0.01 * i * i + (i % 5), 0.0, 0.0, 0) for i in range(60)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    fit = timeseries.forecast_fit(logs, ["service"]).collect()[0]
    x = np.array([(r[1] - rows[0][1]).total_seconds() / 86400 for r in rows])
    y = np.array([r[5] for r in rows])
    c2, c1, c0 = np.polyfit(x, y, 2)
    assert fit["coef0"] == pytest.approx(c0, rel=1e-7)
    assert fit["coef1_per_day"] == pytest.approx(c1, rel=1e-7)
    assert fit["coef2_per_day2"] == pytest.approx(c2, rel=1e-6)
    h = timeseries.forecast_horizon(timeseries.forecast_fit(logs, ["service"]), ["service"])
    assert h.count() == 30
    slo = timeseries.slo_breach(h, ["service"]).collect()[0]
    assert slo["will_breach_slo"] is False


def test_guardrail_cases(spark):
    cmds = ["kubectl delete pod x", "kubectl scale deployment a", "aws set x", "kubectl get pods",
            "kubectl scale x --force"]
    df = spark.createDataFrame([(i, "s", c) for i, c in enumerate(cmds)], "event_id long, service string, command string")
    got = [(r["is_safe"], r["security_score"]) for r in rules.guardrail_audit(df).orderBy("event_id").collect()]
    assert got == [(False, 0), (True, 100), (True, 80), (True, 70), (False, 50)]
    word = rules.guardrail_audit(spark.createDataFrame([(0, "s", "kubectl reset offset")],
                                                       "event_id long, service string, command string"),
                                 word_match=True).collect()[0]
    assert word["security_score"] == 70                   # 'set' is not a whole word here


def test_scm_recovers_slope(spark):
    spine = spark.range(2000).withColumnRenamed("id", "event_id")
    scm = synth.synth_scm(spine).withColumnRenamed("service_name", "service")
    scan = causal.effect_scan(scm, ["cpu_percent", "memory_percent", "latency_ms", "error_raw"],
                              confounder="cpu_percent")
    row = scan.where((F.col("treatment") == "latency_ms") & (F.col("outcome") == "error_raw")).collect()[0]
    assert abs(row["naive_slope"] - 0.05) < 0.011          # 3 SE at n = 2000


def test_diagnosis_parse_forms(spark):
    raws = ['{"root_cause": "x", "confidence_score": 0.9, "affected_service": "a", "recommended_action": "scale_up"}',
            '{"SRE_DIAGNOSIS": "y", "CONFIDENCE": 0.85, "CLI_MITIGATION": "increase_pool", '
            '"CAUSAL_BRIDGE": ["a", "b"], "SERVICE": "b"}',
            'not json', '[1, 2]']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "event_id long, raw string")
    p = {r["event_id"]: r for r in rules.diagnosis_parse(df).collect()}
    assert p[0]["schema"] == "A" and p[0]["confidence_score"] == 0.9
    assert p[1]["schema"] == "B" and p[1]["reasoning"] == "a\n- b" and p[1]["affected_service"] == "b"
    assert p[2]["schema"] == "none" and p[2]["confidence_score"] == 0.0
    assert p[2]["recommended_action"] == "page_human"
    assert p[3]["schema"] == "none"
    gated = rules.action_gate(rules.diagnosis_parse(df)).collect()
    assert sorted(r["event_id"] for r in gated) == [0, 1]


def test_dag_confounders(spark):
    from kestrel.fixed import CAUSAL_EDGES
    dag = spark.createDataFrame(CAUSAL_EDGES, "cause string, effect string")
    conf = {r["confounder"] for r in graph.dag_confounders(dag, "pool_wait_ms", "error_count").collect()}
    assert conf == {"db_lock_time"}


def test_cooldown_of_dense_candidates(spark):
    # One run of candidates, cut into many segments and into one.
    import random
    rnd = random.Random(3)
    t, rows = 0.0, []
    for i in range(400):
        t += rnd.choice([0.5, 1, 3, 7, 12, 29.5, 30, 31])
        rows.append(("k" + str(i % 2), i, T0 + timedelta(seconds=t)))
    c = spark.createDataFrame(rows, "service string, event_id long, timestamp timestamp_ntz")
    fold = {(r["service"], r["event_id"]) for r in timeseries.cooldown(c, 30).collect()}
    dbl = {(r["service"], r["event_id"]) for r in timeseries.cooldown(c, 30, segment_points=5).collect()}
    # brute force
    expect = set()
    for k in ("k0", "k1"):
        last = None
        for svc, i, ts_ in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            if last is None or (ts_ - last).total_seconds() >= 30:
                expect.add((svc, i))
                last = ts_
    assert fold == expect
    assert dbl == expect


def test_edge_match_across_bucket_boundary(spark):
    b = datetime(2024, 3, 1, 12, 0, 1)          # a whole second: a bucket boundary
    rows = [("A", "B", b - timedelta(microseconds=400), 1.0, None, None, 1),
            ("A", "B", b + timedelta(microseconds=500), 1.0, None, None, 2),
            ("A", "B", b + timedelta(microseconds=1500), 1.0, None, None, 3),
            ("A", "C", b, 1.0, None, None, 4)]
    e = spark.createDataFrame(rows, EDGE_SCHEMA)
    got = {r["log_seq"]: (r["matched_seq"], r["candidates"]) for r in graph.edge_obs_match(e, e).collect()}
    # 1 sees 1, 2 (0.9 ms); 2 sees 1, 2, 3 (1.0 ms is not < 1 ms: 3 - 2 is exactly 1000 us -> excluded)
    assert got[1] == (1, 2)
    assert got[2] == (1, 2)
    assert got[3] == (3, 1)
    assert got[4] == (4, 1)


def test_greedy_chase_matches_loop_across_batches():
    """The binary-search chase equals the greedy loop, also when a batch
    starts from the previous batch's last firing (the streaming state)."""
    import numpy as np

    from kestrel.operators.timeseries import greedy_chase

    rng = np.random.default_rng(7)
    t = np.sort(rng.integers(0, 10_000, size=2_000))
    c = 37

    def loop(ts, last=None):
        out = []
        for i, x in enumerate(ts):
            if last is None or x - last >= c:
                last = x
                out.append(i)
        return out

    assert greedy_chase(t, c) == loop(t)
    for cut in (1, 500, 1999):
        first = greedy_chase(t[:cut], c)
        last = int(t[:cut][first[-1]])
        rest = [cut + i for i in greedy_chase(t[cut:], c, last + c)]
        assert first + rest == loop(t)
