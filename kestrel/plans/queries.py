"""Every registered query: an operator bound to the driver's tables.

Each entry takes (spark, sf_dir) and returns a DataFrame over the whole
tables.  Parameters (windows, k, thresholds) are fixed here and mirrored in
``oracles.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import aggregates as agg
from kestrel.operators import clean
from kestrel.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

def NOW():
    return T.ts_ntz(T.FIXTURE_NOW)

RECENT_MINUTES = 1440


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def raw_telemetry(logs: DataFrame) -> DataFrame:
    """Metrics as text, as the reference's stores hand them over, with bad values."""
    return logs.select(
        "event_id",
        F.when(F.col("event_id") % 11 == 0, F.lit("n/a"))
         .otherwise(F.col("latency_ms").cast("string")).alias("latency_ms"),
        F.when(F.col("event_id") % 13 == 0, F.lit(""))
         .otherwise(F.col("db_lock_time").cast("string")).alias("db_lock_time"),
        F.when(F.col("event_id") % 19 == 0, F.lit("NaN"))
         .otherwise(F.col("pool_wait_ms").cast("string")).alias("pool_wait_ms"),
        F.col("error_count").cast("string").alias("error_count"))


def _errors(spark, sf):
    logs = T.load_logs(spark, sf)
    return logs.where(F.col("error_count") >= 1)


# ---- 2.2 projections, filters, cleaning ---------------------------------

@query("normalise_telemetry")
def q_normalise(spark, sf):
    return clean.normalise_telemetry(raw_telemetry(T.load_logs(spark, sf)))


@query("drop_incomplete")
def q_drop_incomplete(spark, sf):
    return clean.drop_incomplete(clean.normalise_telemetry(raw_telemetry(T.load_logs(spark, sf))))


@query("error_flag")
def q_error_flag(spark, sf):
    return clean.with_error_flag(T.load_logs(spark, sf).select("event_id", "level"))


@query("derive_level")
def q_derive_level(spark, sf):
    logs = T.load_logs(spark, sf).select("event_id", "error_count", "latency_ms")
    return clean.with_derived_level(logs).select("event_id", "level")


@query("recent_errors")
def q_recent_errors(spark, sf):
    return clean.recent_errors(T.load_logs(spark, sf), minutes=RECENT_MINUTES, now=NOW())


@query("recent_errors_latest")
def q_recent_errors_latest(spark, sf):
    # 'now' taken from the data: the newest log timestamp (scalar subquery).
    return clean.recent_errors(T.load_logs(spark, sf), minutes=RECENT_MINUTES)


@query("filter_service")
def q_filter_service(spark, sf):
    return clean.filter_service(T.load_logs(spark, sf), "payment-db").select(*clean.LOG_COLUMNS)


@query("recent_logs")
def q_recent_logs(spark, sf):
    return clean.recent_logs(T.load_logs(spark, sf).select(*clean.LOG_COLUMNS), 20)


@query("log_cards")
def q_log_cards(spark, sf):
    return clean.log_cards(_errors(spark, sf))


@query("latest_error")
def q_latest_error(spark, sf):
    return clean.latest_error(T.load_logs(spark, sf))


# ---- 2.3 aggregations, sorts, top-k -------------------------------------

@query("service_rank")
def q_service_rank(spark, sf):
    return agg.service_rank(_errors(spark, sf))


@query("incident_stats")
def q_incident_stats(spark, sf):
    return agg.incident_stats(_errors(spark, sf))


@query("distinct_messages")
def q_distinct_messages(spark, sf):
    return agg.distinct_messages(T.load_logs(spark, sf), k=3)


@query("distinct_messages_newest")
def q_distinct_messages_newest(spark, sf):
    return agg.distinct_messages(T.load_logs(spark, sf), k=5, newest_first=True, by_service=False)


@query("error_rate_corr")
def q_error_rate_corr(spark, sf):
    return agg.error_rate_corr(T.load_logs(spark, sf))


# ---- 2.7 causal and statistical -----------------------------------------
from kestrel.fixed import METRICS  # noqa: E402
from kestrel.fixed import SERVICES  # noqa: E402
from kestrel.operators import causal, discovery  # noqa: E402


def _by_week(df):
    """Rows by week of January 2024, the first and the last week open, so that none is left out."""
    weeks = [T.ts_ntz(f"2024-01-{d} 00:00:00") for d in ("08", "15", "22")]
    t = F.col("timestamp")
    return [df.where(t.isNull() | (t < weeks[0])), df.where((t >= weeks[0]) & (t < weeks[1])),
            df.where((t >= weeks[1]) & (t < weeks[2])), df.where(t >= weeks[2])]


def _clean_logs(spark, sf):
    return clean.drop_incomplete(T.load_logs(spark, sf))


@query("corr_matrix")
def q_corr_matrix(spark, sf):
    return causal.corr_matrix(_clean_logs(spark, sf))


@query("gram")
def q_gram(spark, sf):
    g = causal.gram(_clean_logs(spark, sf), METRICS, ["service"])
    return g.select("service", "n", *[F.round(c, 4).alias(c) for c in g.columns if c not in ("service", "n")])


@query("ate_linear")
def q_ate_linear(spark, sf):
    return causal.ate_linear(_clean_logs(spark, sf))


@query("ate_hetero")
def q_ate_hetero(spark, sf):
    return causal.ate_hetero(_clean_logs(spark, sf))


@query("ate_incremental")
def q_ate_incremental(spark, sf):
    """The effect from increments of sufficient statistics: one per week, the first and last open."""
    logs, path = _clean_logs(spark, sf), scratch_path(spark, "gram")
    cols = [causal.TREATMENT, causal.CONFOUNDER, causal.OUTCOME]
    for i, week in enumerate(_by_week(logs)):
        causal.gram_append(week, path, i, cols)
    return causal.ate_from_gram(causal.gram_state(spark, path, cols))


@query("pc_wide")
def q_pc_wide(spark, sf):
    """Discovery over 50 variables: mean and maximum of five metrics of five services by the hour."""
    wide, names = discovery.panel(T.load_logs(spark, sf), SERVICES, ["latency_ms", "db_lock_time", "pool_wait_ms", "cpu_percent", "memory_percent"])
    return discovery.discover(wide, names)


@query("placebo_refute")
def q_placebo(spark, sf):
    return causal.placebo_refute(_clean_logs(spark, sf), simulations=20)


@query("placebo_summary")
def q_placebo_summary(spark, sf):
    logs = _clean_logs(spark, sf)
    return causal.placebo_summary(causal.placebo_refute(logs, simulations=20), causal.ate_linear(logs))


@query("pc_tests")
def q_pc_tests(spark, sf):
    return causal.pc_tests(_clean_logs(spark, sf))


@query("pc_skeleton")
def q_pc_skeleton(spark, sf):
    return causal.pc_skeleton(causal.pc_tests(_clean_logs(spark, sf)))


@query("graph_metrics")
def q_graph_metrics(spark, sf):
    tests = causal.pc_tests(_clean_logs(spark, sf)).where(F.col("service") == "ALL")
    truth = causal.true_skeleton(spark)
    pc = causal.pc_skeleton(tests).where("adjacent").select("x", "y")
    pearson = tests.where((F.col("order") == 0) & ~F.col("independent")).select("x", "y")
    return causal.graph_metrics(pc, truth, method="pc").unionByName(
        causal.graph_metrics(pearson, truth, method="pearson"))


@query("effect_scan")
def q_effect_scan(spark, sf):
    return causal.effect_scan(_clean_logs(spark, sf))


# ---- 2.5 windows and time series ----------------------------------------
from kestrel.operators import timeseries as ts  # noqa: E402

BURST_FIXTURE_MINUTES = 60  # 5 minutes never fires per service below sf0.1 (SURVEY T3)


@query("error_burst")
def q_error_burst(spark, sf):
    return ts.error_burst(T.load_logs(spark, sf), minutes=BURST_FIXTURE_MINUTES)


@query("error_burst_global")
def q_error_burst_global(spark, sf):
    return ts.error_burst(T.load_logs(spark, sf), minutes=5, per_service=False)


def _with_nulls(logs, **every):
    """Times cut to the minute (ties), and every n-th value of the named columns NULL."""
    logs = logs.withColumn("timestamp", F.date_trunc("minute", "timestamp").cast("timestamp_ntz"))
    return logs.withColumns({c: F.when(F.col("event_id") % n != 0, F.col(c)) for c, n in every.items()})


@query("error_burst_nulls")
def q_error_burst_nulls(spark, sf):
    return ts.error_burst(_with_nulls(T.load_logs(spark, sf), service=11, timestamp=13), minutes=BURST_FIXTURE_MINUTES)


@query("cooldown_nulls")
def q_cooldown_nulls(spark, sf):
    return ts.cooldown(q_error_burst_nulls(spark, sf).where("anomaly"), seconds=1800)


@query("topology_edges_nulls")
def q_topology_edges_nulls(spark, sf):
    logs = _with_nulls(T.load_logs(spark, sf).withColumn("user_id", F.col("user_id") % 3), service=11, timestamp=13, user_id=17)
    return graph.topology_edges(T.edges_from_logs(logs))


@query("burst_sliding")
def q_burst_sliding(spark, sf):
    return ts.burst_sliding(T.load_logs(spark, sf))


def _burst_candidates(spark, sf):
    return q_error_burst(spark, sf).where("anomaly")


@query("cooldown")
def q_cooldown(spark, sf):
    return ts.cooldown(_burst_candidates(spark, sf), seconds=30)


@query("cooldown_30m")
def q_cooldown_30m(spark, sf):
    return ts.cooldown(_burst_candidates(spark, sf), seconds=1800)


def _fit_public(fit, keys):
    return fit.select(*keys, "n", "first_ts", "last_ts", F.round("coef0", 6).alias("coef0"),
                      F.round("coef1_per_day", 6).alias("coef1_per_day"),
                      F.round("coef2_per_day2", 6).alias("coef2_per_day2"))


@query("forecast_fit")
def q_forecast_fit(spark, sf):
    return _fit_public(ts.forecast_fit(T.load_logs(spark, sf), ["service"]), ["service"])


@query("forecast_global")
def q_forecast_global(spark, sf):
    return _fit_public(ts.forecast_fit(T.load_logs(spark, sf)), ["series"])


@query("forecast_horizon")
def q_forecast_horizon(spark, sf):
    h = ts.forecast_horizon(ts.forecast_fit(T.load_logs(spark, sf), ["service"]), ["service"])
    return h.select("service", "step", "ts", F.round("predicted", 4).alias("predicted"))


@query("slo_breach")
def q_slo_breach(spark, sf):
    h = ts.forecast_horizon(ts.forecast_fit(T.load_logs(spark, sf), ["service"]), ["service"])
    return ts.slo_breach(h, ["service"])


@query("forecast_linear")
def q_forecast_linear(spark, sf):
    f = ts.forecast_linear(T.load_logs(spark, sf), ["service"])
    return f.select("service", "n", F.round("slope_per_day", 6).alias("slope_per_day"),
                    F.round("intercept", 6).alias("intercept"))


@query("lag_panel")
def q_lag_panel(spark, sf):
    logs = T.load_logs(spark, sf)
    return ts.lag_panel(logs, _edges(spark, sf), "payment-db")


@query("lag_panel_lookback")
def q_lag_panel_lookback(spark, sf):
    """The last day in 10-minute buckets."""
    logs = T.load_logs(spark, sf)
    return ts.lag_panel(logs, _edges(spark, sf), "payment-db", bucket_seconds=600, lookback_seconds=86_400)


@query("pc_oriented")
def q_pc_oriented(spark, sf):
    return causal.pc_oriented(_clean_logs(spark, sf))


@query("pc_neighbourhood")
def q_pc_neighbourhood(spark, sf):
    """Discovery among the services within two hops of the failing one (names of services reach the driver)."""
    near = graph.k_hop(_edges(spark, sf), "payment-db", 2)
    names = [r["service"] for r in near.collect()]
    return causal.pc_neighbourhood(T.load_logs(spark, sf), names, "payment-db")


@query("status_timeline")
def q_status_timeline(spark, sf):
    return ts.status_timeline(T.load_logs(spark, sf))


# ---- 2.6 temporal service graph -------------------------------------------
from kestrel.operators import graph  # noqa: E402
from kestrel.session import materialize, scratch_path  # noqa: E402

GRAPH_WINDOW_S = 86400.0        # neighbour window for the fixture (1 day)
PRUNE_AGE_S = 7 * 86400.0       # keep one week in the prune fixture
TTL_S = 3600.0


def _edges(spark, sf):
    return T.load_edges(spark, sf)


@query("edges_view")
def q_edges_view(spark, sf):
    """The derivation itself: the ordered lag over all logs."""
    return T.edges_from_logs(T.load_logs(spark, sf))


@query("edge_append")
def q_edge_append(spark, sf):
    e = _edges(spark, sf)
    path = scratch_path(spark, "edges")
    cut = T.ts_ntz("2024-01-15 00:00:00")
    graph.edge_append(spark, path, e.where(F.col("ts") < cut))
    return graph.edge_append(spark, path, e.where(F.col("ts") >= cut))


@query("topology_edges")
def q_topology_edges(spark, sf):
    return graph.topology_edges(_edges(spark, sf))


@query("topology_nodes")
def q_topology_nodes(spark, sf):
    return graph.topology_nodes(_edges(spark, sf))


@query("node_state")
def q_node_state(spark, sf):
    return graph.node_state(_edges(spark, sf))


@query("causal_neighbors")
def q_causal_neighbors(spark, sf):
    return graph.causal_neighbors(_edges(spark, sf), "payment-db", NOW(), GRAPH_WINDOW_S)


@query("neighbor_summary")
def q_neighbor_summary(spark, sf):
    return graph.neighbor_summary(graph.causal_neighbors(_edges(spark, sf), "payment-db", NOW(), GRAPH_WINDOW_S))


@query("prune_edges")
def q_prune_edges(spark, sf):
    return graph.prune_edges(_edges(spark, sf), NOW(), PRUNE_AGE_S)


@query("ttl_view")
def q_ttl_view(spark, sf):
    return graph.ttl_view(_edges(spark, sf), NOW(), TTL_S)


@query("edge_last100")
def q_edge_last100(spark, sf):
    return graph.edge_last_n(_edges(spark, sf), 100)


@query("global_last5000")
def q_global_last5000(spark, sf):
    return graph.global_last_n(_edges(spark, sf), 5000)


@query("k_hop")
def q_k_hop(spark, sf):
    return graph.k_hop(_edges(spark, sf), "payment-db", 2)


@query("reachability")
def q_reachability(spark, sf):
    return graph.reachability(_edges(spark, sf))


@query("dag_confounders")
def q_dag_confounders(spark, sf):
    """Confounders of the causal graph's treatment and outcome; edges that the logs' metrics can show are kept."""
    from kestrel.fixed import CAUSAL_EDGES, OUTCOME, TREATMENT
    seen = T.load_logs(spark, sf).agg(*[F.count(c).alias(c) for c in METRICS])
    names = seen.select(F.explode(F.array(*[F.when(F.col(c) > 0, F.lit(c)) for c in METRICS])).alias("cause"))
    dag = spark.createDataFrame(CAUSAL_EDGES, "cause string, effect string").join(names, "cause")
    return graph.dag_confounders(dag, TREATMENT, OUTCOME)


@query("edge_obs_match")
def q_edge_obs_match(spark, sf):
    e = _edges(spark, sf)
    return graph.edge_obs_match(e, e)


# ---- 2.4 similarity, context, scenarios; 2.8 rules ------------------------
from kestrel.operators import rules  # noqa: E402
from kestrel.operators import ann, encoding, textsearch  # noqa: E402
from kestrel.operators import similarity as sim  # noqa: E402


@query("knn_filtered")
def q_knn_filtered(spark, sf):
    corpus = T.load_embeddings(spark, sf)
    return sim.knn(corpus, sim.latest_overall(corpus), n=5)


@query("knn_batch")
def q_knn_batch(spark, sf):
    corpus = T.load_embeddings(spark, sf)
    return sim.knn(corpus, sim.latest_per_label(corpus), n=3)


def _every_fiftieth(corpus):
    return corpus.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"),
                                                  F.col("label").alias("query_filter"))


@query("knn_blocks")
def q_knn_blocks(spark, sf):
    corpus = T.load_embeddings(spark, sf)
    return sim.knn_blocks(corpus, _every_fiftieth(corpus), n=10)


@query("knn_ivf")
def q_knn_ivf(spark, sf):
    corpus = T.load_embeddings(spark, sf)
    return ann.knn_ivf(corpus, _every_fiftieth(corpus), n=10)


@query("knn_lsh")
def q_knn_lsh(spark, sf):
    corpus = T.load_embeddings(spark, sf)
    return sim.knn_lsh(corpus, sim.latest_per_label(corpus), n=3)


@query("similar_texts")
def q_similar_texts(spark, sf):
    docs = T.read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("fkey"), "text",
                                                       F.col("doc_id").alias("newest"))
    queries = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), "fkey", "text")
    return textsearch.similar_texts(docs, queries, 5).select(
        F.col("query_id").alias("doc_id"), "rank", F.col("id").alias("similar_id"), "score")


@query("encode_messages")
def q_encode_messages(spark, sf):
    """Every distinct message by the encoder plug-in, as the places and values of its vector."""
    messages = T.load_logs(spark, sf).select("message").distinct()
    encoded = encoding.encode_texts(messages, lambda: encoding.HashedWords(384), 384, "hashed-words-384", "message")
    return encoded.select("message", F.posexplode("embedding").alias("slot", "weight")).where("weight <> 0").select(
        "message", "slot", F.round(F.col("weight").cast("double"), 5).alias("weight"))


@query("text_embed")
def q_text_embed(spark, sf):
    return sim.text_embed(T.read_table(spark, sf, "documents"))


def _context(spark, sf):
    logs = T.load_logs(spark, sf)
    before = NOW() - F.expr(f"INTERVAL {RECENT_MINUTES} MINUTES")
    index = T.stored_once(spark, sf, "incidents", lambda: sim.incident_index(logs, before))
    return sim.incident_context(logs, NOW(), RECENT_MINUTES, causal.ate_linear(clean.drop_incomplete(logs)), index=index)


@query("incident_context")
def q_incident_context(spark, sf):
    return _context(spark, sf).withColumn("similar", F.array_join("similar", " | "))


@query("scenario_match")
def q_scenario_match(spark, sf):
    return sim.scenario_match(T.load_logs(spark, sf), sim.rules_frame(spark))


def _parsed(spark, sf, mixed=False):
    logs = T.load_logs(spark, sf)
    d = T.diagnoses_mixed(logs) if mixed else T.diagnoses_from_logs(logs)
    return rules.diagnosis_parse(d)


@query("scenario_eval")
def q_scenario_eval(spark, sf):
    logs = T.load_logs(spark, sf)
    return sim.scenario_eval(sim.scenario_match(logs, sim.rules_frame(spark)),
                             rules.diagnosis_parse(T.diagnoses_from_logs(logs)))


@query("guardrail_audit")
def q_guardrail_audit(spark, sf):
    a = rules.guardrail_audit(T.load_commands(spark, sf))
    return a.withColumn("issues", F.array_join("issues", ";"))


@query("guardrail_summary")
def q_guardrail_summary(spark, sf):
    return rules.guardrail_summary(rules.guardrail_audit(T.load_commands(spark, sf)))


@query("causal_chain")
def q_causal_chain(spark, sf):
    logs = T.load_logs(spark, sf)
    ate = causal.ate_linear(clean.drop_incomplete(logs)).select("ate").scalar()
    return logs.select("service").distinct().select(
        "service", rules.causal_chain(F.col("service"), ate).alias("causal_chain"))


@query("diagnosis_parse")
def q_diagnosis_parse(spark, sf):
    return _parsed(spark, sf, mixed=True)


@query("action_gate")
def q_action_gate(spark, sf):
    return rules.action_gate(_parsed(spark, sf))


@query("action_validate")
def q_action_validate(spark, sf):
    return rules.validation_summary(rules.action_validate(_parsed(spark, sf)))


@query("prompt_render")
def q_prompt_render(spark, sf):
    return rules.prompt_render(_context(spark, sf))


@query("system_status")
def q_system_status(spark, sf):
    return agg.system_status(T.load_logs(spark, sf), rules.action_gate(_parsed(spark, sf)))


@query("top_k_history")
def q_top_k_history(spark, sf):
    return agg.top_k_history(rules.action_gate(_parsed(spark, sf)), 20)


@query("top_k_history_per_target")
def q_top_k_history_per_target(spark, sf):
    return agg.top_k_history(rules.action_gate(_parsed(spark, sf)), 20, per="target")


# ---- 2.1 sources and sinks --------------------------------
from kestrel.sources import files  # noqa: E402

STORE_COLS = ["event_id", "timestamp", "service", "level", "message", "latency_ms", "db_lock_time",
              "pool_wait_ms", "error_count"]


def _written_csv(spark, sf):
    path = scratch_path(spark, "logs_csv")
    files.write_logs_csv(T.load_logs(spark, sf).select(*STORE_COLS), path)
    return files.read_logs_csv(spark, path)


@query("src_logs_csv")
def q_src_logs_csv(spark, sf):
    return _written_csv(spark, sf)


@query("sink_logs_csv")
def q_sink_logs_csv(spark, sf):
    back = _written_csv(spark, sf)
    return back.groupBy("service", "level").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("latency_ms"), 4).alias("latency_sum"))


def submissions_text(logs):
    """Log submissions as JSON lines: times with and without fraction and
    offset, level omitted on every 7th, latency on every 31st, message on every
    37th, a bad timestamp on every 29th, and every 13th line cut short (malformed)."""
    ts, n = F.col("timestamp"), F.col("event_id")
    body = F.to_json(F.struct(
        F.when((n % 41 != 0) | (n % 13 == 0), n).alias("request_id"),
        F.when(n % 29 == 0, F.lit("yesterday"))
         .when(n % 5 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
         .when(n % 5 == 1, F.concat(files.iso_text(ts), F.lit("Z")))
         .when(n % 5 == 2, F.concat(files.iso_text(ts + F.expr("INTERVAL 2 HOURS")), F.lit("+02:00")))
         .when(n % 5 == 3, F.date_format(ts, "yyyyMMdd'T'HHmmss,S"))
         .when(n % 5 == 4, F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"),
                                    F.lit("-"), (F.weekday(ts) + 1).cast("string"), F.date_format(ts, "'T'HH:mm:ss.SSSSSS")))
         .otherwise(files.iso_text(ts)).alias("timestamp"),
        "service",
        F.when(n % 7 != 0, F.col("level")).alias("level"),
        F.when(n % 31 != 0, F.col("latency_ms")).alias("latency"),
        F.when(n % 37 != 0, F.col("message")).alias("message")))
    return logs.select(F.when(F.col("event_id") % 13 == 0, F.substring(body, 1, 20)).otherwise(body).alias("value"))


def _submissions(spark, sf):
    path = scratch_path(spark, "submissions")
    submissions_text(T.load_logs(spark, sf)).write.text(path)
    return files.split_submissions(files.read_submissions(spark, path))


@query("src_submissions")
def q_src_submissions(spark, sf):
    return _submissions(spark, sf)[0]


@query("submissions_quarantine")
def q_submissions_quarantine(spark, sf):
    return _submissions(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def _store(spark, sf):
    logs = T.load_logs(spark, sf).select(*STORE_COLS)
    path = scratch_path(spark, "log_store")
    files.log_store_append(spark, path, logs.where(F.col("timestamp") < T.ts_ntz("2024-01-20 00:00:00")), False)
    files.log_store_append(spark, path, logs.where(F.col("timestamp") >= T.ts_ntz("2024-01-15 00:00:00")), True)
    return path


@query("log_store_append")
def q_log_store_append(spark, sf):
    return files.log_store_scan(spark, _store(spark, sf))


@query("log_store_untimed")
def q_log_store_untimed(spark, sf):
    """Every 43rd log has no time, every 47th no id; what two overlapping appends leave."""
    n = F.col("event_id")
    logs = T.load_logs(spark, sf).select(*STORE_COLS).where((n % 43 == 0) | (n % 47 == 0))
    logs = logs.withColumns({"timestamp": F.when(n % 43 != 0, F.col("timestamp")), "event_id": F.when(n % 47 != 0, n)})
    path = scratch_path(spark, "log_store_untimed")
    files.log_store_append(spark, path, logs.where(F.col("latency_ms") < 60), False, bulk=True)
    return files.log_store_append(spark, path, logs, True, bulk=True).select(*[c for c in files.LOG_STORE_COLUMNS if c != "id"])


@query("log_store_append_bulk")
def q_log_store_append_bulk(spark, sf):
    logs = T.load_logs(spark, sf).select(*STORE_COLS)
    path = scratch_path(spark, "log_store_bulk")
    files.log_store_append(spark, path, logs.where(F.col("timestamp") < T.ts_ntz("2024-01-20 00:00:00")), False, bulk=True)
    later = logs.where(F.col("timestamp") >= T.ts_ntz("2024-01-15 00:00:00"))
    return files.log_store_append(spark, path, later, True, bulk=True).select(*files.LOG_STORE_COLUMNS)


@query("log_store_wipe")
def q_log_store_wipe(spark, sf):
    wiped = files.log_store_retention(spark, _store(spark, sf), scratch_path(spark, "log_store_wiped"),
                                      T.ts_ntz("2100-01-01 00:00:00"))
    return wiped.select(*files.LOG_STORE_COLUMNS)


@query("log_store_scan")
def q_log_store_scan(spark, sf):
    return files.log_store_scan(spark, _store(spark, sf),
                                ["id", "service", "timestamp", "level", "latency_ms", "error_count"],
                                F.col("error_count") >= 1)


@query("log_store_retention")
def q_log_store_retention(spark, sf):
    path = _store(spark, sf)
    keep_after = NOW() - F.expr("INTERVAL 7 DAYS")
    return files.log_store_retention(spark, path, scratch_path(spark, "log_store_kept"), keep_after) \
                .select(*files.LOG_STORE_COLUMNS)


def _feedback_written(spark, sf):
    parsed = rules.diagnosis_parse(T.diagnoses_from_logs(T.load_logs(spark, sf), ["k"]))
    fb = T.feedback_from_diagnoses(parsed.select("event_id", "timestamp", "k", *files.ANALYSIS_FIELDS))
    path = scratch_path(spark, "feedback")
    files.feedback_append(fb.where(F.col("rating") == "positive"), path)
    files.feedback_append(fb.where(F.col("rating") == "negative"), path)
    return files.read_feedback(spark, path)


@query("feedback_append")
def q_feedback_append(spark, sf):
    return _feedback_written(spark, sf).select(
        "timestamp", "rating", "event_id", *[F.col(f"analysis.{f}").alias(f) for f in files.ANALYSIS_FIELDS])


@query("feedback_gold")
def q_feedback_gold(spark, sf):
    return files.feedback_gold(_feedback_written(spark, sf))


@query("feedback_counts")
def q_feedback_counts(spark, sf):
    return files.feedback_counts(_feedback_written(spark, sf))


# ---- 2.9 streaming (each runs to completion with availableNow) ---------------
from kestrel.streaming import pipeline as stream  # noqa: E402
from kestrel.streaming import stateful  # noqa: E402


def _run_to_table(spark, df, name, mode="append"):
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "_ckpt")
    q = stream.write_parquet(df, out, ck, mode)
    q.awaitTermination()
    return spark.read.parquet(out)


def _run_to_the_end(spark, build, ends, name):
    """The stream of ``build`` run to a table twice: each of ``ends`` appends rows far ahead, so that the second run's
    watermark passes whatever the first one held."""
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "_ckpt")
    for end in ends:
        end()
        stream.write_parquet(build(), out, ck).awaitTermination()
    return spark.read.parquet(out)


def _events_stream(spark, sf):
    schema = T.read_table(spark, sf, "events").schema
    return stream.read_table_stream(spark, sf, schema, glob="events.parquet")


@query("stream_burst")
def q_stream_burst(spark, sf):
    logs = T.logs_from_events(_events_stream(spark, sf)).select("timestamp", "error_count")
    # The end of a finished input: one event far ahead closes the windows that are open there.
    end = scratch_path(spark, "end_of_events")
    (T.load_logs(spark, sf).agg((F.max("timestamp") + F.expr("INTERVAL 1 DAY")).alias("timestamp"))
     .withColumn("error_count", F.lit(0)).write.parquet(end))
    end = stream.read_table_stream(spark, end, "timestamp timestamp_ntz, error_count int")
    return _run_to_table(spark, stream.burst_stream(logs.unionByName(end)), "stream_burst")


def _firings(spark, sf):
    """Folder of the firings of a stream of burst candidates."""
    cand_path = scratch_path(spark, "burst_candidates")
    cands = materialize(q_error_burst(spark, sf).where("anomaly").select("service", "event_id", "timestamp"), "candidates")
    # Arrival in event-time order: four appends, one per week, oldest first.
    out, ck = scratch_path(spark, "stream_cooldown"), scratch_path(spark, "stream_cooldown_ckpt")
    for part in _by_week(cands):
        part.write.mode("append").parquet(cand_path)
        arrived = stream.read_table_stream(spark, cand_path, cands.schema)
        stream.cooldown_to_table(arrived, out, ck, seconds=30).awaitTermination()
    return out


@query("stream_cooldown")
def q_stream_cooldown(spark, sf):
    return spark.read.schema(stream.COOLDOWN_OUT + ", epoch long").parquet(_firings(spark, sf)).drop("epoch")


@query("stream_history")
def q_stream_history(spark, sf):
    """Fire, gate, act: the newest 20 actions of the diagnoses of what fired."""
    fired = stream.read_table_stream(spark, _firings(spark, sf), stream.COOLDOWN_OUT + ", epoch long")
    diagnoses = T.diagnoses_from_logs(T.load_logs(spark, sf))
    actions = stream.incident_actions(fired, diagnoses)
    out, ck = scratch_path(spark, "incident_actions"), scratch_path(spark, "incident_actions_ckpt")
    stream.write_idempotent(actions, out, ck).awaitTermination()
    done = spark.read.schema(actions.schema.add("epoch", "long")).parquet(out).drop("epoch")
    return agg.top_k_history(done, 20)


def _ingested(spark, sf):
    """Submissions in three appends, every 10th sent again with the last; the ingest run after each."""
    src, base = scratch_path(spark, "submissions_stream"), scratch_path(spark, "ingest")
    logs = T.load_logs(spark, sf)
    third = F.pmod(F.col("event_id"), F.lit(3))
    for k in range(3):
        sent = submissions_text(logs.where((third == k) | ((F.col("event_id") % 10 == 0) if k == 2 else F.lit(False))))
        sent.write.mode("append").text(src)
        stream.ingest_to_tables(stream.submissions_stream(spark, src), base).awaitTermination()
    return base


@query("stream_ingest")
def q_stream_ingest(spark, sf):
    return stream.ingested(spark, _ingested(spark, sf)).drop("id", "dt")


@query("stream_quarantine")
def q_stream_quarantine(spark, sf):
    bad = stream.quarantined(spark, _ingested(spark, sf))
    # What was sent twice was refused twice: the last append repeats every 10th.
    return bad.groupBy("reason").agg(F.countDistinct("line").alias("rows"))


@query("stream_metrics")
def q_stream_metrics(spark, sf):
    """Counters of the ingest, summed over its micro-batches."""
    return stream.ingest_metrics(spark, _ingested(spark, sf))


@query("stream_actions")
def q_stream_actions(spark, sf):
    src = scratch_path(spark, "diagnoses_stream")
    T.diagnoses_from_logs(T.load_logs(spark, sf)).write.parquet(src)
    d = stream.read_table_stream(spark, src, spark.read.parquet(src).schema)
    out, ck = scratch_path(spark, "actions"), scratch_path(spark, "actions_ckpt")
    stream.write_idempotent(stream.actions_stream(d), out, ck).awaitTermination()
    return spark.read.parquet(out).drop("epoch")


@query("stream_node_state")
def q_stream_node_state(spark, sf):
    """Update mode over four arrivals, oldest first: each epoch writes the nodes that it changed."""
    edges, src = T.load_edges(spark, sf), scratch_path(spark, "edges_stream")
    base, ck = scratch_path(spark, "node_state"), scratch_path(spark, "node_state_ckpt")
    seq = edges.agg(F.max("seq")).scalar()
    for i in range(4):
        edges.where(F.least(F.floor(F.col("seq") * 4 / (seq + 1)), F.lit(3)) == i).write.mode("append").parquet(src)
        stream.node_state_to_table(stream.read_table_stream(spark, src, edges.schema), base, ck, compact_every=2).awaitTermination()
    return stream.node_state(spark, base).drop("seq")


@query("stream_cooldown_timers")
def q_stream_cooldown_timers(spark, sf):
    """The candidates arrive out of order by up to five minutes, in one stream; timers fire behind the watermark."""
    cands = materialize(q_error_burst(spark, sf).where("anomaly").select("service", "event_id", "timestamp"), "candidates")
    src = scratch_path(spark, "candidates_stream")
    late = F.expr("timestamp + make_dt_interval(0, 0, CAST(event_id % 6 AS INT))")
    for part in _by_week(cands.withColumn("arrival", late)):
        part.select(*cands.columns).repartition(2).write.mode("append").parquet(src)
    # The end of a finished input: candidates of no service far ahead let the watermark pass all others.
    def end(days):
        cands.agg(F.lit("end of input").alias("service"), F.lit(-1).cast("long").alias("event_id"),
                  (F.max("timestamp") + F.expr(f"INTERVAL {days} DAYS")).alias("timestamp")).write.mode("append").parquet(src)
    stateful.use_rocksdb(spark)
    out = _run_to_the_end(spark, lambda: stateful.cooldown_with_timers(
        stream.read_table_stream(spark, src, cands.schema), seconds=30, watermark="31 days"),
        [lambda: end(70), lambda: end(140)], "stream_cooldown_timers")
    return out.where("event_id >= 0").select("service", F.col("fired_at").cast("timestamp_ntz").alias("fired_at"), "event_id")


@query("stream_diagnosed")
def q_stream_diagnosed(spark, sf):
    """Firings with the diagnoses that arrive for them: up to 14 minutes after the event, those after ten too late."""
    fired = q_cooldown(spark, sf)
    logs = T.load_logs(spark, sf)
    diagnoses = T.diagnoses_from_logs(logs).where(F.col("event_id") % 7 != 0).select(
        "event_id", F.expr("timestamp + make_dt_interval(0, 0, CAST(event_id % 17 AS INT) - 2)").alias("diagnosed_at"), "raw")
    sides = [(materialize(fired, "fired"), "fired_at", scratch_path(spark, "fired_stream")),
             (materialize(diagnoses, "found"), "diagnosed_at", scratch_path(spark, "diagnosed_stream"))]
    for rows, _, path in sides:
        rows.write.parquet(path)

    def end(days):        # of a finished input: a row far ahead on either side
        for rows, t, path in sides:
            far = F.max(t) + F.expr(f"INTERVAL {days} DAYS")
            fill = {t: far, "event_id": F.lit(-1 if t == "fired_at" else -2).cast("long")}        # ids, so that the join drops none
            rows.agg(*[fill.get(c, F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns]).write.mode("append").parquet(path)

    def joined():
        return stateful.diagnosed_firings(*[stream.read_table_stream(spark, path, rows.schema) for rows, _, path in sides],
                                          watermark="31 days")
    out = _run_to_the_end(spark, joined, [lambda: end(70), lambda: end(140)], "diagnosed")
    done = rules.diagnosis_parse(out.where("event_id >= 0"))        # a filter on the stream would hide the end from the watermark
    return done.select("event_id", "service", "fired_at", "diagnosed_at", "paged",
                       F.when(F.col("paged"), F.lit("page_human")).otherwise(F.col("recommended_action")).alias("action"))


@query("stream_counters")
def q_stream_counters(spark, sf):
    """The ingest's counters as a listener heard them while it ran."""
    src, base = scratch_path(spark, "submissions_counted"), scratch_path(spark, "ingest_counted")
    submissions_text(T.load_logs(spark, sf)).write.text(src)
    counters = stateful.LiveCounters()
    spark.streams.addListener(counters)
    try:
        raw = stateful.observed(stream.submissions_stream(spark, src))
        stream.ingest_to_tables(raw, base).awaitTermination()
        counters.wait()
    finally:
        spark.streams.removeListener(counters)
    t = counters.totals()
    return spark.createDataFrame([(t.get("submitted", 0), t.get("refused", 0), t.get("errors", 0))], "submitted long, refused long, errors long")
