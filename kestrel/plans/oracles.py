"""DuckDB twins of the registered queries (SQL over the driver's tables)."""

from __future__ import annotations

from kestrel.plans.oracle_views import with_views

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
LOG_COLS = ('event_id, "timestamp", service, level, message, latency_ms, db_lock_time, '
            'pool_wait_ms, error_count')

RAW_TELEMETRY = """
raw AS (
  SELECT event_id,
         CASE WHEN event_id % 11 = 0 THEN 'n/a' ELSE CAST(latency_ms AS VARCHAR) END AS latency_ms,
         CASE WHEN event_id % 13 = 0 THEN '' ELSE CAST(db_lock_time AS VARCHAR) END AS db_lock_time,
         CASE WHEN event_id % 19 = 0 THEN 'NaN' ELSE CAST(pool_wait_ms AS VARCHAR) END AS pool_wait_ms,
         CAST(error_count AS VARCHAR) AS error_count
  FROM logs),
norm AS (
  SELECT event_id,
         CASE WHEN isnan(TRY_CAST(latency_ms AS DOUBLE)) THEN NULL ELSE TRY_CAST(latency_ms AS DOUBLE) END AS latency_ms,
         CASE WHEN isnan(TRY_CAST(db_lock_time AS DOUBLE)) THEN NULL ELSE TRY_CAST(db_lock_time AS DOUBLE) END AS db_lock_time,
         CASE WHEN isnan(TRY_CAST(pool_wait_ms AS DOUBLE)) THEN NULL ELSE TRY_CAST(pool_wait_ms AS DOUBLE) END AS pool_wait_ms,
         CASE WHEN isnan(TRY_CAST(error_count AS DOUBLE)) THEN NULL ELSE TRY_CAST(error_count AS DOUBLE) END AS error_count
  FROM raw)"""

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = with_views(sql)


# ---- 2.2 ------------------------------------------------------------------
oracle("normalise_telemetry", f"WITH {RAW_TELEMETRY} SELECT * FROM norm")
oracle("drop_incomplete", f"""WITH {RAW_TELEMETRY} SELECT * FROM norm
  WHERE latency_ms IS NOT NULL AND db_lock_time IS NOT NULL AND pool_wait_ms IS NOT NULL
    AND error_count IS NOT NULL""")
oracle("error_flag", "SELECT event_id, level, CAST(CASE WHEN level = 'ERROR' THEN 1 ELSE 0 END AS INTEGER) AS error_count FROM logs")
oracle("derive_level", """SELECT event_id, CASE WHEN error_count >= 1 THEN 'ERROR' WHEN latency_ms > 100
  THEN 'WARN' ELSE 'INFO' END AS level FROM logs""")
oracle("recent_errors", f"""SELECT {LOG_COLS} FROM logs
  WHERE error_count >= 1 AND "timestamp" > {NOW} - INTERVAL 1440 MINUTE""")
oracle("recent_errors_latest", f"""SELECT {LOG_COLS} FROM logs
  WHERE error_count >= 1 AND "timestamp" > (SELECT max("timestamp") FROM logs) - INTERVAL 1440 MINUTE""")
oracle("filter_service", f"SELECT {LOG_COLS} FROM logs WHERE service = 'payment-db'")
oracle("recent_logs", f"SELECT {LOG_COLS} FROM logs ORDER BY \"timestamp\" DESC, event_id DESC LIMIT 20")
oracle("log_cards", """SELECT event_id, service, substr(strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f'), 1, 16) AS time_label,
  substr(message, 1, 50) AS message_label FROM logs WHERE error_count >= 1""")
oracle("latest_error", f"""SELECT {LOG_COLS} FROM logs WHERE error_count >= 1
  ORDER BY "timestamp" DESC, event_id DESC LIMIT 1""")

# ---- 2.3 ------------------------------------------------------------------
oracle("service_rank", """SELECT service, errors, CAST(row_number() OVER (ORDER BY errors DESC, service) AS INTEGER) AS rank
  FROM (SELECT service, count(*) AS errors FROM logs WHERE error_count >= 1 GROUP BY service)""")
oracle("incident_stats", """SELECT coalesce(service, 'ALL') AS service, round(avg(latency_ms), 6) AS avg_latency,
  count(*) AS error_total, count(*) / CAST(100 AS DOUBLE) AS error_rate_norm
  FROM logs WHERE error_count >= 1 GROUP BY ROLLUP (service)""")
oracle("distinct_messages", """SELECT service, position, message, seen_at FROM (
  SELECT service, message, "timestamp" AS seen_at,
         CAST(row_number() OVER (PARTITION BY service ORDER BY "timestamp", event_id, message) AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY service, message ORDER BY "timestamp", event_id) AS rn FROM logs)
  WHERE rn = 1) WHERE position <= 3""")
oracle("distinct_messages_newest", """SELECT position, message, seen_at FROM (
  SELECT message, "timestamp" AS seen_at,
         CAST(row_number() OVER (ORDER BY "timestamp" DESC, event_id DESC, message) AS INTEGER) AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY message ORDER BY "timestamp" DESC, event_id DESC) AS rn FROM logs)
  WHERE rn = 1) WHERE position <= 5""")
oracle("error_rate_corr", """SELECT round(avg(error_count), 8) AS error_rate,
  round(corr(db_lock_time, CAST(error_count AS DOUBLE)), 8) AS corr_lock_error FROM logs""")


# ---- 2.7 causal ------------------------------------------------------------
import itertools  # noqa: E402

from kestrel.fixed import CAUSAL_EDGES, METRICS  # noqa: E402

CLEAN = """clean AS (SELECT service, event_id, db_lock_time, pool_wait_ms, latency_ms,
  CAST(error_count AS DOUBLE) AS error_count FROM logs
  WHERE db_lock_time IS NOT NULL AND pool_wait_ms IS NOT NULL AND latency_ms IS NOT NULL AND error_count IS NOT NULL)"""


def _s(a, b):
    i, j = METRICS.index(a), METRICS.index(b)
    return f"S__{a}__{b}" if i <= j else f"S__{b}__{a}"


def _gram_select(cols, src="clean", by="service", extra_by=""):
    parts = [f"{by}", f"{extra_by}" if extra_by else None, "count(*) AS n"]
    parts += [f"avg({c}) AS mean__{c}" for c in cols]
    for a, b in itertools.combinations_with_replacement(cols, 2):
        parts.append(f"covar_pop({a}, {b}) * count(*) AS S__{a}__{b}")
    keys = ", ".join(x for x in [by, extra_by] if x)
    return f"SELECT {', '.join(p for p in parts if p)} FROM {src} GROUP BY {keys}"


def _pval(t):
    x = f"abs({t})"
    tt = f"(1.0 / (1.0 + 0.2316419 * {x}))"
    poly = (f"{tt} * (0.319381530 + {tt} * (-0.356563782 + {tt} * (1.781477937 + {tt} * "
            f"(-1.821255978 + {tt} * 1.330274429))))")
    return f"(2.0 * exp(-{x} * {x} / 2.0) / 2.5066282746310002 * {poly})"


oracle("corr_matrix", f"WITH {CLEAN} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 8) AS corr FROM clean"
    for a, b in itertools.combinations(METRICS, 2)) + ")")

oracle("gram", f"WITH {CLEAN}, g AS ({_gram_select(METRICS)}) SELECT service, n, " + ", ".join(
    [f"round(mean__{c}, 4) AS mean__{c}" for c in METRICS]
    + [f"round(S__{a}__{b}, 4) AS S__{a}__{b}" for a, b in itertools.combinations_with_replacement(METRICS, 2)])
    + " FROM g")

_T, _W, _Y = "pool_wait_ms", "db_lock_time", "error_count"


def _ate_sql(t, w, y, src, by_sim=False):
    cols = [t, w, y]
    key = "sim, service" if by_sim else "service"
    grp = "GROUP BY sim" if by_sim else ""
    sel_sim = "sim, " if by_sim else ""
    sums = ", ".join(f"sum(S__{a}__{b}) AS S__{a}__{b}" for a, b in itertools.combinations_with_replacement(cols, 2))
    gparts = ", ".join(f"covar_pop({a}, {b}) * count(*) AS S__{a}__{b}"
                       for a, b in itertools.combinations_with_replacement(cols, 2))
    st, sw, stw = f"S__{t}__{t}", f"S__{w}__{w}", f"S__{t}__{w}"
    sty, swy, syy = f"S__{t}__{y}", f"S__{w}__{y}", f"S__{y}__{y}"
    return f"""g AS (SELECT {key}, count(*) AS n, {gparts} FROM {src} GROUP BY {key}),
p AS (SELECT {sel_sim}CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, {sums} FROM g {grp}),
b AS (SELECT *, ({sty} * {sw} - {swy} * {stw}) / ({st} * {sw} - {stw} * {stw}) AS beta,
             ({swy} * {st} - {sty} * {stw}) / ({st} * {sw} - {stw} * {stw}) AS gamma,
             ({st} * {sw} - {stw} * {stw}) AS det FROM p),
s AS (SELECT *, sqrt((({syy} - beta * {sty} - gamma * {swy}) / (n - groups - 2)) * {sw} / det) AS se FROM b)"""


oracle("ate_linear", f"""WITH {CLEAN}, {_ate_sql(_T, _W, _Y, 'clean')}
SELECT 'pool_wait_ms' AS treatment, 'error_count' AS outcome, n, groups,
  CASE WHEN n >= 5 THEN round(beta, 10) END AS ate, CASE WHEN n >= 5 THEN round(se, 10) END AS std_error,
  CASE WHEN n >= 5 THEN round(beta / se, 6) END AS t_value,
  CASE WHEN n >= 5 THEN round({_pval('beta / se')}, 6) END AS p_value FROM s""")

ORACLES["ate_incremental"] = ORACLES["ate_linear"]
oracle("ate_hetero", f"""WITH {CLEAN},
g AS (SELECT service, count(*) AS n, covar_pop(pool_wait_ms, pool_wait_ms) * count(*) AS stt,
        covar_pop(pool_wait_ms, db_lock_time) * count(*) AS stw, covar_pop(pool_wait_ms, error_count) * count(*) AS sty,
        covar_pop(db_lock_time, db_lock_time) * count(*) AS sww, covar_pop(db_lock_time, error_count) * count(*) AS swy
      FROM clean GROUP BY service),
q AS (SELECT *, stt > 0 AS ok, CASE WHEN stt > 0 THEN swy - stw * sty / stt END AS num,
        CASE WHEN stt > 0 THEN sww - stw * stw / stt END AS den FROM g),
gm AS (SELECT sum(num) / sum(den) AS gamma, sum(CASE WHEN ok THEN n END) AS n_ok,
        count(*) FILTER (WHERE NOT ok) AS excluded_groups FROM q)
SELECT 'pool_wait_ms' AS treatment, 'error_count' AS outcome,
  round(sum(q.n * (q.sty - gm.gamma * q.stw) / q.stt) / max(gm.n_ok), 10) AS ate,
  round(max(gm.gamma), 10) AS confounder_slope, max(gm.excluded_groups) AS excluded_groups
FROM q, gm WHERE q.ok""")

_PLACEBO_SRC = """ps AS (SELECT c.service, c.db_lock_time, c.error_count, CAST(c.sim AS INTEGER) AS sim,
   CAST((c.x * c.x + c.event_id % 1000003 * c.sim * 15485863) % 1000003 AS DOUBLE) / CAST(1000003 AS DOUBLE) AS placebo
   FROM (SELECT *, ((event_id % 1000003) * 7919 + sim * 104729
     + (event_id // 1000003 % 1000003) * (event_id // 1000003 % 1000003) % 1000003 * 486187) % 1000003 AS x
         FROM clean, (SELECT CAST(unnest(generate_series(1, 20)) AS BIGINT) AS sim)) c)"""

oracle("placebo_refute", f"""WITH {CLEAN}, {_PLACEBO_SRC}, {_ate_sql('placebo', _W, _Y, 'ps', by_sim=True)}
SELECT sim, round(beta, 10) AS placebo_effect, round(beta / se, 6) AS placebo_t FROM s""")


def _ate_cte_named(prefix_sql, name):
    return prefix_sql.replace("g AS (", f"{name}g AS (").replace("FROM g ", f"FROM {name}g ").replace(
        "p AS (", f"{name}p AS (").replace("FROM p)", f"FROM {name}p)").replace(
        "b AS (", f"{name}b AS (").replace("FROM b)", f"FROM {name}b)").replace("s AS (", f"{name}s AS (")


oracle("placebo_summary", f"""WITH {CLEAN}, {_PLACEBO_SRC},
{_ate_cte_named(_ate_sql('placebo', _W, _Y, 'ps', by_sim=True), 'pl_')},
{_ate_cte_named(_ate_sql(_T, _W, _Y, 'clean'), 're_')},
pl AS (SELECT sim, round(beta, 10) AS placebo_effect, round(beta / se, 6) AS placebo_t FROM pl_s),
re AS (SELECT round(beta, 10) AS real_ate, round(beta / se, 6) AS real_t FROM re_s)
SELECT max(real_ate) AS real_ate, round(avg(placebo_effect), 10) AS mean_placebo_effect, count(*) AS simulations,
  round(avg(CASE WHEN abs(placebo_t) >= abs(real_t) THEN 1.0 ELSE 0.0 END), 6) AS placebo_share_beyond
FROM pl, re""")


def _pcorr_sql(r, x, y, cond):
    if not cond:
        return r[frozenset((x, y))]
    z, rest = cond[-1], cond[:-1]
    rxy, rxz, ryz = _pcorr_sql(r, x, y, rest), _pcorr_sql(r, x, z, rest), _pcorr_sql(r, y, z, rest)
    return f"(({rxy}) - ({rxz}) * ({ryz})) / sqrt((1 - ({rxz}) * ({rxz})) * (1 - ({ryz}) * ({ryz})))"


def _pc_tests_sql():
    pairs = list(itertools.combinations(METRICS, 2))
    r = {frozenset(p): f"r{i}" for i, p in enumerate(pairs)}
    corr = ", ".join(f"corr({a}, {b}) AS r{i}" for i, (a, b) in enumerate(pairs))
    sels = []
    for x, y in pairs:
        others = [c for c in METRICS if c not in (x, y)]
        for k in range(3):
            for cond in itertools.combinations(others, k):
                pr = _pcorr_sql(r, x, y, cond)
                z = f"(sqrt(n - {k + 3}) * atanh({pr}))"
                sels.append(f"SELECT service, n, '{x}' AS x, '{y}' AS y, '{','.join(cond)}' AS cond, {k} AS \"order\", "
                            f"round({pr}, 6) AS partial_r, round({z}, 4) AS z, abs({z}) < 1.96 AS independent FROM w")
    return (f"{CLEAN}, w AS (SELECT coalesce(service, 'ALL') AS service, count(*) AS n, {corr} "
            f"FROM clean GROUP BY ROLLUP (service)), tests AS (" + " UNION ALL ".join(sels) + ")")


oracle("pc_tests", f"WITH {_pc_tests_sql()} SELECT * FROM tests")
_SKEL = """skel AS (SELECT service, x, y, NOT bool_or(independent) AS adjacent, round(min(abs(z)), 4) AS min_abs_z,
   arg_min(cond, (abs(z), "order", cond)) AS weakest_cond FROM tests GROUP BY service, x, y)"""
oracle("pc_skeleton", f"WITH {_pc_tests_sql()}, {_SKEL} SELECT * FROM skel")

_truth = sorted({tuple(sorted((a, b), key=METRICS.index)) for a, b in CAUSAL_EDGES if a in METRICS and b in METRICS})
_TRUTH = "truth AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _truth) + ") t(x, y))"


def _metrics_sql(found, method):
    return f"""SELECT '{method}' AS method, tp, fp, fn, fp + fn AS shd, round(tp / (tp + fn), 6) AS recall,
  round(fp / (6 - tp - fn), 6) AS false_positive_rate FROM (
  SELECT count(*) FILTER (WHERE f.x IS NOT NULL AND t.x IS NOT NULL) AS tp,
         count(*) FILTER (WHERE f.x IS NOT NULL AND t.x IS NULL) AS fp,
         count(*) FILTER (WHERE f.x IS NULL AND t.x IS NOT NULL) AS fn
  FROM ({found}) f FULL OUTER JOIN truth t ON f.x = t.x AND f.y = t.y)"""


oracle("graph_metrics", f"""WITH {_pc_tests_sql()}, {_SKEL}, {_TRUTH}
{_metrics_sql("SELECT x, y FROM skel WHERE service = 'ALL' AND adjacent", 'pc')}
UNION ALL
{_metrics_sql("SELECT x, y FROM tests WHERE service = 'ALL' AND \"order\" = 0 AND NOT independent", 'pearson')}""")


def _effect_scan_sql():
    sels = []
    for t, y in itertools.permutations(METRICS, 2):
        naive = f"{_s(t, y)} / {_s(t, t)}"
        if "db_lock_time" in (t, y):
            adj = naive
        else:
            w = "db_lock_time"
            adj = (f"({_s(t, y)} * {_s(w, w)} - {_s(w, y)} * {_s(t, w)}) / "
                   f"({_s(t, t)} * {_s(w, w)} - {_s(t, w)} * {_s(t, w)})")
        sels.append(f"SELECT service, n, '{t}' AS treatment, '{y}' AS outcome, round({naive}, 8) AS naive_slope, "
                    f"round({adj}, 8) AS adjusted_slope FROM g")
    return f"WITH {CLEAN}, g AS ({_gram_select(METRICS)}) " + " UNION ALL ".join(sels)


oracle("effect_scan", _effect_scan_sql())


# ---- 2.5 time series ---------------------------------------------------------
_BURST60 = """burst AS (SELECT event_id, "timestamp", service, cnt AS errors_in_window, cnt > 3 AS anomaly FROM (
  SELECT event_id, "timestamp", service, count(*) OVER (PARTITION BY service ORDER BY epoch_us("timestamp")
         RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS cnt FROM logs WHERE error_count >= 1))"""
oracle("error_burst", f"WITH {_BURST60} SELECT * FROM burst")
oracle("error_burst_global", """SELECT event_id, "timestamp", service, cnt AS errors_in_window, cnt > 3 AS anomaly FROM (
  SELECT event_id, "timestamp", service, count(*) OVER (ORDER BY epoch_us("timestamp")
         RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS cnt FROM logs WHERE error_count >= 1)""")
oracle("burst_sliding", """SELECT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, count(*) AS errors FROM (
  SELECT time_bucket(INTERVAL 1 MINUTE, "timestamp") - i * INTERVAL 1 MINUTE AS ws
  FROM logs, range(0, 5) r(i) WHERE error_count >= 1) GROUP BY ws HAVING count(*) > 3""")


def _cooldown_sql(seconds):
    return f"""WITH RECURSIVE {_BURST60}, cand AS (SELECT service, event_id, "timestamp" FROM burst WHERE anomaly),
fire(service, fired_at, event_id) AS (
  SELECT service, "timestamp", event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY service ORDER BY "timestamp", event_id) AS rn FROM cand) WHERE rn = 1
  UNION ALL
  SELECT f.service, n."timestamp", n.event_id FROM fire f, LATERAL (
    SELECT c."timestamp", c.event_id FROM cand c
    WHERE c.service = f.service AND c."timestamp" >= f.fired_at + INTERVAL {seconds} SECOND
    ORDER BY c."timestamp", c.event_id LIMIT 1) n)
SELECT service, fired_at, event_id FROM fire"""


oracle("cooldown", _cooldown_sql(30))
oracle("cooldown_30m", _cooldown_sql(1800))


def _fit_sql(key, src_key):
    return f"""st AS (SELECT {src_key} AS {key}, min(epoch_us("timestamp")) AS t0, max(epoch_us("timestamp")) AS t_last,
        avg(epoch_us("timestamp")) AS t_mean, count(*) AS n FROM logs WHERE latency_ms IS NOT NULL
        GROUP BY 1 HAVING count(*) >= 5),
zz AS (SELECT st.{key}, (CAST(epoch_us(l."timestamp") AS DOUBLE) - st.t_mean) / CAST(86400000000 AS DOUBLE) AS z,
        l.latency_ms AS y FROM logs l JOIN st ON st.{key} = {src_key.replace('service', 'l.service')}
        WHERE l.latency_ms IS NOT NULL),
sm AS (SELECT {key}, sum(z) AS s1, sum(z * z) AS s2, sum(z * z * z) AS s3, sum(z * z * z * z) AS s4,
        sum(y) AS sy, sum(z * y) AS szy, sum(z * z * y) AS szzy FROM zz GROUP BY {key}),
dt AS (SELECT sm.*, st.n, st.t0, st.t_last, st.t_mean, CAST(st.n AS DOUBLE) AS nd FROM sm JOIN st USING ({key})),
cf AS (SELECT *, nd * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM dt),
ab AS (SELECT *, (sy * (s2 * s4 - s3 * s3) - s1 * (szy * s4 - s3 * szzy) + s2 * (szy * s3 - s2 * szzy)) / det AS a0,
        (nd * (szy * s4 - szzy * s3) - sy * (s1 * s4 - s3 * s2) + s2 * (s1 * szzy - szy * s2)) / det AS a1,
        (nd * (s2 * szzy - s3 * szy) - s1 * (s1 * szzy - s2 * szy) + sy * (s1 * s3 - s2 * s2)) / det AS a2,
        (t_mean - t0) / CAST(86400000000 AS DOUBLE) AS c FROM cf)"""


def _fit_public_sql(key):
    return f"""SELECT {key}, n, make_timestamp(t0) AS first_ts, make_timestamp(t_last) AS last_ts,
  round(a0 - a1 * c + a2 * c * c, 6) AS coef0, round(a1 - 2 * a2 * c, 6) AS coef1_per_day,
  round(a2, 6) AS coef2_per_day2 FROM ab"""


oracle("forecast_fit", f"WITH {_fit_sql('service', 'service')} {_fit_public_sql('service')}")
oracle("forecast_global", f"WITH {_fit_sql('series', chr(39) + 'ALL' + chr(39))} {_fit_public_sql('series')}")
_HORIZON = """hz AS (SELECT service, step, make_timestamp(t0 + CAST(floor(x_s) AS BIGINT) * 1000000) AS ts,
   a0 + a1 * zf + a2 * zf * zf AS predicted FROM (
   SELECT *, (CAST(t0 AS DOUBLE) / 1000000 + x_s - t_mean / 1000000) / CAST(86400 AS DOUBLE) AS zf FROM (
     SELECT ab.*, s.step, CAST(t_last - t0 AS DOUBLE) / 1000000 + s.step * 60 AS x_s
     FROM ab, (SELECT CAST(unnest(generate_series(1, 30)) AS INTEGER) AS step) s)))"""
oracle("forecast_horizon", f"WITH {_fit_sql('service', 'service')}, {_HORIZON} "
       "SELECT service, step, ts, round(predicted, 4) AS predicted FROM hz")
oracle("slo_breach", f"""WITH {_fit_sql('service', 'service')}, {_HORIZON}
SELECT service, round(max(predicted), 2) AS max_predicted_latency, max(predicted) > 1000 AS will_breach_slo,
  CASE WHEN arg_max(predicted, step) > arg_min(predicted, step) * 1.1 THEN 'Accelerating' ELSE 'Stable' END AS trend
FROM hz GROUP BY service""")
oracle("forecast_linear", """WITH f AS (SELECT service, min(epoch_us("timestamp")) AS t0 FROM logs WHERE latency_ms IS NOT NULL GROUP BY service)
SELECT l.service, count(*) AS n,
  round(regr_slope(l.latency_ms, (epoch_us(l."timestamp") - f.t0) / CAST(86400000000 AS DOUBLE)), 6) AS slope_per_day,
  round(regr_intercept(l.latency_ms, (epoch_us(l."timestamp") - f.t0) / CAST(86400000000 AS DOUBLE)), 6) AS intercept
FROM logs l JOIN f USING (service) WHERE l.latency_ms IS NOT NULL GROUP BY l.service HAVING count(*) >= 5""")
def _lag_panel_sql(logs, bucket_us):
    return f"""per AS (SELECT service, CAST(floor(epoch_us("timestamp") / {bucket_us}) AS BIGINT) AS bucket,
   avg(cpu_percent) AS cpu, avg(latency_ms) AS latency, sum(error_count) AS errors FROM {logs} GROUP BY 1, 2),
ups AS (SELECT DISTINCT from_service AS upstream FROM edges WHERE to_service = 'payment-db'),
span AS (SELECT min(CAST(floor(epoch_us("timestamp") / {bucket_us}) AS BIGINT)) AS lo,
                max(CAST(floor(epoch_us("timestamp") / {bucket_us}) AS BIGINT)) AS hi FROM {logs}),
spine AS (SELECT upstream, unnest(generate_series(lo, hi)) AS bucket FROM ups, span)
SELECT s.upstream, make_timestamp(s.bucket * {bucket_us}) AS bucket_start, round(p.cpu, 6) AS cpu_lag1,
  round(p.latency, 6) AS latency_lag1, CAST(coalesce(t.errors, 0) AS BIGINT) AS target_errors
FROM spine s LEFT JOIN per p ON p.service = s.upstream AND p.bucket + 1 = s.bucket
LEFT JOIN (SELECT bucket, errors FROM per WHERE service = 'payment-db') t ON t.bucket = s.bucket"""


oracle("lag_panel", "WITH " + _lag_panel_sql("logs", 3_600_000_000))
oracle("lag_panel_lookback", """WITH lately AS (SELECT * FROM logs
  WHERE "timestamp" >= (SELECT max("timestamp") FROM logs) - INTERVAL 86400 SECOND), """ + _lag_panel_sql("lately", 600_000_000))
oracle("status_timeline", """WITH w AS (SELECT time_bucket(INTERVAL 10 SECOND, "timestamp") AS window_start, count(*) AS processed,
   sum(error_count) AS errors FROM logs GROUP BY 1)
SELECT window_start, processed, CAST(errors AS BIGINT) AS errors,
  CAST(sum(processed) OVER (ORDER BY window_start) AS BIGINT) AS processed_total,
  CAST(sum(errors) OVER (ORDER BY window_start) AS BIGINT) AS errors_total FROM w""")


# ---- 2.6 graph ---------------------------------------------------------------
_E = "from_service, to_service, ts, latency_ms, cpu_percent, memory_percent, seq"
oracle("edge_append", f"SELECT {_E} FROM edges")
oracle("edges_view", f"SELECT {_E} FROM edges")
oracle("topology_edges", """SELECT from_service, to_service, count(*) AS observations, max(ts) AS last_ts
  FROM edges GROUP BY 1, 2""")
oracle("topology_nodes", """WITH e AS (SELECT DISTINCT from_service, to_service FROM edges),
  o AS (SELECT from_service AS service, count(*) AS out_degree FROM e GROUP BY 1),
  i AS (SELECT to_service AS service, count(*) AS in_degree FROM e GROUP BY 1)
SELECT coalesce(o.service, i.service) AS service, coalesce(out_degree, 0) AS out_degree,
  coalesce(in_degree, 0) AS in_degree FROM o FULL OUTER JOIN i ON o.service = i.service""")
oracle("node_state", """SELECT from_service AS service, arg_max(cpu_percent, seq) AS current_cpu,
  arg_max(memory_percent, seq) AS current_memory, arg_max(ts, seq) AS last_updated
  FROM edges WHERE cpu_percent IS NOT NULL GROUP BY 1""")
_NB = f"""nb AS (SELECT from_service AS upstream, ts, latency_ms, cpu_percent AS cpu_from, memory_percent AS mem_from, seq
  FROM edges WHERE to_service = 'payment-db' AND ts >= {NOW} - INTERVAL 86400 SECOND)"""
oracle("causal_neighbors", f"WITH {_NB} SELECT * FROM nb")
oracle("neighbor_summary", f"""WITH {_NB} SELECT upstream, count(*) AS observations,
  round(avg(latency_ms), 6) AS avg_latency, max(ts) AS last_ts FROM nb GROUP BY 1""")
oracle("prune_edges", f"SELECT {_E} FROM edges WHERE ts > {NOW} - INTERVAL 604800 SECOND")
oracle("ttl_view", f"""SELECT from_service, to_service, count(*) AS observations, max(ts) AS last_ts
  FROM edges GROUP BY 1, 2 HAVING max(ts) >= {NOW} - INTERVAL 3600 SECOND""")
oracle("edge_last100", f"""SELECT * FROM (SELECT {_E}, CAST(row_number() OVER (PARTITION BY from_service, to_service
  ORDER BY seq DESC) AS INTEGER) AS recency FROM edges) WHERE recency <= 100""")
oracle("global_last5000", f"SELECT {_E} FROM edges ORDER BY seq DESC LIMIT 5000")
oracle("k_hop", """WITH e AS (SELECT DISTINCT from_service AS nbr, to_service AS node FROM edges),
  h1 AS (SELECT DISTINCT nbr AS service, 1 AS hop FROM e WHERE node = 'payment-db'),
  h2 AS (SELECT DISTINCT e.nbr AS service, 2 AS hop FROM h1 JOIN e ON e.node = h1.service)
SELECT service, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)
WHERE service <> 'payment-db' GROUP BY 1""")
oracle("reachability", """WITH RECURSIVE e AS (SELECT DISTINCT from_service AS a, to_service AS b FROM edges),
  r(a, b, hops) AS (SELECT a, b, 1 FROM e
    UNION SELECT r.a, e.b, r.hops + 1 FROM r JOIN e ON r.b = e.a WHERE r.hops < 64)
SELECT a AS ancestor, b AS descendant, min(hops) AS hops FROM r GROUP BY 1, 2""")
oracle("edge_obs_match", """SELECT a.seq AS log_seq, min(b.seq) AS matched_seq, count(*) AS candidates
  FROM edges a JOIN edges b ON a.from_service = b.from_service AND a.to_service = b.to_service
   AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 1000 GROUP BY 1""")


# ---- 2.4 similarity / context / scenarios ----------------------------------
def _cos(a, b):
    return (f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
            f"(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
            f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))")


def _knn_sql(q_cte, n):
    return f"""WITH {q_cte},
p AS (SELECT q.query_id, e.vec_id, {_cos('e.embedding', 'q.query_vec')} AS similarity
      FROM embeddings e JOIN q ON e.label = q.query_filter WHERE e.vec_id <> q.query_id)
SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank
  FROM p) WHERE rank <= {n}"""


oracle("knn_filtered", _knn_sql("q AS (SELECT vec_id AS query_id, embedding AS query_vec, label AS query_filter "
                                "FROM embeddings ORDER BY vec_id DESC LIMIT 1)", 5))
oracle("knn_batch", _knn_sql("q AS (SELECT max(vec_id) AS query_id, arg_max(embedding, vec_id) AS query_vec, "
                             "label AS query_filter FROM embeddings GROUP BY label)", 3))

_FIFTIETH = ("q AS (SELECT vec_id AS query_id, embedding AS query_vec, label AS query_filter FROM embeddings "
             "WHERE vec_id % 50 = 0)")
oracle("knn_blocks", _knn_sql(_FIFTIETH, 10))
oracle("knn_ivf", _knn_sql(_FIFTIETH, 10))



def _tfidf_sql(docs, queries):
    """CTEs down to sc(f, q, id, score): cosines of TF-IDF vectors of ``docs`` and ``queries`` (f, id, t) with the same f."""
    words = ("unnest(regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[0-9a-z\\x{80}-\\x{10FFFF}]+')) AS term")
    return f"""dc AS (SELECT f, id, term, 1 + ln(count(*)) AS tf FROM (SELECT f, id, {words} FROM {docs}) GROUP BY ALL),
qc AS (SELECT f, id, term, 1 + ln(count(*)) AS tf FROM (SELECT f, id, {words} FROM {queries}) GROUP BY ALL),
nt AS (SELECT f, count(*) AS texts FROM {docs} WHERE f IS NOT NULL GROUP BY 1),
df AS (SELECT f, term, count(*) AS df FROM dc GROUP BY ALL),
dw AS (SELECT f, id, term, tf * (ln((texts + 1) / (df + 1)) + 1) AS w FROM dc JOIN df USING (f, term) JOIN nt USING (f)),
qw AS (SELECT f, id, term, tf * (ln((texts + 1) / (coalesce(df, 0) + 1)) + 1) AS w FROM qc JOIN nt USING (f) LEFT JOIN df USING (f, term)),
dv AS (SELECT f, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY f, id)) AS w FROM dw),
qv AS (SELECT f, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY f, id)) AS w FROM qw),
sc AS (SELECT dv.f, qv.id AS q, dv.id, round(sum(dv.w * qv.w), 9) AS score FROM dv JOIN qv ON qv.f = dv.f AND qv.term = dv.term
       GROUP BY ALL)"""


oracle("similar_texts", f"""WITH dt AS (SELECT lang AS f, doc_id AS id, text AS t FROM documents),
qt AS (SELECT * FROM dt WHERE id % 50 = 0), {_tfidf_sql('dt', 'qt')}
SELECT q AS doc_id, CAST(rank AS INTEGER) AS rank, id AS similar_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY f, q ORDER BY score DESC, id DESC) AS rank FROM sc WHERE q <> id) WHERE rank <= 5""")
oracle("encode_messages", r"""WITH m AS (SELECT DISTINCT message FROM logs),
w AS (SELECT message, unnest(regexp_extract_all(translate(message, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[0-9a-z\x{80}-\x{10FFFF}]+')) AS word FROM m),
p AS (SELECT message, ('0x' || md5(word)[1:8])::BIGINT % 384 AS slot,
  CASE WHEN ('0x' || md5(word)[9:9])::BIGINT % 2 = 0 THEN 1 ELSE -1 END AS s FROM w),
c AS (SELECT message, slot, sum(s) AS v FROM p GROUP BY ALL)
SELECT message, slot::INTEGER AS slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY message)), 5) AS weight FROM c
QUALIFY v <> 0""")

_RECENT = f"""recent AS (SELECT * FROM logs WHERE error_count >= 1 AND "timestamp" > {NOW} - INTERVAL 1440 MINUTE)"""
_CONTEXT = f"""{CLEAN}, {_ate_cte_named(_ate_sql(_T, _W, _Y, 'clean'), 're_')},
ate AS (SELECT beta AS ate FROM re_s), {_RECENT},
lat AS (SELECT service, "timestamp" AS latest_ts, latency_ms AS latest_latency, db_lock_time AS latest_lock,
          pool_wait_ms AS latest_pool, message AS latest_message FROM (
          SELECT *, row_number() OVER (PARTITION BY service ORDER BY "timestamp" DESC, event_id DESC) AS rn FROM recent)
        WHERE rn = 1),
st AS (SELECT service, round(avg(latency_ms), 6) AS avg_latency, count(*) AS error_total FROM recent GROUP BY 1),
dm AS (SELECT service, message, row_number() OVER (PARTITION BY service ORDER BY "timestamp" DESC, event_id DESC, message) AS pos
       FROM (SELECT *, row_number() OVER (PARTITION BY service, message ORDER BY "timestamp" DESC, event_id DESC) AS rn
             FROM recent) WHERE rn = 1),
msgs AS (SELECT service, string_agg(message, ' | ' ORDER BY pos) AS recent_messages FROM dm WHERE pos <= 5 GROUP BY 1),
pm AS (SELECT service, coalesce(message, '') AS message, "timestamp", event_id FROM logs
       WHERE error_count >= 1 AND "timestamp" <= {NOW} - INTERVAL 1440 MINUTE),
dt AS (SELECT DISTINCT service AS f, message AS id, message AS t FROM pm),
qt AS (SELECT service AS f, service AS id, latest_message AS t FROM lat),
{_tfidf_sql('dt', 'qt')},
past AS (SELECT service, string_agg(message || ' @ ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S'), ' | ' ORDER BY p) AS "similar",
           string_agg('- ' || message || ' @ ' || strftime("timestamp", '%Y-%m-%d %H:%M:%S'), chr(10) ORDER BY p) AS similar_lines
         FROM (SELECT pm.*, row_number() OVER (PARTITION BY service ORDER BY score DESC, "timestamp" DESC, event_id DESC) AS p
               FROM pm JOIN sc ON sc.f = pm.service AND sc.id = pm.message) WHERE p <= 3 GROUP BY 1),
tgt AS (SELECT service AS target FROM recent ORDER BY "timestamp" DESC, event_id DESC LIMIT 1),
ctx AS (SELECT lat.service, lat.service = (SELECT target FROM tgt) AS is_target, latest_ts, latest_latency, latest_lock,
          latest_pool, latest_message, avg_latency, error_total, error_total / CAST(100 AS DOUBLE) AS error_rate_norm,
          recent_messages,
          CASE WHEN contains(lat.service, 'db') THEN 'db_contention -> pool_wait -> latency (ATE: ' || printf('%.2f', (SELECT ate FROM ate)) || ')'
               WHEN contains(lat.service, 'cache') THEN 'cache_miss/overload -> latency -> errors'
               WHEN contains(lat.service, 'gateway') THEN 'ingress_load -> upstream_timeout -> errors'
               ELSE lat.service || ' -> internal_latency -> errors' END AS causal_chain,
          coalesce("similar", '') AS "similar", coalesce(similar_lines, '') AS similar_lines
        FROM lat JOIN st USING (service) LEFT JOIN msgs USING (service) LEFT JOIN past USING (service))"""
oracle("incident_context", f"""WITH {_CONTEXT} SELECT service, is_target, latest_ts, latest_latency, latest_lock,
  latest_pool, latest_message, avg_latency, error_total, error_rate_norm, recent_messages, causal_chain, "similar" FROM ctx""")
oracle("prompt_render", f"""WITH {_CONTEXT} SELECT service, printf('Incident on %s
Latency: %.0f ms
Error rate: %.2f%%
Causal chain: %s
Recent logs:
%s
Similar incidents:
%s
Answer with a JSON diagnosis.', service, avg_latency, error_rate_norm * 100, causal_chain, recent_messages, similar_lines) AS prompt
FROM ctx""")


def _rules_values():
    from kestrel.operators.similarity import FIXTURE_RULES

    def lit(v):
        if v is None:
            return "CAST(NULL AS DOUBLE)"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return str(v)
        return "'" + v + "'"
    rows = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in FIXTURE_RULES)
    return (f"r AS (SELECT * FROM (VALUES {rows}) t(rule_id, service, min_latency, lock_below, min_lock, "
            "min_pool, diagnosis, expected_action, priority))")


_MATCH = f"""{_rules_values()},
m AS (SELECT l.event_id, l.service, r.rule_id, r.diagnosis, r.expected_action, r.priority FROM logs l JOIN r
      ON l.service = r.service AND (r.min_latency IS NULL OR l.latency_ms >= r.min_latency)
     AND (r.lock_below IS NULL OR l.db_lock_time < r.lock_below) AND (r.min_lock IS NULL OR l.db_lock_time >= r.min_lock)
     AND (r.min_pool IS NULL OR l.pool_wait_ms >= r.min_pool)),
best AS (SELECT event_id, service, arg_min(rule_id, priority) AS rule_id, arg_min(diagnosis, priority) AS diagnosis,
           arg_min(expected_action, priority) AS expected_action FROM m GROUP BY 1, 2)"""
oracle("scenario_match", f"WITH {_MATCH} SELECT * FROM best")

# ---- 2.8 rules / JSON ---------------------------------------------------------
_DMIX = """dmix AS (SELECT d.event_id, d."timestamp", d.service,
  CASE WHEN d.event_id % 17 <> 0 AND d.event_id % 2 = 1 THEN
    '{"SRE_DIAGNOSIS": "' || l.message || '", "CONFIDENCE": 0.' || lpad(CAST(l.k AS VARCHAR), 2, '0') ||
    ', "CLI_MITIGATION": "' || CASE l.k % 6 WHEN 0 THEN 'increase_pool' WHEN 1 THEN 'restart_service' WHEN 2 THEN 'scale_up'
       WHEN 3 THEN 'investigate_db' WHEN 4 THEN 'page_human' ELSE 'reboot_host' END ||
    '", "CAUSAL_BRIDGE": ' || CASE WHEN l.k % 2 = 0 THEN '["lock contention", "pool wait"]' ELSE '"lock contention -> pool wait"' END ||
    ', "SERVICE": "' || l.service || '"}'
  ELSE d.raw END AS raw FROM diagnoses d JOIN logs l USING (event_id))"""


def _parse_sql(src):
    return f"""pj AS (SELECT event_id, "timestamp", service, raw, CASE WHEN json_valid(raw) THEN raw END AS j FROM {src}),
pk AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS ok, coalesce(contains(raw, '429'), false) AS throttled,
         json_extract_string(j, '$.SRE_DIAGNOSIS') IS NOT NULL OR TRY_CAST(json_extract_string(j, '$.CONFIDENCE') AS DOUBLE) IS NOT NULL AS is_b
       FROM pj),
parsed AS (SELECT event_id, "timestamp", service,
  CASE WHEN NOT ok THEN 'none' WHEN is_b THEN 'B' ELSE 'A' END AS schema,
  CASE WHEN NOT ok AND throttled THEN 'Diagnosis throttled by rate limit' WHEN NOT ok THEN 'unparsed diagnosis' WHEN is_b THEN json_extract_string(j, '$.SRE_DIAGNOSIS')
       ELSE json_extract_string(j, '$.root_cause') END AS root_cause,
  CASE WHEN NOT ok THEN CAST(CASE WHEN throttled THEN 0.1 ELSE 0 END AS DOUBLE) WHEN is_b THEN TRY_CAST(json_extract_string(j, '$.CONFIDENCE') AS DOUBLE)
       ELSE TRY_CAST(json_extract_string(j, '$.confidence_score') AS DOUBLE) END AS confidence_score,
  CASE WHEN NOT ok THEN coalesce(service, 'unknown') WHEN is_b THEN json_extract_string(j, '$.SERVICE') ELSE json_extract_string(j, '$.affected_service') END AS affected_service,
  CASE WHEN NOT ok THEN 'page_human' WHEN is_b THEN json_extract_string(j, '$.CLI_MITIGATION')
       ELSE json_extract_string(j, '$.recommended_action') END AS recommended_action,
  CASE WHEN is_b THEN (CASE WHEN json_type(j, '$.CAUSAL_BRIDGE') = 'ARRAY'
         THEN array_to_string(CAST(json_extract(j, '$.CAUSAL_BRIDGE') AS VARCHAR[]), chr(10) || '- ')
         ELSE json_extract_string(j, '$.CAUSAL_BRIDGE') END)
       ELSE json_extract_string(j, '$.reasoning') END AS reasoning
FROM pk)"""


_GATE = """gated AS (SELECT event_id, "timestamp", 'remediate' AS type, coalesce(recommended_action, 'page_human') AS action,
  coalesce(affected_service, 'unknown') AS target, coalesce(root_cause, 'Anomalous behavior detected') AS reason,
  confidence_score FROM parsed WHERE confidence_score > 0.8)"""

oracle("diagnosis_parse", f"WITH {_DMIX}, {_parse_sql('dmix')} SELECT * FROM parsed")
oracle("action_gate", f"WITH {_parse_sql('diagnoses')}, {_GATE} SELECT * FROM gated")
oracle("action_validate", f"""WITH {_parse_sql('diagnoses')}, v AS (SELECT *,
  recommended_action IN ('increase_pool', 'restart_service', 'scale_up', 'investigate_db', 'page_human') AS action_allowed,
  confidence_score BETWEEN 0.0 AND 1.0 AS confidence_in_range FROM parsed)
SELECT count(*) AS diagnoses, count(*) FILTER (WHERE NOT action_allowed) AS bad_action,
  count(*) FILTER (WHERE NOT coalesce(confidence_in_range, false)) AS bad_confidence,
  count(*) FILTER (WHERE action_allowed AND confidence_in_range) AS valid FROM v""")
oracle("system_status", f"""WITH {_parse_sql('diagnoses')}, {_GATE}
SELECT count(*) AS total_logs, count(*) FILTER (WHERE error_count > 0) AS error_logs, count(*) AS processed,
  (SELECT count(*) FROM gated) AS remediations FROM logs""")
oracle("top_k_history", f"""WITH {_parse_sql('diagnoses')}, {_GATE}
SELECT * FROM gated ORDER BY "timestamp" DESC, event_id DESC LIMIT 20""")
oracle("top_k_history_per_target", f"""WITH {_parse_sql('diagnoses')}, {_GATE}
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY "timestamp" DESC, event_id DESC) AS INTEGER)
  AS position FROM gated) WHERE position <= 20""")
oracle("scenario_eval", f"""WITH {_MATCH}, {_parse_sql('diagnoses')}
SELECT rule_id, count(*) AS incidents, count(p.recommended_action) AS diagnosed,
  count(*) FILTER (WHERE p.recommended_action = b.expected_action) AS passed,
  round(count(*) FILTER (WHERE p.recommended_action = b.expected_action) / count(p.recommended_action), 6) AS pass_rate
FROM best b LEFT JOIN parsed p USING (event_id) GROUP BY 1""")

_AUDIT = """au AS (SELECT *, len(forb) = 0 AND NOT force AS is_safe FROM (
  SELECT event_id, service, command, cmd,
    list_filter(['delete', 'remove', 'drop', 'restart', 'reboot'], lambda v: contains(cmd, v)) AS forb,
    starts_with(cmd, 'kubectl') OR starts_with(cmd, 'terraform') AS iac, contains(cmd, '--force') AS force,
    len(list_filter(['scale', 'edit', 'set', 'annotate', 'label', 'rollout'], lambda v: contains(cmd, v))) > 0 AS safe_verb
  FROM (SELECT *, lower(command) AS cmd FROM commands))),
aud AS (SELECT event_id, service, command, is_safe,
  CAST(greatest(100 - 100 * len(forb) - CASE WHEN NOT iac THEN 20 ELSE 0 END - CASE WHEN force THEN 50 ELSE 0 END
       - CASE WHEN NOT safe_verb AND is_safe THEN 30 ELSE 0 END, 0) AS INTEGER) AS security_score,
  list_concat(list_concat(list_concat(list_transform(forb, lambda v: 'forbidden_verb:' || v),
     CASE WHEN NOT iac THEN ['not_iac_tool'] ELSE CAST([] AS VARCHAR[]) END),
     CASE WHEN force THEN ['force_flag'] ELSE CAST([] AS VARCHAR[]) END),
     CASE WHEN NOT safe_verb AND is_safe THEN ['no_safe_verb'] ELSE CAST([] AS VARCHAR[]) END) AS issues,
  CASE WHEN is_safe THEN 'would_apply' ELSE 'halted' END AS outcome FROM au)"""
oracle("guardrail_audit", f"""WITH {_AUDIT} SELECT event_id, service, command, is_safe, security_score,
  array_to_string(issues, ';') AS issues, outcome FROM aud""")
oracle("guardrail_summary", f"""WITH {_AUDIT} SELECT service, issue, count(*) AS commands FROM (
  SELECT service, unnest(issues) AS issue FROM aud) GROUP BY 1, 2""")
oracle("causal_chain", f"""WITH {CLEAN}, {_ate_cte_named(_ate_sql(_T, _W, _Y, 'clean'), 're_')}
SELECT service, CASE WHEN contains(service, 'db') THEN 'db_contention -> pool_wait -> latency (ATE: ' || printf('%.2f', (SELECT beta FROM re_s)) || ')'
  WHEN contains(service, 'cache') THEN 'cache_miss/overload -> latency -> errors'
  WHEN contains(service, 'gateway') THEN 'ingress_load -> upstream_timeout -> errors'
  ELSE service || ' -> internal_latency -> errors' END AS causal_chain FROM (SELECT DISTINCT service FROM logs)""")


# ---- 2.1 sources / sinks -------------------------------------------------------
_STORE = ('event_id, "timestamp", service, level, message, latency_ms, db_lock_time, pool_wait_ms, error_count')
oracle("src_logs_csv", f"SELECT {_STORE} FROM logs")
oracle("sink_logs_csv", """SELECT service, level, count(*) AS "rows", round(sum(latency_ms), 4) AS latency_sum
  FROM logs GROUP BY 1, 2""")
_SUBMITTED_TS = """CASE WHEN event_id % 5 = 0 THEN date_trunc('second', "timestamp")
  WHEN event_id % 5 = 3 THEN make_timestamp(epoch_us("timestamp") // 100000 * 100000) ELSE "timestamp" END AS "timestamp\""""
_REQUEST = "CASE WHEN event_id % 41 <> 0 THEN event_id END AS request_id"
_ACCEPTED = "event_id % 13 <> 0 AND event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_id % 37 <> 0"
oracle("src_submissions", f"""SELECT {_REQUEST}, {_SUBMITTED_TS}, service,
  CASE WHEN event_id % 7 = 0 THEN 'INFO' ELSE level END AS level, latency_ms, message
  FROM logs WHERE {_ACCEPTED}""")
oracle("submissions_quarantine", f"""SELECT reason, count(*) AS "rows" FROM (
  SELECT CASE WHEN event_id % 13 = 0 THEN 'malformed' WHEN event_id % 29 = 0 THEN 'bad_timestamp'
              WHEN event_id % 31 = 0 THEN 'missing_latency' ELSE 'missing_message' END AS reason
  FROM logs WHERE NOT ({_ACCEPTED})) GROUP BY 1""")
ORACLES["stream_quarantine"] = ORACLES["submissions_quarantine"]
oracle("log_store_append_bulk", f"""SELECT 'log_' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '_' || event_id AS id, {_STORE}
  FROM logs""")
oracle("log_store_untimed", f"""SELECT CASE WHEN event_id % 47 <> 0 THEN event_id END AS event_id,
  CASE WHEN event_id % 43 <> 0 THEN "timestamp" END AS "timestamp", {_STORE.split(', ', 2)[2]}
  FROM logs WHERE event_id % 43 = 0 OR event_id % 47 = 0""")
oracle("log_store_wipe", f"""SELECT '' AS id, {_STORE} FROM logs WHERE false""")
_NULLS = """burst_in AS (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN service END AS service,
  CASE WHEN event_id % 13 <> 0 THEN date_trunc('minute', "timestamp") END AS "timestamp"
  FROM logs WHERE error_count >= 1),
burst AS (SELECT event_id, "timestamp", service, cnt AS errors_in_window, cnt > 3 AS anomaly FROM (
  SELECT *, CASE WHEN "timestamp" IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY service ORDER BY epoch_us("timestamp")
         RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) END AS cnt FROM burst_in))"""
oracle("error_burst_nulls", f"WITH {_NULLS} SELECT * FROM burst")
oracle("cooldown_nulls", f"""WITH RECURSIVE {_NULLS}, cand AS (SELECT service, event_id, "timestamp" FROM burst WHERE anomaly),
fire(service, fired_at, event_id) AS (
  SELECT service, "timestamp", event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY service ORDER BY "timestamp", event_id) AS rn FROM cand) WHERE rn = 1
  UNION ALL
  SELECT f.service, n."timestamp", n.event_id FROM fire f, LATERAL (
    SELECT c."timestamp", c.event_id FROM cand c
    WHERE c.service IS NOT DISTINCT FROM f.service AND c."timestamp" >= f.fired_at + INTERVAL 1800 SECOND
    ORDER BY c."timestamp", c.event_id LIMIT 1) n)
SELECT service, fired_at, event_id FROM fire""")
oracle("topology_edges_nulls", """SELECT from_service, to_service, count(*) AS observations, max(ts) AS last_ts FROM (
  SELECT lag(service) OVER (PARTITION BY user_id ORDER BY "timestamp" NULLS FIRST, event_id) AS from_service,
         service AS to_service, "timestamp" AS ts
  FROM (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN user_id % 3 END AS user_id,
               CASE WHEN event_id % 11 <> 0 THEN service END AS service,
               CASE WHEN event_id % 13 <> 0 THEN date_trunc('minute', "timestamp") END AS "timestamp" FROM logs))
  WHERE from_service IS NOT NULL GROUP BY 1, 2""")
oracle("dag_confounders", """SELECT 'db_lock_time' AS confounder""")
_STORE_ROWS = f"""store AS (SELECT * FROM (
  SELECT strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '_' || service AS id, {_STORE},
         row_number() OVER (PARTITION BY strftime("timestamp", '%Y-%m-%dT%H:%M:%S.%f') || '_' || service
                            ORDER BY event_id) AS rn
  FROM logs) WHERE rn = 1)"""
oracle("log_store_append", f"""WITH {_STORE_ROWS} SELECT id, {_STORE} FROM store""")
oracle("log_store_scan", f"""WITH {_STORE_ROWS} SELECT id, service, "timestamp", level, latency_ms, error_count
  FROM store WHERE error_count >= 1""")
oracle("log_store_retention", f"""WITH {_STORE_ROWS} SELECT id, {_STORE} FROM store
  WHERE "timestamp" > {NOW} - INTERVAL 7 DAY""")
_FB = f"""{_parse_sql('diagnoses')},
fb AS (SELECT f."timestamp", f.rating, f.event_id, p.root_cause, p.confidence_score, p.affected_service,
         p.recommended_action FROM feedback f JOIN parsed p USING (event_id)),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY "timestamp" DESC, rating DESC) AS rn
           FROM fb) WHERE rn = 1)"""
oracle("feedback_append", f"WITH {_FB} SELECT \"timestamp\", rating, event_id, root_cause, confidence_score, "
       "affected_service, recommended_action FROM fb")
oracle("feedback_gold", f"""WITH {_FB} SELECT event_id, "timestamp", root_cause, confidence_score, affected_service,
  recommended_action FROM latest WHERE rating = 'positive'""")
oracle("feedback_counts", f"WITH {_FB} SELECT rating, count(*) AS analyses FROM latest GROUP BY 1")


# ---- 2.9 streaming: batch twins ----------------------------------------------------
ORACLES["stream_burst"] = ORACLES["burst_sliding"]
ORACLES["stream_cooldown"] = ORACLES["cooldown"]
ORACLES["stream_ingest"] = with_views(f"""SELECT {_REQUEST}, {_SUBMITTED_TS}, service,
  CASE WHEN event_id % 7 = 0 THEN 'INFO' ELSE level END AS level, latency_ms, message,
  CAST(CASE WHEN (CASE WHEN event_id % 7 = 0 THEN 'INFO' ELSE level END) = 'ERROR' THEN 1 ELSE 0 END AS INTEGER) AS error_count
  FROM logs WHERE {_ACCEPTED}""")
_REPEATED = "(event_id % 10 = 0 AND event_id % 3 <> 2)"
ORACLES["stream_metrics"] = with_views(f"""SELECT count(*) + count(*) FILTER (WHERE {_REPEATED}) AS submitted,
  count(*) FILTER (WHERE {_ACCEPTED}) AS accepted,
  count(*) FILTER (WHERE NOT ({_ACCEPTED})) + count(*) FILTER (WHERE NOT ({_ACCEPTED}) AND {_REPEATED}) AS refused,
  count(*) FILTER (WHERE {_ACCEPTED} AND {_REPEATED}) AS repeated,
  count(*) FILTER (WHERE {_ACCEPTED} AND event_id % 7 <> 0 AND level = 'ERROR') AS errors FROM logs""")
ORACLES["stream_history"] = with_views(f"""WITH fired AS ({_cooldown_sql(30)}),
dfired AS (SELECT d.* FROM diagnoses d JOIN fired USING (event_id)), {_parse_sql('dfired')}, {_GATE}
SELECT * FROM gated ORDER BY "timestamp" DESC, event_id DESC LIMIT 20""")
ORACLES["stream_actions"] = ORACLES["action_gate"]
ORACLES["stream_node_state"] = ORACLES["node_state"]
ORACLES["stream_cooldown_timers"] = ORACLES["cooldown"]
ORACLES["stream_counters"] = with_views(f"""SELECT count(*) AS submitted, count(*) FILTER (WHERE NOT ({_ACCEPTED})) AS refused,
  count(*) FILTER (WHERE {_ACCEPTED} AND event_id % 7 <> 0 AND level = 'ERROR') AS errors FROM logs""")
ORACLES["stream_diagnosed"] = with_views(f"""WITH fired AS ({_cooldown_sql(30)}),
dia AS (SELECT *, "timestamp" + (event_id % 17 - 2) * INTERVAL 1 MINUTE AS diagnosed_at FROM diagnoses WHERE event_id % 7 <> 0),
{_parse_sql('diagnoses')}
SELECT f.event_id, f.service, f.fired_at, d.diagnosed_at, d.event_id IS NULL AS paged,
  CASE WHEN d.event_id IS NULL THEN 'page_human' ELSE p.recommended_action END AS action
FROM fired f LEFT JOIN dia d ON d.event_id = f.event_id AND d.diagnosed_at >= f.fired_at - INTERVAL 5 MINUTE
  AND d.diagnosed_at <= f.fired_at + INTERVAL 10 MINUTE LEFT JOIN parsed p ON p.event_id = f.event_id""")
