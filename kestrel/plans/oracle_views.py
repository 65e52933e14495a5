"""DuckDB definitions of the derived views, prepended as CTEs to oracle SQL.

Written independently of the Spark code from FIXTURES.md §3.  Fractional
literals are cast to DOUBLE so both engines compute in double (SURVEY T1).
"""

from __future__ import annotations

import re

VIEW_SQL = {
    "logs": """
logs AS (
  SELECT event_id, ts AS "timestamp", user_id, service,
         CASE WHEN error_count = 1 THEN 'ERROR' WHEN latency_ms > 100 THEN 'WARN' ELSE 'INFO' END AS level,
         CASE WHEN error_count = 1 THEN 'Request timeout'
              ELSE 'Request completed in ' || CAST(CAST(floor(latency_ms) AS BIGINT) AS VARCHAR) || 'ms' END AS message,
         latency_ms, db_lock_time, pool_wait_ms, error_count,
         CAST(k AS DOUBLE) AS cpu_percent, CAST(user_id % 100 AS DOUBLE) AS memory_percent, k
  FROM (
    SELECT *, CAST(CASE WHEN CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)
                         < CAST(1 AS DOUBLE) / (CAST(1 AS DOUBLE) + exp(-(latency_ms - CAST(200 AS DOUBLE)) / CAST(50 AS DOUBLE)))
                    THEN 1 ELSE 0 END AS INTEGER) AS error_count
    FROM (
      SELECT *, CAST(20 AS DOUBLE) + 2 * pool_wait_ms + CAST(user_id % 20 AS DOUBLE) AS latency_ms
      FROM (
        SELECT *, greatest(CAST(0 AS DOUBLE), 50 * db_lock_time + (k - CAST(49.5 AS DOUBLE)) / CAST(3 AS DOUBLE)) AS pool_wait_ms
        FROM (
          SELECT event_id, ts, user_id,
                 TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
                 CASE event_id % 5 WHEN 0 THEN 'api-gateway' WHEN 1 THEN 'user-service'
                      WHEN 2 THEN 'payment-db' WHEN 3 THEN 'redis-cache' ELSE 'notification-svc' END AS service,
                 CASE WHEN ts > TIMESTAMP '2024-01-23 12:00:00' THEN value / 25 ELSE value / 500 END AS db_lock_time
          FROM events))))
)""",
    "edges": """
edges AS (
  SELECT * FROM (
    SELECT lag(service) OVER (PARTITION BY user_id ORDER BY "timestamp", event_id) AS from_service,
           service AS to_service, "timestamp" AS ts, latency_ms,
           CASE WHEN event_id % 4 = 0 THEN NULL ELSE cpu_percent END AS cpu_percent,
           memory_percent, event_id AS seq
    FROM logs) WHERE from_service IS NOT NULL
)""",
    "commands": """
commands AS (
  SELECT event_id, service,
         CASE user_id % 4 WHEN 0 THEN 'aws' WHEN 1 THEN 'terraform' ELSE 'kubectl' END || ' ' ||
         CASE k % 8 WHEN 0 THEN 'scale' WHEN 1 THEN 'edit' WHEN 2 THEN 'delete' WHEN 3 THEN 'rollout restart'
                    WHEN 4 THEN 'set resources' WHEN 5 THEN 'drain' WHEN 6 THEN 'Drop' ELSE 'annotate' END ||
         ' deployment/' || service || CASE WHEN k % 10 = 0 THEN ' --force' ELSE '' END AS command
  FROM logs
)""",
    "diagnoses": """
diagnoses AS (
  SELECT event_id, "timestamp", service,
         CASE WHEN event_id % 34 = 0 THEN 'Error code: 429 - rate limit reached'
              WHEN event_id % 17 = 0 THEN 'not json'
              ELSE '{"root_cause": "' || message || '", "confidence_score": 0.' || lpad(CAST(k AS VARCHAR), 2, '0') ||
                   ', "affected_service": "' || service || '", "recommended_action": "' ||
                   CASE k % 6 WHEN 0 THEN 'increase_pool' WHEN 1 THEN 'restart_service' WHEN 2 THEN 'scale_up'
                              WHEN 3 THEN 'investigate_db' WHEN 4 THEN 'page_human' ELSE 'reboot_host' END || '"}' END AS raw
  FROM logs WHERE error_count = 1
)""",
    "feedback": """
feedback AS (
  SELECT d."timestamp" + INTERVAL 1 MINUTE AS "timestamp",
         CASE WHEN l.k % 2 = 0 THEN 'positive' ELSE 'negative' END AS rating, d.event_id, d.raw
  FROM diagnoses d JOIN logs l USING (event_id)
  UNION ALL
  SELECT d."timestamp" + INTERVAL 2 MINUTE AS "timestamp",
         CASE WHEN l.k % 2 = 0 THEN 'negative' ELSE 'positive' END AS rating, d.event_id, d.raw
  FROM diagnoses d JOIN logs l USING (event_id) WHERE d.event_id % 3 = 0
)""",
}

# Which views each view needs, in definition order.
_DEPS = {"logs": [], "edges": ["logs"], "commands": ["logs"], "diagnoses": ["logs"],
         "feedback": ["logs", "diagnoses"]}
_ORDER = ["logs", "edges", "commands", "diagnoses", "feedback"]


def with_views(body: str, *, recursive: bool = False) -> str:
    """Prefix ``body`` with the CTEs of every derived view it names."""
    need: set[str] = set()
    for name in _ORDER:
        if re.search(rf"\b{name}\b", body):
            need.add(name)
    changed = True
    while changed:
        changed = False
        for n in list(need):
            for d in _DEPS[n]:
                if d not in need:
                    need.add(d)
                    changed = True
    ctes = [VIEW_SQL[n].strip() for n in _ORDER if n in need]
    body = body.strip()
    if not ctes:
        return body
    upper = body.upper()
    if upper.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):]
    head = "WITH RECURSIVE " if recursive else "WITH "
    if upper.startswith("WITH "):
        return head + ",\n".join(ctes) + ",\n" + body[len("WITH "):]
    return head + ",\n".join(ctes) + "\n" + body
