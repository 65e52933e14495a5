"""Fixed values that must equal the reference's for equal results.

They are stated once, in natural order, and imported everywhere else.
"""

# Service names of the synthetic estate, in order.
SERVICES = ["api-gateway", "user-service", "payment-db", "redis-cache", "notification-svc"]

# The four telemetry metrics the causal model reads.
METRICS = ["db_lock_time", "pool_wait_ms", "latency_ms", "error_count"]

# The causal graph (cause, effect).
CAUSAL_EDGES = [
    ("db_lock_time", "pool_wait_ms"),
    ("pool_wait_ms", "latency_ms"),
    ("latency_ms", "error_count"),
    ("db_lock_time", "latency_ms"),
    ("service", "latency_ms"),
    ("service", "error_count"),
]
TREATMENT = "pool_wait_ms"
OUTCOME = "error_count"
CONFOUNDER = "db_lock_time"

# Command safety policy.
SAFE_VERBS = ["scale", "edit", "set", "annotate", "label", "rollout"]
FORBIDDEN_VERBS = ["delete", "remove", "drop", "restart", "reboot"]
IAC_PREFIXES = ["kubectl", "terraform"]
FORCE_FLAG = "--force"

# Services that the generated incident affects.
AFFECTED = ["payment-db", "api-gateway", "user-service"]

# Remediation actions a diagnosis may recommend.
ALLOWED_ACTIONS = ["increase_pool", "restart_service", "scale_up", "investigate_db", "page_human"]

# Thresholds and defaults of the detection loop.
BURST_WINDOW_MINUTES = 5
BURST_MIN_ERRORS = 3          # anomaly when count is strictly greater
COOLDOWN_SECONDS = 30
ACTION_CONFIDENCE = 0.8       # act when confidence is strictly greater
HISTORY_KEEP = 20
SLO_MS = 1000.0
FORECAST_MIN_ROWS = 5
FORECAST_STEPS = 30
FORECAST_STEP_SECONDS = 60
TREND_FACTOR = 1.1
EDGE_KEEP = 100
GLOBAL_KEEP = 5000
TTL_SECONDS = 3600
PRUNE_SECONDS = 7200
NEIGHBOR_WINDOW_SECONDS = 300.0
MATCH_TOLERANCE_SECONDS = 0.001
WARN_LATENCY_MS = 100.0

# Causal-chain texts by service family (first match wins).
CHAIN_DB = "db_contention -> pool_wait -> latency (ATE: {ate})"
CHAIN_CACHE = "cache_miss/overload -> latency -> errors"
CHAIN_GATEWAY = "ingress_load -> upstream_timeout -> errors"
CHAIN_OTHER = "{service} -> internal_latency -> errors"

# Defaults when a diagnosis is missing or unparsable.
DEFAULT_ACTION = "page_human"
DEFAULT_TARGET = "unknown"
DEFAULT_REASON = "Anomalous behavior detected"
