"""Command audit, causal-chain text, diagnosis parsing and action gating
(SURVEY §2.8).  All column expressions: higher-order array functions and
VARIANT parsing, no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.fixed import (ACTION_CONFIDENCE, ALLOWED_ACTIONS, CHAIN_CACHE, CHAIN_DB, CHAIN_GATEWAY,
                           CHAIN_OTHER, DEFAULT_ACTION, DEFAULT_REASON, DEFAULT_TARGET,
                           FORBIDDEN_VERBS, FORCE_FLAG, IAC_PREFIXES, SAFE_VERBS)


def _has(cmd: Column, term: Column, word_match: bool) -> Column:
    if word_match:
        return F.regexp_like(cmd, F.concat(F.lit("\\b"), term, F.lit("\\b")))
    return F.contains(cmd, term)


def guardrail_audit(commands: DataFrame, command: str = "command", word_match: bool = False) -> DataFrame:
    """Safety score of each command.

    Start at 100; -100 per forbidden verb (unsafe); -20 unless it starts
    with an IaC tool; -50 for the force flag (unsafe); -30 when no safe verb
    appears and it is still safe; floor 0.  Verbs match as substrings
    unless ``word_match``.  ``issues`` lists the findings in that order.
    """
    cmd = F.lower(F.col(command))
    forb = F.filter(F.array(*[F.lit(v) for v in FORBIDDEN_VERBS]), lambda v: _has(cmd, v, word_match))
    iac = F.exists(F.array(*[F.lit(p) for p in IAC_PREFIXES]), lambda p: F.startswith(cmd, p))
    force = F.contains(cmd, F.lit(FORCE_FLAG))
    safe_verb = F.exists(F.array(*[F.lit(v) for v in SAFE_VERBS]), lambda v: _has(cmd, v, word_match))
    a = commands.select("*", forb.alias("_forb"), iac.alias("_iac"), force.alias("_force"),
                        safe_verb.alias("_safe_verb"))
    is_safe = (F.size("_forb") == 0) & ~F.col("_force")
    score = (F.lit(100) - 100 * F.size("_forb") - F.when(~F.col("_iac"), 20).otherwise(0)
             - F.when(F.col("_force"), 50).otherwise(0)
             - F.when(~F.col("_safe_verb") & is_safe, 30).otherwise(0))
    issues = F.concat(
        F.transform("_forb", lambda v: F.concat(F.lit("forbidden_verb:"), v)),
        F.when(~F.col("_iac"), F.array(F.lit("not_iac_tool"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("_force"), F.array(F.lit("force_flag"))).otherwise(F.array().cast("array<string>")),
        F.when(~F.col("_safe_verb") & is_safe, F.array(F.lit("no_safe_verb")))
         .otherwise(F.array().cast("array<string>")))
    return a.select(*commands.columns, is_safe.alias("is_safe"),
                    F.greatest(score, F.lit(0)).alias("security_score"),
                    issues.alias("issues"),
                    F.when(is_safe, "would_apply").otherwise("halted").alias("outcome"))


def guardrail_summary(audit: DataFrame, by: str = "service") -> DataFrame:
    """Commands per service and issue (explode of the issue list)."""
    return (audit.select(by, F.explode("issues").alias("issue"))
            .groupBy(by, "issue").agg(F.count(F.lit(1)).alias("commands")))


def causal_chain(service: Column, ate: Column) -> Column:
    """Causal-chain text by service family; the db form carries the ATE (2 dp)."""
    ate_txt = F.format_string("%.2f", ate)
    db = F.replace(F.lit(CHAIN_DB), F.lit("{ate}"), ate_txt)
    other = F.replace(F.lit(CHAIN_OTHER), F.lit("{service}"), service)
    return (F.when(F.contains(service, F.lit("db")), db)
            .when(F.contains(service, F.lit("cache")), F.lit(CHAIN_CACHE))
            .when(F.contains(service, F.lit("gateway")), F.lit(CHAIN_GATEWAY))
            .otherwise(other))


def diagnosis_parse(diagnoses: DataFrame, raw: str = "raw") -> DataFrame:
    """Parse stored model output into one schema.

    Accepts schema A (root_cause, confidence_score, affected_service,
    recommended_action, reasoning) and schema B (SRE_DIAGNOSIS, CONFIDENCE,
    CLI_MITIGATION, CAUSAL_BRIDGE as text or list, SERVICE).  Text that is
    not a JSON object parses to confidence 0.0 (a rate-limit error, 429: 0.1),
    the default action, and the service of the row.  The text is parsed once,
    in a projection of its own.
    """
    diagnoses = diagnoses.withColumn("_json", F.try_parse_json(F.col(raw)))
    v = F.col("_json")

    def g(path: str, t: str = "string") -> Column:
        return F.try_variant_get(v, path, t)

    is_obj = F.regexp_like(F.col(raw), F.lit(r"^\s*\{"))   # parsed JSON starting with '{' is an object
    is_b = g("$.SRE_DIAGNOSIS").isNotNull() | g("$.CONFIDENCE", "double").isNotNull()
    bridge = F.coalesce(F.array_join(g("$.CAUSAL_BRIDGE", "array<string>"), "\n- "), g("$.CAUSAL_BRIDGE"))
    parsed = v.isNotNull() & F.coalesce(is_obj, F.lit(False))
    throttled = ~parsed & F.coalesce(F.contains(F.col(raw), F.lit("429")), F.lit(False))
    own = F.coalesce(F.col("service"), F.lit(DEFAULT_TARGET)) if "service" in diagnoses.columns else F.lit(DEFAULT_TARGET)
    kind = F.when(~parsed, "none").when(is_b, "B").otherwise("A")
    return diagnoses.select(
        *[c for c in diagnoses.columns if c not in (raw, "_json")],
        kind.alias("schema"),
        F.when(throttled, F.lit("Diagnosis throttled by rate limit")).when(~parsed, F.lit("unparsed diagnosis"))
         .when(is_b, g("$.SRE_DIAGNOSIS")).otherwise(g("$.root_cause")).alias("root_cause"),
        F.when(throttled, F.lit(0.1)).when(~parsed, F.lit(0.0))
         .when(is_b, g("$.CONFIDENCE", "double")).otherwise(g("$.confidence_score", "double"))
         .alias("confidence_score"),
        F.when(~parsed, own).when(is_b, g("$.SERVICE")).otherwise(g("$.affected_service")).alias("affected_service"),
        F.when(~parsed, F.lit(DEFAULT_ACTION))
         .when(is_b, g("$.CLI_MITIGATION")).otherwise(g("$.recommended_action")).alias("recommended_action"),
        F.when(is_b, bridge).otherwise(g("$.reasoning")).alias("reasoning"))


def action_gate(parsed: DataFrame, threshold: float = ACTION_CONFIDENCE) -> DataFrame:
    """Keep diagnoses above the confidence threshold as remediation actions."""
    return parsed.where(F.col("confidence_score") > threshold).select(
        *[c for c in ("event_id", "timestamp") if c in parsed.columns],
        F.lit("remediate").alias("type"),
        F.coalesce("recommended_action", F.lit(DEFAULT_ACTION)).alias("action"),
        F.coalesce("affected_service", F.lit(DEFAULT_TARGET)).alias("target"),
        F.coalesce("root_cause", F.lit(DEFAULT_REASON)).alias("reason"),
        "confidence_score")


def action_validate(parsed: DataFrame) -> DataFrame:
    """Per row: action in the allowed list, confidence within [0, 1]; a missing one is neither."""
    return parsed.select(
        "*",
        F.coalesce(F.col("recommended_action").isin(*ALLOWED_ACTIONS), F.lit(False)).alias("action_allowed"),
        F.coalesce(F.col("confidence_score").between(0.0, 1.0), F.lit(False)).alias("confidence_in_range"))


def validation_summary(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count(F.lit(1)).alias("diagnoses"),
        F.count_if(~F.col("action_allowed")).alias("bad_action"),
        F.count_if(~F.col("confidence_in_range")).alias("bad_confidence"),
        F.count_if(F.col("action_allowed") & F.col("confidence_in_range")).alias("valid"))


def prompt_render(ctx: DataFrame) -> DataFrame:
    """Context row -> diagnosis prompt text (latency 0 dp, rate in %, <= 3 similar)."""
    similar = F.array_join(F.transform(F.slice(F.col("similar"), 1, 3),
                                       lambda s: F.concat(F.lit("- "), s)), "\n")
    text = F.format_string(
        "Incident on %s\nLatency: %.0f ms\nError rate: %.2f%%\nCausal chain: %s\nRecent logs:\n%s\n"
        "Similar incidents:\n%s\nAnswer with a JSON diagnosis.",
        F.col("service"), F.col("avg_latency"), F.col("error_rate_norm") * 100, F.col("causal_chain"),
        F.col("recent_messages"), similar)
    return ctx.select("service", text.alias("prompt"))
