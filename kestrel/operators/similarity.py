"""Similarity search, context assembly and scenario rules.

Exact kNN: a query set that is small in rows and bytes is broadcast; cosine
similarity is computed JVM-side with zip_with/aggregate; the top n per query is
a row_number filter, which Spark plans as a partial WindowGroupLimit before the
shuffle, so only n rows per query leave each task.  Larger query sets meet the
corpus in blocks (``knn_blocks``), with the same result.  ``ann`` has the index.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.functions.blocks import BLOCK_BYTES, QUERY_GROUP, block_product, matrix, row_dot
from kestrel.functions.exprs import cosine_similarity, dot
from kestrel.functions.joins import BROADCAST_MAX_ROWS, checked_broadcast, fits_broadcast
from kestrel.operators import ann, textsearch
from kestrel.session import materialize


def _topn(pairs: DataFrame, n: int) -> DataFrame:
    """Ranked on the raw score; rounded only in the result."""
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("vec_id"))
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .withColumn("similarity", F.round("similarity", 6)))


def knn(corpus: DataFrame, queries: DataFrame, n: int = 5, filter_col: str | None = "label",
        exclude_self: bool = True, vec: str = "embedding", id_col: str = "vec_id",
        max_broadcast_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """n nearest corpus rows by cosine similarity for every query.

    ``queries``: (query_id, query_vec[, query_filter]).  With ``filter_col``
    the corpus is restricted to rows whose ``filter_col`` equals the query's
    filter value (an equi-join key).  Returns query_id, rank, vec_id,
    similarity (rounded to 6 dp; ties broken by vec_id).
    """
    # Without a filter every query is compared with every corpus row (exact
    # kNN); a constant key keeps that a broadcast hash join of the checked
    # query set.
    small, _ = fits_broadcast(queries, max_broadcast_rows)
    if not small:
        return knn_blocks(corpus, queries, n, filter_col, exclude_self, vec, id_col)
    c = corpus.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("vec"),
                      (F.col(filter_col) if filter_col else F.lit(0)).alias("fkey"))
    if not filter_col:
        queries = queries.withColumn("query_filter", F.lit(0))
    pairs = c.join(F.broadcast(queries), c["fkey"] == queries["query_filter"], "inner")
    if exclude_self:
        pairs = pairs.where(F.col("vec_id") != F.col("query_id"))
    pairs = pairs.select("query_id", "vec_id", cosine_similarity(F.col("vec"), F.col("query_vec")).alias("similarity"))
    return _topn(pairs.where(F.col("similarity").isNotNull() & ~F.isnan("similarity")), n)


def knn_blocks(corpus: DataFrame, queries: DataFrame, n: int = 5, filter_col: str | None = "label",
               exclude_self: bool = True, vec: str = "embedding", id_col: str = "vec_id",
               block_bytes: int = BLOCK_BYTES, query_group: int = QUERY_GROUP) -> DataFrame:
    """``knn`` for any number of queries: blocks of the corpus are held as matrices, queries stream past them in Arrow
    batches, a matrix product finds what may be among each query's n best of a block, and the bests are merged.

    The corpus and the queries are read once; a task holds at most
    ``block_bytes`` of vectors.  What the product leaves is scored again as Spark
    sums it, so that equal vectors tie and results are those of ``knn``.
    """
    dim = queries.agg(F.max(F.size("query_vec"))).first()[0] or 1
    dim = max(1, dim)
    rows = corpus.where(ann.defined(F.col(vec), dim)).select(
        (F.col(filter_col).cast("string") if filter_col else F.lit("")).alias("grp"), F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    asks = queries.where(ann.defined(F.col("query_vec"), dim)).select(
        (F.col("query_filter").cast("string") if filter_col else F.lit("")).alias("grp"), "query_id", "query_vec")

    def make():
        def hold(t):
            ids, x = t.column("id").to_numpy(), matrix(t.column("vec"), dim)
            norm = np.sqrt(row_dot(x, x))
            keep = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            keep = keep[np.argsort(ids[keep], kind="stable")]
            return ids[keep], x[keep], norm[keep], x[keep] / norm[keep, None]

        def meet(state, b):
            ids, x, norm, units = state
            if not len(ids):
                return
            step = max(1, block_bytes // (8 * len(ids)))
            for at in range(0, b.num_rows, step):
                piece = b.slice(at, step)
                names, q = piece.column("query_id").to_numpy(), matrix(piece.column("query_vec"), dim)
                q_norm = np.sqrt(row_dot(q, q))
                good = np.flatnonzero(np.isfinite(q_norm) & (q_norm > 0))
                names, q, q_norm = names[good], q[good], q_norm[good]
                scores = (q / q_norm[:, None]) @ units.T
                if exclude_self:
                    lo, hi = np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right")
                    for i in np.flatnonzero(hi > lo):
                        scores[i, lo[i]:hi[i]] = -np.inf
                floor = np.full(len(names), -2.0)
                if len(ids) >= n:
                    floor = np.maximum(floor, np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n] - ann.SLACK)
                qi, ri = np.nonzero(scores >= floor[:, None])
                exact = row_dot(x[ri], q[qi]) / (norm[ri] * q_norm[qi])
                order = np.lexsort((ids[ri], -exact, qi))
                qi, ri, exact = qi[order], ri[order], exact[order]
                first = np.searchsorted(qi, qi)
                best = np.arange(len(qi)) - first < n
                yield pa.RecordBatch.from_arrays([pa.array(names[qi[best]]), pa.array(ids[ri[best]]), pa.array(exact[best])],
                                                 names=["query_id", "vec_id", "similarity"])
        return hold, meet

    found = block_product(rows, asks, make, "query_id long, vec_id long, similarity double", max(1, block_bytes // (8 * dim)), query_group)
    return _topn(found, n)


def latest_per_label(corpus: DataFrame, label: str = "label", vec: str = "embedding",
                     id_col: str = "vec_id") -> DataFrame:
    """The newest item of each label, as incident queries (one per label)."""
    newest = F.max_by(F.struct(F.col(id_col).alias("query_id"), F.col(vec).alias("query_vec")), id_col)
    return (corpus.groupBy(F.col(label).alias("query_filter")).agg(newest.alias("q"))
            .select("q.query_id", "q.query_vec", "query_filter"))


def latest_overall(corpus: DataFrame, label: str = "label", vec: str = "embedding",
                   id_col: str = "vec_id") -> DataFrame:
    newest = F.max_by(F.struct(F.col(id_col).alias("query_id"), F.col(vec).alias("query_vec"),
                               F.col(label).alias("query_filter")), id_col)
    return corpus.agg(newest.alias("q")).select("q.*")


def lsh_keys(vec, dim: int, bits: int, num_tables: int, seed: int):
    """One key per table: the signs of ``bits`` random projections, packed."""
    planes = np.random.default_rng(seed).normal(size=(num_tables, bits, dim))

    def code(rows):
        out = F.lit(0)
        for i, plane in enumerate(rows):
            side = dot(vec, F.array(*[F.lit(float(x)) for x in plane])) >= 0
            out = out + F.when(side, 1 << i).otherwise(0)
        return out
    return F.array(*[F.struct(F.lit(t).alias("table"), code(rows).alias("code")) for t, rows in enumerate(planes)])


def knn_lsh(corpus: DataFrame, queries: DataFrame, n: int = 5, dim: int = 64, bits: int = 2, num_tables: int = 10,
            seed: int = 7, filter_col: str = "label", vec: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Approximate kNN within the query's filter value: sign-projection LSH, exact re-rank.

    Rows meet where one of ``num_tables`` keys of ``bits`` signs and the
    filter value agree, so a bucket is a 2^-bits part of a filter value's
    rows (more bits for a larger corpus, more tables for recall).  The query
    set is broadcast behind a count, so only colliding pairs are shuffled.
    A query that collides with fewer than ``n`` rows is answered by the
    exact search, so every query gets ``n`` rows where there are that many.
    """
    c = corpus.select(F.col(id_col).alias("vec_id"), F.col(vec).alias("vec"), F.col(filter_col).alias("fkey"))
    q_small, _ = checked_broadcast(queries.select("query_id", "query_vec", "query_filter", F.explode(
        lsh_keys(F.col("query_vec"), dim, bits, num_tables, seed)).alias("k")))
    rows = c.select("*", F.explode(lsh_keys(F.col("vec"), dim, bits, num_tables, seed)).alias("ck"))
    met = rows.join(q_small, (F.col("ck") == F.col("k")) & (F.col("fkey") == F.col("query_filter"))
                    & (F.col("vec_id") != F.col("query_id")))
    pairs = (met.select("query_id", "vec_id", cosine_similarity(F.col("vec"), F.col("query_vec")).alias("similarity"))
             .groupBy("query_id", "vec_id").agg(F.first("similarity").alias("similarity")))
    found = materialize(_topn(pairs, n), "lsh")
    full = found.groupBy("query_id").count().where(F.col("count") >= n).select("query_id")
    rest = queries.join(full, "query_id", "left_anti")
    exact = knn(corpus, rest, n, filter_col, vec=vec, id_col=id_col)
    return found.join(full, "query_id").unionByName(exact.select(*found.columns))


def text_embed(docs: DataFrame, text: str = "text", id_col: str = "doc_id", dim: int = 384) -> DataFrame:
    """Sentence -> fixed-width vector with a distributed TF-IDF pipeline.

    Tokenise, hash term counts into ``dim`` slots, weight by IDF (one
    aggregation pass to fit), L2-normalise, and return an array column.
    ``encoding.encode_texts`` takes an encoder of the user's instead.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tok", pattern="(?U)\\W+", toLowercase=True),
        HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0)])
    src = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias(text))
    model = pipe.fit(src)
    return model.transform(src).select(id_col, vector_to_array("_unit", "float32").alias("embedding"))


# ---- scenario rules ---------------------------------------------------------

RULE_SCHEMA = ("rule_id string, service string, min_latency double, lock_below double, "
               "min_lock double, min_pool double, diagnosis string, expected_action string, priority int")

# Fixture thresholds scaled to the logs view (FIXTURES §4); the reference
# thresholds are in REFERENCE_RULES.
FIXTURE_RULES = [
    ("T-01", "api-gateway", 400.0, 5.0, None, None, "Ingress Congestion", "scale_up", 1),
    ("T-02", "payment-db", None, None, 4.0, None, "Database Row Locking", "investigate_db", 2),
    ("T-03", "redis-cache", 300.0, None, None, None, "Cache Eviction Pressure", "scale_up", 3),
    ("T-04", "user-service", None, None, None, 200.0, "Connection Pool Exhaustion", "increase_pool", 4),
]
REFERENCE_RULES = [
    ("T-01", "api-gateway", 4000.0, 0.000001, None, None, "Ingress Congestion", "scale_up", 1),
    ("T-02", "payment-db", None, None, 800.000001, None, "Database Row Locking", "investigate_db", 2),
    ("T-03", "redis-cache", 1000.0, 0.000001, None, None, "Cache Eviction Pressure", "scale_up", 3),
    ("T-04", "user-service", None, 100.000001, None, 500.0, "Connection Pool Exhaustion", "increase_pool", 4),
]


def rules_frame(spark: SparkSession, rules=None) -> DataFrame:
    return spark.createDataFrame(rules or FIXTURE_RULES, RULE_SCHEMA)


def scenario_match(logs: DataFrame, rules: DataFrame) -> DataFrame:
    """Best-priority scenario rule matching each log.

    The rules are a fixed handful: they become one literal array in order of
    priority, and the first that fits is taken in the projection, so no log
    is shuffled.
    """
    kinds = dict(rules.dtypes)
    rows = sorted(rules.collect(), key=lambda r: r["priority"])
    table = F.array(*[F.struct(*[F.lit(r[c]).cast(kinds[c]).alias(c) for c in kinds]) for r in rows])

    def fits(r):
        return ((r["service"] == F.col("service"))
                & (r["min_latency"].isNull() | (F.col("latency_ms") >= r["min_latency"]))
                & (r["lock_below"].isNull() | (F.col("db_lock_time") < r["lock_below"]))
                & (r["min_lock"].isNull() | (F.col("db_lock_time") >= r["min_lock"]))
                & (r["min_pool"].isNull() | (F.col("pool_wait_ms") >= r["min_pool"])))
    best = F.get(F.filter(table, fits), F.lit(0))
    return (logs.select("event_id", "service", best.alias("b")).where(F.col("b").isNotNull())
            .select("event_id", "service", "b.rule_id", "b.diagnosis", "b.expected_action"))


def scenario_eval(matches: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """Per scenario: matched incidents, diagnosed ones, passes, pass rate."""
    j = matches.join(diagnoses.select("event_id", "recommended_action"), "event_id", "left")
    return j.groupBy("rule_id").agg(
        F.count(F.lit(1)).alias("incidents"),
        F.count("recommended_action").alias("diagnosed"),
        F.count_if(F.col("recommended_action") == F.col("expected_action")).alias("passed"),
    ).withColumn("pass_rate", F.round(F.try_divide(F.col("passed"), F.col("diagnosed")), 6))


class IncidentIndex(NamedTuple):
    """The index of the past errors' distinct messages per service, and the newest incidents of each message."""
    messages: textsearch.Index
    incidents: DataFrame


def incident_index(logs: DataFrame, before, keep: int = 3) -> IncidentIndex:
    """Past errors (not after ``before``), to be searched by message: a message of a service is one text, whatever its
    incidents; the ``keep`` newest of them stand for it.  Written tables, to be built once and searched often."""
    past = logs.where((F.col("error_count") >= 1) & (F.col("timestamp") <= before) & F.col("service").isNotNull())
    past = past.select("service", F.coalesce("message", F.lit("")).alias("message"), "timestamp", "event_id")
    w = Window.partitionBy("service", "message").orderBy(F.col("timestamp").desc(), F.col("event_id").desc())
    newest = past.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")
    newest = materialize(newest, "incidents")
    texts = newest.groupBy(F.col("service").alias("fkey"), F.col("message").alias("id")).agg(
        F.max(F.struct("timestamp", "event_id")).alias("newest")).withColumn("text", F.col("id"))
    return IncidentIndex(textsearch.build(texts), newest)


def similar_incidents(index: IncidentIndex, queries: DataFrame, k: int = 3) -> DataFrame:
    """(service, rank, message, timestamp, event_id, score): the ``k`` past incidents of the service whose message is most
    similar to the query's, newer ones first among equals.  ``queries``: (service, message), one per service."""
    asked = queries.select(F.col("service").alias("query_id"), F.col("service").alias("fkey"), F.col("message").alias("text"))
    # The k best incidents are among those of the k best messages, which tie by their newest incident.
    best, _ = textsearch.search(index.messages, asked, k)
    found = best.select(F.col("fkey").alias("service"), F.col("id").alias("message"), "score").join(index.incidents, ["service", "message"])
    w = Window.partitionBy("service").orderBy(F.col("score").desc(), F.col("timestamp").desc(), F.col("event_id").desc())
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("service", "rank", "message", "timestamp", "event_id", "score"))


def incident_context(logs: DataFrame, now, minutes: int, ate: DataFrame, k_messages: int = 5,
                     k_similar: int = 3, index: IncidentIndex | None = None) -> DataFrame:
    """One context row per service with recent errors.

    Latest error telemetry, mean latency and error count over the recent
    window, the newest distinct messages, the causal-chain text with the
    effect estimate, the service's past incidents (errors before the window
    whose message is most similar to the latest error's, through ``index``,
    default: one built for it), and whether it holds the newest error overall.  Every part is
    an aggregate keyed by service; the joins are between one-row-per-service
    frames.
    """
    from kestrel.operators.aggregates import distinct_messages
    from kestrel.operators.clean import recent_errors
    from kestrel.operators.rules import causal_chain

    cutoff = now - F.expr(f"INTERVAL {int(minutes)} MINUTES")
    recent = recent_errors(logs, minutes, now)
    order = F.struct("timestamp", "event_id")
    latest = recent.groupBy("service").agg(
        F.max_by(F.struct("event_id", "timestamp", "latency_ms", "db_lock_time", "pool_wait_ms", "message"), order).alias("l"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.count(F.lit(1)).alias("error_total"))
    msgs = (distinct_messages(recent, k=k_messages, newest_first=True)
            .groupBy("service").agg(F.array_join(F.transform(
                F.array_sort(F.collect_list(F.struct("position", "message"))), lambda x: x["message"]), " | ")
                .alias("recent_messages")))
    near = similar_incidents(index or incident_index(logs, cutoff, k_similar), latest.select("service", F.col("l.message").alias("message")), k_similar)
    told = F.concat(F.col("message"), F.lit(" @ "), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    past = near.groupBy("service").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", told.alias("m")))), lambda x: x["m"]).alias("similar"))
    target = recent.select(F.max_by("service", order)).scalar()
    ate_value = ate.select("ate").scalar()
    return (latest.join(msgs, "service", "left").join(past, "service", "left")
            .select("service", (F.col("service") == target).alias("is_target"),
                    F.col("l.timestamp").alias("latest_ts"), F.col("l.latency_ms").alias("latest_latency"),
                    F.col("l.db_lock_time").alias("latest_lock"), F.col("l.pool_wait_ms").alias("latest_pool"),
                    F.col("l.message").alias("latest_message"), "avg_latency", "error_total",
                    (F.col("error_total") / 100.0).alias("error_rate_norm"), "recent_messages",
                    causal_chain(F.col("service"), ate_value).alias("causal_chain"),
                    F.coalesce(F.col("similar"), F.array().cast("array<string>")).alias("similar")))
