"""Temporal service graph as a fact table of edge observations.

``edges(from_service, to_service, ts, latency_ms, cpu_percent,
memory_percent, seq)``; ``seq`` is arrival order.  Latest-per-key views are
aggregates (max_by), caps are row_number filters that Spark turns into a
partial WindowGroupLimit before the shuffle, and graph walks run over the
distinct edge set (one row per edge, not per observation).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from kestrel.fixed import (EDGE_KEEP, GLOBAL_KEEP, MATCH_TOLERANCE_SECONDS,
                           NEIGHBOR_WINDOW_SECONDS, PRUNE_SECONDS, TTL_SECONDS)
from kestrel.functions.exprs import epoch_micros
from kestrel.functions.scans import join_on
from kestrel.session import materialize
from kestrel.sources.files import by_date


def edge_append(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Append observations to a Parquet table partitioned by date; return the table."""
    by_date(batch.withColumn("dt", F.to_date("ts"))).write.mode("append").partitionBy("dt").parquet(path)
    return spark.read.schema(batch.schema.add("dt", "date")).parquet(path).drop("dt")


def topology_edges(edges: DataFrame) -> DataFrame:
    """Distinct directed edges with their observation counts."""
    return edges.groupBy("from_service", "to_service").agg(
        F.count(F.lit(1)).alias("observations"), F.max("ts").alias("last_ts"))


def topology_nodes(edges: DataFrame) -> DataFrame:
    """Nodes = sources and targets, with out- and in-degree in distinct edges."""
    e = edges.select("from_service", "to_service").distinct()
    outs = e.groupBy(F.col("from_service").alias("service")).agg(F.count(F.lit(1)).alias("out_degree"))
    ins = e.groupBy(F.col("to_service").alias("service")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (outs.join(ins, "service", "full_outer")
            .select("service", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).alias("in_degree")))


def node_state(edges: DataFrame) -> DataFrame:
    """Latest cpu / memory / time per source service; last arrival wins."""
    latest = F.max_by(F.struct("cpu_percent", "memory_percent", "ts"), "seq")
    return (edges.where(F.col("cpu_percent").isNotNull())
            .groupBy(F.col("from_service").alias("service")).agg(latest.alias("s"))
            .select("service", F.col("s.cpu_percent").alias("current_cpu"),
                    F.col("s.memory_percent").alias("current_memory"),
                    F.col("s.ts").alias("last_updated")))


def causal_neighbors(edges: DataFrame, service: str, now: Column,
                     window_seconds: float = NEIGHBOR_WINDOW_SECONDS) -> DataFrame:
    """Observations into ``service`` with ts >= now - window (inclusive), by upstream."""
    cutoff = now - F.make_dt_interval(secs=F.lit(float(window_seconds)))
    return (edges.where((F.col("to_service") == service) & (F.col("ts") >= cutoff))
            .select(F.col("from_service").alias("upstream"), "ts", "latency_ms",
                    F.col("cpu_percent").alias("cpu_from"), F.col("memory_percent").alias("mem_from"),
                    "seq"))


def neighbor_summary(neighbors: DataFrame) -> DataFrame:
    """Per upstream: observations in the window, mean latency, newest time."""
    return neighbors.groupBy("upstream").agg(
        F.count(F.lit(1)).alias("observations"), F.round(F.avg("latency_ms"), 6).alias("avg_latency"),
        F.max("ts").alias("last_ts"))


def prune_edges(edges: DataFrame, now: Column, max_age_seconds: float = PRUNE_SECONDS) -> DataFrame:
    """Keep observations strictly newer than now - max_age; empty edges vanish."""
    cutoff = now - F.make_dt_interval(secs=F.lit(float(max_age_seconds)))
    return edges.where(F.col("ts") > cutoff)


def ttl_view(edges: DataFrame, now: Column, ttl_seconds: float = TTL_SECONDS) -> DataFrame:
    """Edges whose newest observation is within the TTL."""
    cutoff = now - F.make_dt_interval(secs=F.lit(float(ttl_seconds)))
    return topology_edges(edges).where(F.col("last_ts") >= cutoff)


def edge_last_n(edges: DataFrame, n: int = EDGE_KEEP) -> DataFrame:
    """Newest ``n`` observations per edge (arrival order)."""
    w = Window.partitionBy("from_service", "to_service").orderBy(F.col("seq").desc())
    return edges.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= n)


def global_last_n(edges: DataFrame, n: int = GLOBAL_KEEP, slice_rows: int = 4096) -> DataFrame:
    """Newest ``n`` observations overall (by arrival order).

    Two steps: counts per slice of ``slice_rows`` arrival numbers (partial +
    final aggregate) give the first slice that can hold one of the newest
    ``n``; only rows from there on are ordered, so the last task sees little
    more than ``n`` rows however many tasks scan the table.
    """
    slices = edges.where(F.col("seq").isNotNull()).groupBy(F.floor(F.col("seq") / slice_rows).alias("s")).count()
    newest = slices.orderBy(F.col("s").desc()).limit(n).collect()        # n numbers at most
    total, cut = 0, None
    for r in newest:
        total, cut = total + r["count"], r["s"]
        if total >= n:
            break
    if total >= n:
        edges = edges.where(F.col("seq") >= cut * slice_rows)
    return edges.orderBy(F.col("seq").desc_nulls_last()).limit(n)


def k_hop(edges: DataFrame, target: str, k: int = 2, upstream: bool = True) -> DataFrame:
    """Services within ``k`` hops of ``target``, with the fewest hops.

    Runs over the distinct edge set; each hop is one join with the frontier,
    deduplicated per hop, so cycles and self-loops cannot loop (SURVEY T10).
    """
    src, dst = ("from_service", "to_service") if upstream else ("to_service", "from_service")
    e = edges.select(F.col(src).alias("nbr"), F.col(dst).alias("node")).distinct()
    frontier = e.where(F.col("node") == target).select(F.col("nbr").alias("service")).distinct() \
                .withColumn("hop", F.lit(1))
    result = frontier
    for hop in range(2, k + 1):
        frontier = (frontier.select(F.col("service").alias("node")).join(e, "node")
                    .select(F.col("nbr").alias("service")).distinct().withColumn("hop", F.lit(hop)))
        result = result.unionByName(frontier)
    return (result.where(F.col("service") != target)
            .groupBy("service").agg(F.min("hop").alias("hop")))


def reachability(edges: DataFrame) -> DataFrame:
    """Transitive closure (ancestor, descendant, fewest hops) of the edge set.

    Semi-naive iteration over the distinct edge set, written once: each round
    joins only the pairs found in the previous round and writes only what is
    new, until a round adds nothing (no cap on rounds).
    """
    e = materialize(edges.select(F.col("from_service").alias("a"), F.col("to_service").alias("b"))
                    .where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edge_set")
    step = e.select(F.col("a").alias("m"), F.col("b"))
    closure = delta = e.withColumn("hops", F.lit(1))
    hops = 1
    while not delta.isEmpty():
        hops += 1
        found = delta.select("a", F.col("b").alias("m")).join(step, "m").select("a", "b").distinct()
        delta = materialize(found.join(closure.select("a", "b"), ["a", "b"], "left_anti")
                            .withColumn("hops", F.lit(hops)), "closure")
        closure = closure.unionByName(delta)
    return closure.select(F.col("a").alias("ancestor"), F.col("b").alias("descendant"), "hops")


def ancestors(edges: DataFrame, target: str) -> DataFrame:
    """Every service from which ``target`` can be reached (its ancestors alone, not the whole closure)."""
    e = materialize(edges.select(F.col("from_service").alias("a"), F.col("to_service").alias("b"))
                    .where(F.col("a").isNotNull() & F.col("b").isNotNull()).distinct(), "edge_set")
    found = delta = e.where(F.col("b") == target).select("a").distinct()
    while not delta.isEmpty():
        step = delta.select(F.col("a").alias("b")).join(e, "b").select("a").distinct()
        delta = materialize(step.join(found, "a", "left_anti"), "ancestors")
        found = found.unionByName(delta)
    return found.select(F.col("a").alias("ancestor"))


def dag_confounders(dag: DataFrame, treatment: str, outcome: str) -> DataFrame:
    """Common ancestors of treatment and outcome, given a (cause, effect) DAG.

    An ancestor of the outcome counts only through a path that avoids the
    treatment, so mediators' own causes downstream of the treatment are not
    confounders.
    """
    e = dag.select(F.col("cause").alias("from_service"), F.col("effect").alias("to_service"))
    e_wo = e.where((F.col("from_service") != treatment) & (F.col("to_service") != treatment))
    return (ancestors(e, treatment).join(ancestors(e_wo, outcome), "ancestor").distinct()
            .withColumnRenamed("ancestor", "confounder"))


def edge_obs_match(log: DataFrame, store: DataFrame,
                   tolerance_seconds: float = MATCH_TOLERANCE_SECONDS,
                   bucket_seconds: float = 1.0) -> DataFrame:
    """Match each global-log row to the first stored observation on its edge
    within the tolerance (|dt| < tol), first by arrival order (seq), with
    the number of candidates.

    A range-framed window, not a join, so no pairs are emitted.  Both sides
    are first collapsed to one point per (edge, microsecond): store points
    carry min(seq) and their row count, log points are distinct (partial +
    final aggregates, so repeated timestamps combine map-side).  Points are
    partitioned by (edge, time bucket) and ordered by time; min and sum
    over store points in the frame (-tol, +tol) give the answer.  Store
    points within the tolerance of a bucket edge are copied into the
    neighbouring bucket, so the result is exact (tol < bucket) and no
    partition holds more than a bucket's worth of distinct timestamps on
    each side, however hot an edge or a second is.  Answers go back to the
    log rows by an equi-join on (edge, time), whose skewed keys AQE splits.
    """
    tol_us = int(round(tolerance_seconds * 1_000_000))
    b_us = int(round(bucket_seconds * 1_000_000))
    assert tol_us < b_us
    edge = ["from_service", "to_service"]
    lrows = log.select(*edge, epoch_micros(F.col("ts")).alias("_t"), F.col("seq").alias("log_seq"))
    l = (lrows.select(*edge, "_t").distinct()
         .select(*edge, "_t", F.lit(None).cast("long").alias("_s"), F.lit(None).cast("long").alias("_n"),
                 F.lit(True).alias("_probe"), F.floor(F.col("_t") / b_us).alias("_b")))
    st = (store.select(*edge, epoch_micros(F.col("ts")).alias("_t"), "seq")
          .groupBy(*edge, "_t").agg(F.min("seq").alias("_s"), F.count(F.lit(1)).alias("_n")))
    st = st.withColumn("_b0", F.floor(F.col("_t") / b_us))
    near_lo = F.col("_t") - F.col("_b0") * b_us < tol_us
    near_hi = (F.col("_b0") + 1) * b_us - F.col("_t") < tol_us
    st = (st.select("*", F.explode(F.array(
        F.col("_b0"),
        F.when(near_lo, F.col("_b0") - 1),
        F.when(near_hi, F.col("_b0") + 1))).alias("_b")).where(F.col("_b").isNotNull())
        .select(*edge, "_t", "_s", "_n", F.lit(False).alias("_probe"), "_b"))
    w = (Window.partitionBy(*edge, "_b").orderBy("_t")
         .rangeBetween(-(tol_us - 1), tol_us - 1))
    m = (l.unionByName(st)
         .select(*edge, "_t", "_probe", F.min("_s").over(w).alias("matched_seq"),
                 F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("candidates"))
         .where(F.col("_probe") & (F.col("candidates") > 0))
         .drop("_probe"))
    return join_on(lrows, m, [*edge, "_t"]).select("log_seq", "matched_seq", "candidates")
