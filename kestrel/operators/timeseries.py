"""Windows and time series over logs.

No operator here runs an unpartitioned window over raw logs.  Trailing
per-row counts are rank differences over one point per distinct (key,
microsecond), looked up in one-second cells (``kestrel.functions.scans``),
and cooldown folds bounded segments, so neither a hot service nor a hot
bucket or timestamp lands in one task.  Every operator has one plan,
whatever the size of its input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.fixed import (BURST_MIN_ERRORS, BURST_WINDOW_MINUTES, COOLDOWN_SECONDS,
                           FORECAST_MIN_ROWS, FORECAST_STEP_SECONDS, FORECAST_STEPS, SLO_MS,
                           TREND_FACTOR)
from kestrel.functions.exprs import epoch_micros
from kestrel.functions.scans import count_at_or_before, join_on, key_codes, ranks_in_order
from kestrel.session import materialize

US = 1_000_000
DAY_S = 86400.0


def trailing_count(df: DataFrame, window_us: int, keys: list[str] | None = None,
                   ts: str = "timestamp", cell_us: int | None = None) -> DataFrame:
    """Rows of ``df`` with the count of rows of the same key in (t - w, t].

    A NULL key is a key; a row without a time is in no window and counts 0.

    count(t - w, t] = R(t) - R(t - w), where R(x) is the number of rows of
    the key at time <= x.  Rows are collapsed to one point per distinct
    (key, microsecond) with its multiplicity (partial + final aggregate); both
    lookups of every point are answered by ``ranks_in_order`` over one range
    exchange, however many rows a key, a window or a single timestamp holds
    (``cell_us``: by ``count_at_or_before`` in cells of that many
    microseconds).  Counts go back to the rows by an equi-join on (key, time),
    whose skewed keys AQE splits.
    """
    rows = df.withColumn("_t", epoch_micros(F.col(ts)))
    if not keys:                        # all rows are one key, as hot as a key can be
        keys, rows = ["_all"], rows.withColumn("_all", F.lit(0))
    pts = rows.where(F.col("_t").isNotNull()).groupBy(*keys, "_t").agg(F.count(F.lit(1)).alias("_c"))
    looks = pts.select(*keys, (F.col("_t") - window_us).alias("_x"), F.col("_t").alias("_o"))
    r = count_at_or_before(pts, looks, keys, cell_us) if cell_us else ranks_in_order(pts, looks, keys)
    # A point's rank counts for its own time, a lookup's against the time that asked.
    asked = F.col("_probe") == 1
    cnt = r.groupBy(*keys, F.when(asked, F.col("_o")).otherwise(F.col("_x")).alias("_t")).agg(
        F.sum(F.when(asked, -F.col("_r")).otherwise(F.col("_r"))).alias("window_count"))
    out = join_on(rows, cnt, [*keys, "_t"], "left")
    return out.select(*df.columns, F.coalesce("window_count", F.lit(0)).alias("window_count"))


def error_burst(logs: DataFrame, minutes: int = BURST_WINDOW_MINUTES,
                min_errors: int = BURST_MIN_ERRORS, per_service: bool = True) -> DataFrame:
    """Per error: errors in the trailing ``minutes`` (strict cutoff); anomaly if > min."""
    errors = logs.where(F.col("error_count") >= 1).select("event_id", "timestamp", "service")
    keys = ["service"] if per_service else []
    out = trailing_count(errors, minutes * 60 * US, keys)
    return out.select("event_id", "timestamp", "service",
                      F.col("window_count").alias("errors_in_window"),
                      (F.col("window_count") > min_errors).alias("anomaly"))


def burst_sliding(logs: DataFrame, minutes: int = BURST_WINDOW_MINUTES, slide_minutes: int = 1,
                  min_errors: int = BURST_MIN_ERRORS) -> DataFrame:
    """Sliding event-time windows with more than ``min_errors`` errors."""
    errors = logs.where(F.col("error_count") >= 1)
    win = F.window("timestamp", f"{minutes} minutes", f"{slide_minutes} minutes")
    return (errors.groupBy(win.alias("w")).agg(F.count(F.lit(1)).alias("errors"))
            .where(F.col("errors") > min_errors)
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "errors"))


OPEN, STEP, FIRED, LAST = range(4)      # rows of the first pass of the cooldown
MAX_RANGES = 10_000


def cooldown(candidates: DataFrame, seconds: int = COOLDOWN_SECONDS, key: str = "service",
             ts: str = "timestamp", order_id: str = "event_id",
             segment_points: int | None = None, last: DataFrame | None = None) -> DataFrame:
    """Greedy firings: the first candidate fires, then the first candidate at
    least ``seconds`` after the last firing, and so on (per key).

    A NULL key is a key; a candidate without a time never fires; of
    candidates at one time the smallest id may fire.  ``last`` (key,
    last_us) gives the last firing of a key before these candidates.

    Exact, one plan at every size, and no unbounded group.  Candidates are
    collapsed to one point per (key, microsecond), dealt out by ranges of (key,
    time) and sorted.  A key that begins in a range fires there at once.  Only
    a range's first key may have fired before it: what a range hands on of that key (the
    time from which the next candidate may fire) is a step function of what
    it is handed, with few steps, since greedy runs soon join.  The ranges' steps
    (a few rows a range) are chased in order per key, and a second pass over
    the first keys' points fills in their firings.  ``segment_points`` asks
    for ranges of about so many points (default: as many ranges as shuffles have).
    """
    c_us = int(seconds) * US
    points = (candidates.select(F.col(key).alias("_k"), F.col(order_id).alias("_n"), F.col(ts).alias("_ts"),
                                epoch_micros(F.col(ts)).alias("_t"))
              .where(F.col("_t").isNotNull())
              .groupBy("_k", "_t").agg(F.min("_n").alias("_n"), F.first("_ts").alias("_ts")))
    if last is not None:
        start = last.select(F.col(key).alias("_k"), (F.col("last_us") + c_us).alias("_from"))
        points = join_on(points, start, ["_k"], "left").where(F.col("_from").isNull() | (F.col("_t") >= F.col("_from"))).drop("_from")
    ranges = []
    if segment_points:
        points = materialize(points, "cooldown")
        ranges = [min(MAX_RANGES, max(1, -(-points.count() // segment_points)))]
    kind = {f.name: f.dataType.simpleString() for f in points.schema}
    columns = f"_k {kind['_k']}, _t long, _n {kind['_n']}, _ts {kind['_ts']}"

    def first_pass(batches):
        part, held = TaskContext.get().partitionId(), [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0].select(["_k", "_t", "_n", "_ts"])
        run = key_codes(rows, ["_k"])
        cuts = np.append(np.flatnonzero(np.append(True, run[1:] != run[:-1])), len(run))
        t = rows.column("_t").to_numpy()

        def out(at, state, upto=None, handed=None):
            own = rows.take(pa.array(at))
            return pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(np.full(len(at), part, np.int32)), pa.array(np.full(len(at), state, np.int32)),
                 pa.array(upto, pa.int64()) if upto is not None else pa.nulls(len(at), pa.int64()),
                 pa.array(handed, pa.int64()) if handed is not None else pa.nulls(len(at), pa.int64())],
                names=["_k", "_t", "_n", "_ts", "_part", "_state", "upto", "out"])
        first = t[:cuts[1]]
        yield out(np.arange(cuts[1]), OPEN)
        upto, handed = segment_steps(first, c_us)
        yield out(np.zeros(len(upto), np.int64), STEP, upto, handed)
        picks = [a + i for a, b in zip(cuts[1:-1], cuts[2:], strict=True) for i in greedy_chase(t[a:b], c_us)]
        if picks:
            yield out(np.array(picks), FIRED)
            yield out(np.array(picks[-1:]), LAST, handed=[t[picks[-1]] + c_us])

    dealt = points.repartitionByRange(*ranges, "_k", "_t").sortWithinPartitions("_k", "_t")
    dealt = materialize(dealt.mapInArrow(first_pass, f"{columns}, _part int, _state int, upto long, out long"), "firings")

    def chase(pdf):
        at, rows = -(1 << 62), []
        pdf = pdf.sort_values(["_part", "upto"])
        part, state, upto, out = (pdf[c].to_numpy() for c in ("_part", "_state", "upto", "out"))
        cuts = [*np.flatnonzero(np.diff(part, prepend=-1)), len(part)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if state[a] == LAST:        # the key begins in this range and goes on
                at = int(out[a])
                continue
            rows.append((part[a], at))
            i = a + int(np.searchsorted(upto[a:b], at, side="left"))
            if i < b:                   # else nothing in the range may fire
                at = int(out[i])
        return pd.DataFrame(rows, columns=["_part", "_at"])

    def fire(pdf):
        pdf = pdf.sort_values("_t")
        return pdf.iloc[greedy_chase(pdf["_t"].to_numpy(), c_us, int(pdf["_at"].iloc[0]))][["_k", "_n", "_ts"]]

    steps = dealt.where(F.col("_state").isin(STEP, LAST)).select("_k", "_part", "_state", "upto", "out")
    entry = steps.groupBy("_k").applyInPandas(chase, "_part int, _at long")
    opened = dealt.where(F.col("_state") == OPEN).select("_k", "_t", "_n", "_ts", "_part").join(entry, "_part")
    late = opened.groupBy("_part").applyInPandas(fire, dealt.select("_k", "_n", "_ts").schema)
    fired = dealt.where(F.col("_state") == FIRED).select("_k", "_n", "_ts").unionByName(late)
    return fired.select(F.col("_k").alias(key), F.col("_ts").alias("fired_at"), F.col("_n").alias(order_id))


def segment_steps(t, c_us: int):
    """What a range of sorted candidate times hands on: (upto, out), for a
    time handed to it of at most upto[i] (and above upto[i - 1]) the next
    candidate may fire at out[i].  What fired before the range did so before its
    first time, so only times less than the cooldown after that, and the
    one after them, can be the first firing."""
    n = len(t)
    nxt = np.searchsorted(t, t + c_us, side="left")
    end = np.where(nxt < n, nxt, np.arange(n))
    while (end[end] != end).any():          # doubling, until each candidate knows the last firing of its run
        end = end[end]
    entries = min(n, int(np.searchsorted(t, t[0] + c_us, side="left")) + 1)
    out = t[end[:entries]] + c_us
    keep = np.append(out[1:] != out[:-1], True)
    return t[:entries][keep], out[keep]


def greedy_chase(t, c_us: int, at: int | None = None) -> list[int]:
    """Positions of the greedy firings in sorted times ``t`` (numpy array),
    none before the time ``at``.

    Each next firing is the first time at or after the previous one +
    ``c_us`` (binary search), so the cost is O(n log n) for the search and
    O(firings) for the chase.
    """
    nxt = np.searchsorted(t, t + c_us, side="left")
    i = 0 if at is None else int(np.searchsorted(t, at, side="left"))
    picks = []
    while i < len(t):
        picks.append(i)
        i = int(nxt[i])
    return picks


# ---- forecasting -----------------------------------------------------------

def _series(df: DataFrame, by: list[str], ts: str, value: str) -> DataFrame:
    keycols = [F.col(b) for b in by] if by else [F.lit("ALL").alias("series")]
    return df.select(*keycols, epoch_micros(F.col(ts)).alias("_us"), F.col(value).cast("double").alias("_y")) \
             .where(F.col("_y").isNotNull())


def _per_series(stats: DataFrame) -> DataFrame:
    """A one-row-per-series table, written once and broadcast when a count
    shows it is small (else a shuffle join).  Left to AQE, the join would
    shuffle every row before the small side's size is known."""
    from kestrel.functions.joins import checked_broadcast

    return checked_broadcast(materialize(stats, "series"))[0]


def forecast_fit(df: DataFrame, by: list[str] | None = None, ts: str = "timestamp",
                 value: str = "latency_ms", degree: int = 2,
                 min_rows: int = FORECAST_MIN_ROWS) -> DataFrame:
    """Least-squares polynomial (degree 1 or 2) of value on time, per series.

    x is days since the series' first row.  Pass 1 finds the first, last and
    mean time per series (one row each, written once and broadcast behind a
    row-count check, so pass 2 shuffles no rows); pass 2 sums powers of the centred x
    (partial + final aggregate); the 3x3 normal equations are solved by
    Cramer's rule in columns.  Coefficients are reported in x (days since
    first); series with fewer than ``min_rows`` rows give no result.
    """
    by = by or []
    keys = by or ["series"]
    s = _series(df, by, ts, value)
    stats = s.groupBy(*keys).agg(F.min("_us").alias("t0"), F.max("_us").alias("t_last"),
                                 F.avg("_us").alias("t_mean"), F.count(F.lit(1)).alias("n"))
    j = s.join(_per_series(stats.where(F.col("n") >= min_rows)), keys)
    z = (F.col("_us") - F.col("t_mean")) / (US * DAY_S)
    sums = j.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("t0").alias("t0"), F.first("t_last").alias("t_last"),
        F.first("t_mean").alias("t_mean"),
        F.sum(z).alias("s1"), F.sum(z * z).alias("s2"), F.sum(z * z * z).alias("s3"),
        F.sum(z * z * z * z).alias("s4"), F.sum("_y").alias("sy"), F.sum(z * F.col("_y")).alias("szy"),
        F.sum(z * z * F.col("_y")).alias("szzy"))
    n, s1, s2, s3, s4 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4"))
    sy, szy, szzy = F.col("sy"), F.col("szy"), F.col("szzy")
    n_d = n.cast("double")
    if degree == 2:
        det = n_d * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2)
        a0 = (sy * (s2 * s4 - s3 * s3) - s1 * (szy * s4 - s3 * szzy) + s2 * (szy * s3 - s2 * szzy))
        a1 = (n_d * (szy * s4 - szzy * s3) - sy * (s1 * s4 - s3 * s2) + s2 * (s1 * szzy - szy * s2))
        a2 = (n_d * (s2 * szzy - s3 * szy) - s1 * (s1 * szzy - s2 * szy) + sy * (s1 * s3 - s2 * s2))
        a0, a1, a2 = F.try_divide(a0, det), F.try_divide(a1, det), F.try_divide(a2, det)
    else:
        det = n_d * s2 - s1 * s1
        a1 = F.try_divide(n_d * szy - s1 * sy, det)
        a0 = F.try_divide(sy - a1 * s1, n_d)
        a2 = F.lit(0.0)
    fit = sums.select(*keys, "n", "t0", "t_last", "t_mean",
                      a0.alias("a0"), a1.alias("a1"), a2.alias("a2"))
    c = (F.col("t_mean") - F.col("t0")) / (US * DAY_S)  # centre, in days since first
    return fit.select(
        *keys, "n", F.timestamp_micros("t0").cast("timestamp_ntz").alias("first_ts"),
        F.timestamp_micros("t_last").cast("timestamp_ntz").alias("last_ts"),
        "a0", "a1", "a2", "t0", "t_last", "t_mean",
        (F.col("a0") - F.col("a1") * c + F.col("a2") * c * c).alias("coef0"),
        (F.col("a1") - 2 * F.col("a2") * c).alias("coef1_per_day"),
        F.col("a2").alias("coef2_per_day2"))


def forecast_horizon(fit: DataFrame, keys: list[str], steps: int = FORECAST_STEPS,
                     step_seconds: int = FORECAST_STEP_SECONDS) -> DataFrame:
    """Predictions at last x + step*i seconds, i = 1..steps, per series."""
    f = fit.select(*keys, "t0", "t_last", "t_mean", "a0", "a1", "a2",
                   F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    x_s = (F.col("t_last") - F.col("t0")) / US + F.col("step") * step_seconds  # seconds since first
    z = (F.col("t0") / US + x_s - F.col("t_mean") / US) / DAY_S
    pred = F.col("a0") + F.col("a1") * z + F.col("a2") * z * z
    when = F.timestamp_micros(F.col("t0") + F.floor(x_s).cast("long") * US).cast("timestamp_ntz")
    return f.select(*keys, "step", when.alias("ts"), pred.alias("predicted"))


def slo_breach(horizon: DataFrame, keys: list[str], slo: float = SLO_MS,
               factor: float = TREND_FACTOR) -> DataFrame:
    """Max predicted value (2 dp), breach when above ``slo``, trend label."""
    h = horizon.groupBy(*keys).agg(F.max("predicted").alias("mx"),
                                   F.min_by("predicted", "step").alias("first_pred"),
                                   F.max_by("predicted", "step").alias("last_pred"))
    return h.select(*keys, F.round("mx", 2).alias("max_predicted_latency"),
                    (F.col("mx") > slo).alias("will_breach_slo"),
                    F.when(F.col("last_pred") > F.col("first_pred") * factor, "Accelerating")
                     .otherwise("Stable").alias("trend"))


def forecast_linear(df: DataFrame, by: list[str] | None = None, ts: str = "timestamp",
                    value: str = "latency_ms", min_rows: int = FORECAST_MIN_ROWS) -> DataFrame:
    """Degree-1 fit with the built-in regression aggregates (x = days since first)."""
    by = by or []
    keys = by or ["series"]
    s = _series(df, by, ts, value)
    first = _per_series(s.groupBy(*keys).agg(F.min("_us").alias("t0")))
    x = (F.col("_us") - F.col("t0")) / (US * DAY_S)
    return (s.join(first, keys).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"), F.regr_slope("_y", x).alias("slope_per_day"),
                 F.regr_intercept("_y", x).alias("intercept"))
            .where(F.col("n") >= min_rows))


def lag_panel(logs: DataFrame, edges: DataFrame, target: str,
              bucket_seconds: int = 3600, lookback_seconds: int | None = None) -> DataFrame:
    """Panel for lagged causal analysis of one target service.

    Rows = (upstream, time bucket) over a dense spine of buckets; columns =
    the upstream's mean cpu and latency in the previous bucket and the
    target's errors in the bucket.  The lag is an equi-join on the bucket
    shifted by one, so no window is needed.  With ``lookback_seconds`` only
    logs from that long before the newest one on take part.
    """
    if lookback_seconds is not None:
        newest = logs.select(F.max("timestamp")).scalar()
        logs = logs.where(F.col("timestamp") >= newest - F.expr(f"INTERVAL {int(lookback_seconds)} SECONDS"))
    b_us = bucket_seconds * US
    bucket = F.floor(epoch_micros(F.col("timestamp")) / b_us)
    per = logs.groupBy("service", bucket.alias("bucket")).agg(
        F.avg("cpu_percent").alias("cpu"), F.avg("latency_ms").alias("latency"),
        F.sum("error_count").alias("errors"))
    ups = edges.where(F.col("to_service") == target).select(F.col("from_service").alias("upstream")).distinct()
    span = logs.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi"))
    lo_hi = span.select(F.struct("lo", "hi")).scalar()          # one scalar subquery
    spine = ups.select("upstream", F.explode(F.sequence(lo_hi["lo"], lo_hi["hi"])).alias("bucket"))
    prev = per.select(F.col("service").alias("upstream"), (F.col("bucket") + 1).alias("bucket"),
                      F.col("cpu").alias("cpu_lag1"), F.col("latency").alias("latency_lag1"))
    tgt = per.where(F.col("service") == target).select("bucket", F.col("errors").alias("target_errors"))
    return (spine.join(prev, ["upstream", "bucket"], "left").join(tgt, ["bucket"], "left")
            .select("upstream",
                    F.timestamp_micros(F.col("bucket") * b_us).cast("timestamp_ntz").alias("bucket_start"),
                    F.round("cpu_lag1", 6).alias("cpu_lag1"), F.round("latency_lag1", 6).alias("latency_lag1"),
                    F.coalesce(F.col("target_errors"), F.lit(0)).cast("bigint").alias("target_errors")))


def status_timeline(logs: DataFrame, seconds: int = 10) -> DataFrame:
    """Counters per tumbling window with running totals.

    Running totals are a two-level prefix sum: within each day (window
    partitioned by day), plus the total of all earlier days (a window over
    one row per day).  No single-partition window over windows or logs.
    """
    w = logs.groupBy(F.window("timestamp", f"{seconds} seconds").alias("w")).agg(
        F.count(F.lit(1)).alias("processed"), F.sum("error_count").alias("errors"))
    w = w.select(F.col("w.start").alias("window_start"), "processed", "errors",
                 F.date_trunc("day", F.col("w.start")).alias("day"))
    within = Window.partitionBy("day").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    w = w.withColumn("p_in_day", F.sum("processed").over(within)) \
         .withColumn("e_in_day", F.sum("errors").over(within))
    days = w.groupBy("day").agg(F.sum("processed").alias("dp"), F.sum("errors").alias("de"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("day", F.coalesce(F.sum("dp").over(before), F.lit(0)).alias("p_before"),
                       F.coalesce(F.sum("de").over(before), F.lit(0)).alias("e_before"))
    return w.join(days, "day").select(
        "window_start", "processed", F.col("errors").cast("bigint").alias("errors"),
        (F.col("p_in_day") + F.col("p_before")).alias("processed_total"),
        (F.col("e_in_day") + F.col("e_before")).cast("bigint").alias("errors_total"))
