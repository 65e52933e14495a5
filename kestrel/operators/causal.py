"""Causal and statistical operators from distributed sufficient statistics.

One pass over the data computes, per service, the count and the centred
cross-products S_ab = n * covar_pop(a, b) (Spark merges co-moments
pairwise, so no cancellation of raw power sums).  Every estimator below is
a closed form over those few rows: the shuffle carries one row per service
per map task, independent of data size (SURVEY §2.7, §7 closed forms).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.fixed import CAUSAL_EDGES, CONFOUNDER, METRICS, OUTCOME, TREATMENT
from kestrel.functions.exprs import epoch_micros, normal_two_sided_p
from kestrel.functions.scans import join_on

Z_CRIT = 1.96


def _num(c: str) -> Column:
    return F.col(c).cast("double")


def _pair_name(a: str, b: str) -> str:
    return f"S__{a}__{b}"


def gram(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Per-group n, means and centred cross-products of ``cols``."""
    by = by or []
    clean = df.select(*by, *[_num(c).alias(c) for c in cols]).na.drop(subset=cols)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"mean__{c}") for c in cols]
    for a, b in itertools.combinations_with_replacement(cols, 2):
        aggs.append((F.covar_pop(a, b) * F.count(F.lit(1))).alias(_pair_name(a, b)))
    return (clean.groupBy(*by) if by else clean).agg(*aggs)


def _sname(cols: list[str], a: str, b: str) -> str:
    ia, ib = cols.index(a), cols.index(b)
    return _pair_name(a, b) if ia <= ib else _pair_name(b, a)


def corr_matrix(df: DataFrame, cols: list[str] = METRICS) -> DataFrame:
    """Pearson correlation of every pair, one pass, unpivoted to (x, y, corr)."""
    pairs = list(itertools.combinations(cols, 2))
    wide = df.agg(*[F.corr(_num(a), _num(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"),
                              F.round(F.col(f"c{i}"), 8).alias("corr"))
                     for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def _adjusted(cols, t, y, w, prefix=""):
    """Coefficient of t in y ~ t + w (+ group effects), from cross-products."""
    st = F.col(prefix + _sname(cols, t, t))
    sw = F.col(prefix + _sname(cols, w, w))
    stw = F.col(prefix + _sname(cols, t, w))
    sty = F.col(prefix + _sname(cols, t, y))
    swy = F.col(prefix + _sname(cols, w, y))
    det = st * sw - stw * stw
    beta = F.try_divide(sty * sw - swy * stw, det)
    gamma = F.try_divide(swy * st - sty * stw, det)
    return beta, gamma, det


def ate_linear(df: DataFrame, treatment: str = TREATMENT, outcome: str = OUTCOME,
               confounder: str = CONFOUNDER, by: str = "service", min_rows: int = 5) -> DataFrame:
    """Backdoor linear-regression effect of ``treatment`` on ``outcome``.

    Model: outcome ~ treatment + confounder + group effects.  Service
    dummies are handled by pooling within-service cross-products
    (Frisch-Waugh), so the second aggregation runs over one row per service.
    Significance (SE, t, two-sided normal p) comes from the same sums.
    Fewer than ``min_rows`` complete rows: NULL estimate.
    """
    return ate_from_gram(gram(df, [treatment, confounder, outcome], [by]), treatment, outcome, confounder, min_rows)


def merge_gram(parts: DataFrame, cols: list[str], by: list[str]) -> DataFrame:
    """The ``gram`` of rows of which ``parts`` holds the grams of disjoint portions (several rows per group).

    Portions' cross-products are moved from their own means to the common
    ones: two aggregates over a row per group and portion, nothing is recomputed.
    """
    means = [f"mean__{c}" for c in cols]
    total = parts.groupBy(*by).agg(F.sum("n").alias("_n"), *[(F.sum(F.col("n") * F.col(m)) / F.sum("n")).alias(f"_{m}") for m in means])
    j = join_on(parts, total, by)
    moved = {}
    for a, b in itertools.combinations_with_replacement(cols, 2):
        shift = (F.col(f"mean__{a}") - F.col(f"_mean__{a}")) * (F.col(f"mean__{b}") - F.col(f"_mean__{b}"))
        moved[_pair_name(a, b)] = F.sum(F.col(_pair_name(a, b)) + F.col("n") * shift).alias(_pair_name(a, b))
    return j.groupBy(*by).agg(F.sum("n").alias("n"), *[F.max(f"_{m}").alias(m) for m in means], *moved.values())


def gram_append(batch: DataFrame, path: str, epoch: int, cols: list[str], by: str = "service") -> None:
    """Write the gram of a batch of logs as an increment, in its epoch's folder (a replay overwrites it)."""
    gram(batch, cols, [by]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def gram_state(spark, path: str, cols: list[str], by: str = "service") -> DataFrame:
    """The gram over all increments below ``path``: a row per service and epoch is read, no log."""
    return merge_gram(spark.read.parquet(path).drop("epoch"), cols, [by])


def ate_from_gram(g: DataFrame, treatment: str = TREATMENT, outcome: str = OUTCOME, confounder: str = CONFOUNDER,
                  min_rows: int = 5) -> DataFrame:
    """``ate_linear`` from a gram of treatment, confounder and outcome per group."""
    cols = [treatment, confounder, outcome]
    names = sorted({_sname(cols, a, b) for a, b in itertools.combinations_with_replacement(cols, 2)})
    pooled = g.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
                   *[F.sum(c).alias(c) for c in names])
    beta, gamma, det = _adjusted(cols, treatment, outcome, confounder)
    syy = F.col(_sname(cols, outcome, outcome))
    rss = syy - beta * F.col(_sname(cols, treatment, outcome)) - gamma * F.col(_sname(cols, confounder, outcome))
    dof = F.col("n") - F.col("groups") - 2
    se = F.sqrt(F.try_divide(F.try_divide(rss, dof) * F.col(_sname(cols, confounder, confounder)), det))
    t_stat = F.try_divide(beta, se)
    enough = F.col("n") >= min_rows
    return pooled.select(
        F.lit(treatment).alias("treatment"), F.lit(outcome).alias("outcome"),
        "n", "groups",
        F.when(enough, F.round(beta, 10)).alias("ate"),
        F.when(enough, F.round(se, 10)).alias("std_error"),
        F.when(enough, F.round(t_stat, 6)).alias("t_value"),
        F.when(enough, F.round(normal_two_sided_p(t_stat), 6)).alias("p_value"))


def ate_hetero(df: DataFrame, treatment: str = TREATMENT, outcome: str = OUTCOME,
               confounder: str = CONFOUNDER, by: str = "service", min_rows: int = 5) -> DataFrame:
    """Effect with a treatment x service interaction, averaged over rows.

    Shared confounder slope gamma; per-service treatment slopes beta_s;
    ATE = sum(n_s / N * beta_s).  Services with no treatment variance are
    excluded and counted in ``excluded_groups``.  Fewer than ``min_rows``
    complete rows: NULL estimates.
    """
    cols = [treatment, confounder, outcome]
    g = gram(df, cols, [by])
    stt, stw, sty = (F.col(_sname(cols, treatment, treatment)), F.col(_sname(cols, treatment, confounder)),
                     F.col(_sname(cols, treatment, outcome)))
    sww, swy = F.col(_sname(cols, confounder, confounder)), F.col(_sname(cols, confounder, outcome))
    ok = stt > 0
    parts = g.select(
        "n", ok.alias("ok"),
        F.when(ok, swy - stw * sty / stt).alias("num"),
        F.when(ok, sww - stw * stw / stt).alias("den"),
        F.when(ok, F.col("n") * sty / stt).alias("a"),
        F.when(ok, F.col("n") * stw / stt).alias("b"))
    # beta_s = (sty - gamma * stw) / stt, so sum(n_s * beta_s) = sum(n*sty/stt) - gamma * sum(n*stw/stt):
    # one aggregate over one row per service gives gamma and the ATE together.
    sums = parts.agg(F.sum("num").alias("num"), F.sum("den").alias("den"), F.sum("a").alias("a"),
                     F.sum("b").alias("b"), F.sum(F.when(F.col("ok"), F.col("n"))).alias("n_ok"),
                     F.count_if(~F.col("ok")).alias("excluded_groups"))
    g_val = F.when(F.col("n_ok") >= min_rows, F.try_divide(F.col("num"), F.col("den")))
    return sums.select(
        F.lit(treatment).alias("treatment"), F.lit(outcome).alias("outcome"),
        F.round(F.try_divide(F.col("a") - g_val * F.col("b"), F.col("n_ok")), 10).alias("ate"),
        F.round(g_val, 10).alias("confounder_slope"),
        "excluded_groups")


def placebo_hash(event_id: Column, sim: Column) -> Column:
    """Deterministic uniform(0,1) placebo from (row id, simulation).

    The simulation is in the multiplier of a quadratic residue, so the draws
    of two simulations aren't shifts of one another; every further 1,000,003
    ids begin elsewhere, so that the draws have no period.
    """
    block = F.floor(event_id / 1000003) % 1000003
    x = ((event_id % 1000003) * 7919 + sim * 104729 + block * block % 1000003 * 486187) % 1000003
    return ((x * x + event_id % 1000003 * sim * 15485863) % 1000003).cast("double") / 1000003.0


def placebo_refute(df: DataFrame, simulations: int = 20, treatment: str = TREATMENT,
                   outcome: str = OUTCOME, confounder: str = CONFOUNDER,
                   by: str = "service", id_col: str = "event_id", min_rows: int = 5) -> DataFrame:
    """Re-estimate the effect with a random treatment, ``simulations`` times.

    Each row is expanded into one copy per simulation inside the map task
    (Generate feeds the partial aggregate directly), so the shuffle carries
    simulations x services rows per task.  Returns one row per simulation
    with the placebo effect and its t value (scale-free, SURVEY T9).
    """
    base = df.select(id_col, by, _num(treatment).alias("t0"), _num(confounder).alias(confounder),
                     _num(outcome).alias(outcome)).na.drop(subset=["t0", confounder, outcome])
    sims = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(simulations))).alias("sim"))
    sims = sims.withColumn("placebo", placebo_hash(F.col(id_col), F.col("sim")))
    cols = ["placebo", confounder, outcome]
    g = gram(sims, cols, ["sim", by])
    names = sorted({_sname(cols, a, b) for a, b in itertools.combinations_with_replacement(cols, 2)})
    pooled = g.groupBy("sim").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"),
                                  *[F.sum(c).alias(c) for c in names])
    beta, gamma, det = _adjusted(cols, "placebo", outcome, confounder)
    rss = (F.col(_sname(cols, outcome, outcome)) - beta * F.col(_sname(cols, "placebo", outcome))
           - gamma * F.col(_sname(cols, confounder, outcome)))
    dof = F.col("n") - F.col("groups") - 2
    se = F.sqrt(F.try_divide(F.try_divide(rss, dof) * F.col(_sname(cols, confounder, confounder)), det))
    enough = F.col("n") >= min_rows
    return pooled.select("sim", F.when(enough, F.round(beta, 10)).alias("placebo_effect"),
                         F.when(enough, F.round(F.try_divide(beta, se), 6)).alias("placebo_t"))


def placebo_summary(placebo: DataFrame, estimate: DataFrame) -> DataFrame:
    """Mean placebo effect, share of placebos with |t| >= |t| of the real one."""
    real = estimate.select(F.struct("ate", "t_value")).scalar()     # one scalar subquery
    real_ate, real_t = real["ate"], real["t_value"]
    return placebo.agg(
        real_ate.alias("real_ate"),
        F.round(F.avg("placebo_effect"), 10).alias("mean_placebo_effect"),
        F.count(F.lit(1)).alias("simulations"),
        F.round(F.avg(F.when(F.abs("placebo_t") >= F.abs(real_t), 1.0).otherwise(0.0)), 6)
        .alias("placebo_share_beyond"))


# ---- PC skeleton ---------------------------------------------------------

def _pc_name(x: str, y: str, cond: tuple[str, ...]) -> str:
    a, b = sorted((x, y))
    return "p__" + a + "__" + b + "__" + "_".join(sorted(cond))


def pc_tests(df: DataFrame, cols: list[str] = METRICS, by: str = "service",
             max_order: int | None = None, min_rows: int = 100) -> DataFrame:
    """Every conditional-independence test of the PC skeleton phase.

    Sets of any size, unless ``max_order`` limits them (over many columns
    ``discovery.pc_levels`` tests neighbours only).  Services with at most
    ``min_rows`` complete rows are left out.

    One pass of ``corr`` aggregates per service (and overall, via rollup);
    partial correlations of order 0..max_order by the standard recursion,
    one projection per order so each expression stays small; Fisher z =
    sqrt(n - |S| - 3) * atanh(r); independent when |z| < 1.96.  The
    expressions are SQL strings, parsed once on the JVM side.
    """
    pairs = list(itertools.combinations(cols, 2))
    max_order = len(cols) - 2 if max_order is None else max_order
    wide = (df.select(by, *[_num(c).alias(c) for c in cols]).na.drop(subset=cols)
            .rollup(by).agg(F.count(F.lit(1)).alias("n"),
                            *[F.corr(a, b).alias(_pc_name(a, b, ())) for a, b in pairs])
            .where(F.col("n") > min_rows))
    for k in range(1, max_order + 1):
        exprs = ["*"]
        for x, y in pairs:
            others = [c for c in cols if c not in (x, y)]
            for cond in itertools.combinations(others, k):
                z, rest = cond[-1], cond[:-1]
                rxy, rxz, ryz = _pc_name(x, y, rest), _pc_name(x, z, rest), _pc_name(y, z, rest)
                exprs.append(f"try_divide({rxy} - {rxz} * {ryz}, "
                             f"sqrt((1 - {rxz} * {rxz}) * (1 - {ryz} * {ryz}))) AS {_pc_name(x, y, cond)}")
        wide = wide.selectExpr(*exprs)
    tests = []
    for x, y in pairs:
        others = [c for c in cols if c not in (x, y)]
        for k in range(0, max_order + 1):
            for cond in itertools.combinations(others, k):
                pr = _pc_name(x, y, cond)
                z = f"(sqrt(n - {k + 3}) * atanh({pr}))"
                tests.append(f"named_struct('x', '{x}', 'y', '{y}', 'cond', '{','.join(cond)}', 'order', {k}, "
                             f"'partial_r', round({pr}, 6), 'z', round({z}, 4), "
                             f"'independent', abs({z}) < {Z_CRIT})")
    return wide.selectExpr(f"coalesce({by}, 'ALL') AS {by}", "n",
                           f"inline(array({', '.join(tests)}))")


def orient(near: dict[int, set[int]], apart: dict[tuple[int, int], tuple[int, ...]]) -> set[tuple[int, int]]:
    """Arrows (cause, effect) of a skeleton: v-structures x -> z <- y (z not in the set that separated x and y), then
    those without which another v-structure or a cycle would arise."""
    k = len(near)
    arrows: set[tuple[int, int]] = set()
    for x, y in itertools.combinations(range(k), 2):
        if y not in near[x]:
            for z in sorted(near[x] & near[y]):
                if z not in apart.get((x, y), ()) and (z, x) not in arrows and (z, y) not in arrows:
                    arrows |= {(x, z), (y, z)}
    grown = True
    while grown:
        grown = False
        for a in range(k):
            for b in sorted(near[a]):
                if (a, b) in arrows or (b, a) in arrows:
                    continue
                chain = any((c, a) in arrows and b not in near[c] and c != b for c in near[a])
                cycle = any((a, c) in arrows and (c, b) in arrows for c in near[a] & near[b])
                if chain or cycle:
                    arrows.add((a, b))
                    grown = True
    return arrows


def pc_search(corr, n: int, cols: list[str], z_crit: float = Z_CRIT):
    """The PC algorithm on a correlation matrix: (skeleton pairs, separating sets, arrows).

    Pairs are tested conditional on subsets of their current neighbours
    only, of growing size, until no node has enough neighbours left (no cap
    on the order); tests of one size see the neighbours as they were when it began.
    Then v-structures x -> z <- y are oriented (z not in the set that
    separated x and y), and arrows follow where another v-structure or a
    cycle would arise.  ``arrows`` holds (cause, effect).
    """
    k = len(cols)
    near = {i: set(range(k)) - {i} for i in range(k)}
    apart: dict[tuple[int, int], tuple[int, ...]] = {}
    order = 0
    while any(len(near[i]) - 1 >= order for i in near):
        before = {i: set(s) for i, s in near.items()}
        for x, y in itertools.combinations(range(k), 2):
            if y not in near[x]:
                continue
            sets = itertools.chain.from_iterable(itertools.combinations(sorted(before[a] - {b}), order) for a, b in ((x, y), (y, x)))
            for s in dict.fromkeys(sets):
                idx = [x, y, *s]
                if n - order - 3 <= 0:
                    continue
                p = np.linalg.pinv(corr[np.ix_(idx, idx)])
                r = float(np.clip(-p[0, 1] / np.sqrt(abs(p[0, 0] * p[1, 1])), -1 + 1e-12, 1 - 1e-12))
                if abs(np.sqrt(n - order - 3) * np.arctanh(r)) < z_crit:
                    near[x].discard(y)
                    near[y].discard(x)
                    apart[x, y] = s
                    break
        order += 1
    pairs = [(x, y) for x, y in itertools.combinations(range(k), 2) if y in near[x]]
    return pairs, apart, orient(near, apart)


def pc_oriented(df: DataFrame, cols: list[str] = METRICS, by: str = "service", min_rows: int = 100) -> DataFrame:
    """Directed causal graph per service: every pair of metrics, whether it is
    adjacent, its arrow ('x->y', 'y->x', 'undirected'; NULL if not adjacent)
    and the set that separated it.

    One aggregate gives the correlations of each service (a row each); the
    search runs on that row (``pc_search``).  Services with at most
    ``min_rows`` complete rows are left out.
    """
    pairs = list(itertools.combinations(cols, 2))
    wide = (df.select(by, *[_num(c).alias(c) for c in cols]).na.drop(subset=cols).groupBy(by)
            .agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
            .where(F.col("n") > min_rows))
    kind = df.schema[by].dataType.simpleString()

    def search(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                corr = np.eye(len(cols))
                for i, (a, b) in enumerate(pairs):
                    corr[cols.index(a), cols.index(b)] = corr[cols.index(b), cols.index(a)] = r[2 + i]
                found, apart, arrows = pc_search(corr, int(r[1]), cols)
                for x, y in itertools.combinations(range(len(cols)), 2):
                    arrow = ("x->y" if (x, y) in arrows else "y->x" if (y, x) in arrows else "undirected") if (x, y) in found else None
                    rows.append((r[0], cols[x], cols[y], (x, y) in found, arrow,
                                 ",".join(cols[i] for i in apart[x, y]) if (x, y) in apart else None))
            yield pd.DataFrame(rows, columns=[by, "x", "y", "adjacent", "arrow", "separated_by"])
    return wide.mapInPandas(search, f"{by} {kind}, x string, y string, adjacent boolean, arrow string, separated_by string")


def pc_neighbourhood(logs: DataFrame, services: list[str], target: str, metric: str = "latency_ms",
                     bucket_seconds: int = 3600, min_rows: int = 100) -> DataFrame:
    """Directed graph among ``target`` and the ``services`` chosen for it (its k-hop neighbours).

    One aggregate gives the mean ``metric`` per service and time bucket, a
    column per service; buckets that lack one are left out, and the search
    runs on the correlations (``pc_oriented``).
    """
    names = [target, *sorted(set(services) - {target})]
    bucket = F.floor(epoch_micros(F.col("timestamp")) / (bucket_seconds * 1_000_000))
    panel = logs.where(F.col("service").isin(names)).groupBy(bucket.alias("bucket")).pivot("service", names).agg(F.avg(metric))
    return pc_oriented(panel.select(F.lit(target).alias("target"), *names), names, "target", min_rows)


def pc_skeleton(tests: DataFrame, by: str = "service") -> DataFrame:
    """Edges that survive every test; the separating set of removed ones."""
    sep = F.min_by(F.col("cond"), F.struct(F.abs("z"), F.col("order"), F.col("cond")))
    return (tests.groupBy(by, "x", "y")
            .agg(F.bool_or("independent").alias("removed"),
                 F.round(F.min(F.abs("z")), 4).alias("min_abs_z"),
                 sep.alias("weakest_cond"))
            .select(by, "x", "y", (~F.col("removed")).alias("adjacent"), "min_abs_z", "weakest_cond"))


def true_skeleton(spark, cols: list[str] = METRICS) -> DataFrame:
    """Undirected edges of the fixed causal graph among ``cols``."""
    rows = sorted({tuple(sorted((a, b), key=cols.index)) for a, b in CAUSAL_EDGES
                   if a in cols and b in cols})
    return spark.createDataFrame(rows, "x string, y string")


def graph_metrics(found: DataFrame, truth: DataFrame, cols: list[str] = METRICS,
                  method: str = "pc") -> DataFrame:
    """SHD (skeleton), recall and false-positive rate of a found skeleton."""
    total = len(cols) * (len(cols) - 1) // 2
    f = found.select("x", "y", F.lit(True).alias("in_found"))
    t = F.broadcast(truth.select("x", "y", F.lit(True).alias("in_truth")))  # fixed graph, tiny
    j = f.join(t, ["x", "y"], "full_outer")
    m = j.agg(F.count_if(F.col("in_found") & F.col("in_truth")).alias("tp"),
              F.count_if(F.col("in_found") & F.col("in_truth").isNull()).alias("fp"),
              F.count_if(F.col("in_found").isNull() & F.col("in_truth")).alias("fn"))
    return m.select(
        F.lit(method).alias("method"), "tp", "fp", "fn",
        (F.col("fp") + F.col("fn")).alias("shd"),
        F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"),
        F.round(F.try_divide(F.col("fp"), F.lit(total) - F.col("tp") - F.col("fn")), 6)
        .alias("false_positive_rate"))


def effect_scan(df: DataFrame, cols: list[str] = METRICS, confounder: str = CONFOUNDER,
                by: str = "service", min_rows: int = 100) -> DataFrame:
    """Naive and confounder-adjusted slope for every ordered metric pair of services with more than ``min_rows`` rows."""
    g = gram(df, cols, [by]).where(F.col("n") > min_rows)
    rows = []
    for t, y in itertools.permutations(cols, 2):
        naive = F.try_divide(F.col(_sname(cols, t, y)), F.col(_sname(cols, t, t)))
        if confounder in (t, y):
            adj = naive
        else:
            adj, _, _ = _adjusted(cols, t, y, confounder)
        rows.append(F.struct(F.lit(t).alias("treatment"), F.lit(y).alias("outcome"),
                             F.round(naive, 8).alias("naive_slope"),
                             F.round(adj, 8).alias("adjusted_slope")))
    return g.select(by, "n", F.inline(F.array(*rows)))
