"""Causal discovery over many variables, its tests dealt out over the cluster.

``panel`` turns logs into one row per time bucket and a column per service and
metric.  ``moments`` takes all correlations in one pass: each task adds up the
products of its rows, a row per pair of columns goes on.  ``pc_levels`` runs the
PC algorithm level by level: the tests of one level (every edge that is left,
given every set of that many of its neighbours) are numbered and dealt out in
runs of ``TESTS_AT_ONCE``, each run solved as one stack of matrices; the first
set that separates a pair is kept, the graph thinned, and the next level dealt.
Only matrices and graphs over the variables reach the driver.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.functions.exprs import epoch_micros
from kestrel.operators.causal import Z_CRIT, orient
from kestrel.session import materialize

TESTS_AT_ONCE = 4096
MAX_VARIABLES = 1000      # the correlation matrix goes to every task


def panel(logs: DataFrame, services: list[str], metrics: list[str], bucket_seconds: int = 3600) -> tuple[DataFrame, list[str]]:
    """(one row per time bucket, its variables): the mean and the largest value of each metric of each service."""
    bucket = F.floor(epoch_micros(F.col("timestamp")) / (bucket_seconds * 1_000_000))
    columns = {}
    for s, m in itertools.product(services, metrics):
        own = F.when(F.col("service") == s, F.col(m).cast("double"))
        columns[f"{s}|{m}|mean"], columns[f"{s}|{m}|max"] = F.avg(own), F.max(own)
    wide = logs.where(F.col("timestamp").isNotNull()).groupBy(bucket.alias("bucket")).agg(*[c.alias(n) for n, c in columns.items()])
    return wide, list(columns)


def moments(df: DataFrame, cols: list[str]) -> tuple[int, np.ndarray]:
    """(complete rows, correlation matrix).  A column that does not vary is correlated with nothing."""
    if len(cols) > MAX_VARIABLES:
        raise ValueError(f"more than {MAX_VARIABLES} variables")
    k = len(cols)
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate(cols)]).na.drop()
    first = rows.agg(F.count(F.lit(1)), *[F.avg(f"v{i}") for i in range(k)]).first()
    n, mean = first[0], np.array([x or 0.0 for x in first[1:]])
    upper = np.triu_indices(k)

    def products(batches):
        total = np.zeros((k, k))
        for b in batches:
            x = np.column_stack([b.column(i).to_numpy() for i in range(k)]) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), pa.array(total[upper])],
                                         names=["i", "j", "s"])

    sums = rows.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s"))
    cross = np.zeros((k, k))
    for r in sums.collect():                    # a row per pair of variables
        cross[r["i"], r["j"]] = cross[r["j"], r["i"]] = r["s"]
    scale = np.sqrt(np.diag(cross))
    scale[scale == 0] = np.inf
    corr = cross / scale[:, None] / scale[None, :]
    np.fill_diagonal(corr, 1.0)
    return n, corr


def _separated(corr: np.ndarray, idx: np.ndarray, n: int, z_crit: float) -> np.ndarray:
    """Whether the first two variables of each row of ``idx`` are independent given the others."""
    p = np.linalg.pinv(corr[idx[:, :, None], idx[:, None, :]])
    r = np.clip(-p[:, 0, 1] / np.sqrt(np.abs(p[:, 0, 0] * p[:, 1, 1])), -1 + 1e-12, 1 - 1e-12)
    return np.abs(np.sqrt(n - (idx.shape[1] - 2) - 3) * np.arctanh(r)) < z_crit


def _runs(near: dict[int, set[int]], order: int, at_once: int):
    """The tests of one level in runs: (x, y, first, last, x's other neighbours, y's)."""
    for x in near:
        for y in sorted(near[x]):
            if x < y:
                of_x, of_y = sorted(near[x] - {y}), sorted(near[y] - {x})
                tests = math.comb(len(of_x), order) + math.comb(len(of_y), order)
                for first in range(0, tests, at_once):
                    yield x, y, first, min(tests, first + at_once), of_x, of_y


def pc_levels(spark: SparkSession, corr: np.ndarray, n: int, z_crit: float = Z_CRIT, at_once: int = TESTS_AT_ONCE):
    """``causal.pc_search`` on a correlation matrix of many variables: (skeleton pairs, separating sets, arrows)."""
    k = len(corr)
    near = {i: set(range(k)) - {i} for i in range(k)}
    apart: dict[tuple[int, int], tuple[int, ...]] = {}

    def test(order: int):
        def run(frames):
            for pdf in frames:
                found = []
                for x, y, first, last, of_x, of_y in pdf.itertuples(index=False):
                    sets = itertools.chain(itertools.combinations(of_x, order), itertools.combinations(of_y, order))
                    own = np.array(list(itertools.islice(sets, int(first), int(last))), int).reshape(int(last - first), order)
                    idx = np.column_stack([np.full(len(own), x), np.full(len(own), y), own])
                    hit = np.flatnonzero(_separated(corr, idx, n, z_crit))
                    if len(hit):
                        found.append((x, y, first + hit[0], own[hit[0]].tolist()))
                yield pd.DataFrame(found, columns=["x", "y", "at", "given"])
        return run

    order = 0
    while any(len(s) - 1 >= order for s in near.values()) and n - order - 3 > 0:
        rows = list(_runs(near, order, at_once))           # of the variables' edges, not of the data
        if rows:
            dealt = spark.createDataFrame(rows, "x int, y int, first long, last long, of_x array<int>, of_y array<int>")
            dealt = dealt.repartition(min(len(rows), max(1, spark.sparkContext.defaultParallelism)))
            hits = dealt.mapInPandas(test(order), "x int, y int, at long, given array<int>")
            for r in hits.groupBy("x", "y").agg(F.min_by("given", "at").alias("given")).collect():
                near[r["x"]].discard(r["y"])
                near[r["y"]].discard(r["x"])
                apart[r["x"], r["y"]] = tuple(r["given"])
        order += 1
    pairs = [(x, y) for x, y in itertools.combinations(range(k), 2) if y in near[x]]
    return pairs, apart, orient(near, apart)


def discover(df: DataFrame, cols: list[str], min_rows: int = 100) -> DataFrame:
    """The directed graph over ``cols``: x, y, adjacent, arrow, separated_by, n, a row per pair.

    ``arrow`` is 'x->y', 'y->x' or 'undirected' (NULL if not adjacent).  At
    most ``min_rows`` complete rows: no rows.
    """
    spark = df.sparkSession
    df = materialize(df.select(*[F.col(f"`{c}`") for c in cols]), "panel")       # read twice
    n, corr = moments(df, cols)
    schema = "x string, y string, adjacent boolean, arrow string, separated_by string, n long"
    if n <= min_rows:
        return spark.createDataFrame([], schema)
    found, apart, arrows = pc_levels(spark, corr, n)
    found, rows = set(found), []
    for x, y in itertools.combinations(range(len(cols)), 2):
        arrow = ("x->y" if (x, y) in arrows else "y->x" if (y, x) in arrows else "undirected") if (x, y) in found else None
        given = ",".join(cols[i] for i in apart[x, y]) if (x, y) in apart else None
        rows.append((cols[x], cols[y], (x, y) in found, arrow, given, n))
    return spark.createDataFrame(rows, schema)
