"""Level-wise discovery over many variables against the search on one node; sufficient statistics as increments."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import causal, discovery
from kestrel.sources import tables as T

from conftest import SF_SMALL


def _data(k, n, seed, density=2.0):
    """A random linear model: each variable follows some of those before it."""
    rng = np.random.default_rng(seed)
    x = np.zeros((n, k))
    for i in range(k):
        parents = [j for j in range(i) if rng.random() < density / k]
        x[:, i] = rng.normal(size=n) + sum((rng.uniform(0.4, 1.0) * x[:, j] for j in parents), np.zeros(n))
    return x


@pytest.mark.parametrize("k,at_once", [(6, 3), (15, 50), (50, discovery.TESTS_AT_ONCE)])
def test_levels_equal_the_search(spark, k, at_once):
    corr = np.corrcoef(_data(k, 800, k).T)
    begin = time.perf_counter()
    got = discovery.pc_levels(spark, corr, 800, at_once=at_once)
    print(f"{k} variables: {time.perf_counter() - begin:.2f} s")
    want = causal.pc_search(corr, 800, [f"v{i}" for i in range(k)])
    assert got == want and got[0]


def test_moments_and_graph(spark):
    x = _data(5, 400, 1)
    cols = [f"a|{i}" for i in range(5)] + ["still"]
    rows = [(*map(float, r), 7.0) for r in x] + [(None, 1.0, 1.0, 1.0, 1.0, 7.0)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in cols)).repartition(5)
    n, corr = discovery.moments(df, cols)
    assert n == 400 and np.allclose(corr[:5, :5], np.corrcoef(x.T)) and np.allclose(corr[5, :5], 0)
    got = discovery.discover(df, cols).collect()
    pairs, apart, arrows = causal.pc_search(corr, n, cols)
    assert {(r["x"], r["y"]) for r in got if r["adjacent"]} == {(cols[a], cols[b]) for a, b in pairs}
    assert {(r["x"], r["y"]) if r["arrow"] == "x->y" else (r["y"], r["x"]) for r in got if r["arrow"] in ("x->y", "y->x")} == {
        (cols[a], cols[b]) for a, b in arrows}
    assert discovery.discover(df.limit(100), cols).count() == 0          # not more than 100 rows
    assert len(got) == len(list(itertools.combinations(cols, 2)))


def test_increments_equal_the_whole(spark, tmp_path):
    logs = T.load_logs(spark, SF_SMALL)
    cols = [causal.TREATMENT, causal.CONFOUNDER, causal.OUTCOME]
    path = str(tmp_path / "gram")
    for i in range(3):
        for _ in range(2):           # a replay overwrites its increment
            causal.gram_append(logs.where(F.col("event_id") % 3 == i), path, i, cols)
    whole = {r["service"]: r for r in causal.gram(logs, cols, ["service"]).collect()}
    merged = causal.gram_state(spark, path, cols).collect()
    assert len(merged) == len(whole)
    for r in merged:
        for c in r.__fields__:
            if c != "service":
                assert np.isclose(r[c], whole[r["service"]][c], rtol=1e-9), c


def test_row_guards(spark):
    rows = [(s, float(i % 7), float(i % 5), float(i % 3), float(i % 2)) for s, n in (("few", 100), ("more", 101)) for i in range(n)]
    df = spark.createDataFrame(rows, "service string, db_lock_time double, pool_wait_ms double, latency_ms double, error_count double")
    assert {r["service"] for r in causal.effect_scan(df).select("service").distinct().collect()} == {"more"}
    assert {r["service"] for r in causal.pc_tests(df).select("service").distinct().collect()} == {"more", "ALL"}


def test_every_order_is_tested(spark):
    cols = ["a", "b", "c", "d", "e"]
    x = _data(5, 300, 4)
    df = spark.createDataFrame([("s", *map(float, r)) for r in x], "service string, a double, b double, c double, d double, e double")
    orders = {r["order"]: r["count"] for r in causal.pc_tests(df, cols).where("service = 's'").groupBy("order").count().collect()}
    assert orders == {0: 10, 1: 30, 2: 30, 3: 10}


def test_placebo_has_no_period(spark):
    draws = spark.range(5).select(*[causal.placebo_hash(F.col("id") + F.lit(k * 1000003), F.lit(1)).alias(f"d{k}") for k in range(3)]).collect()
    assert len({tuple(r[f"d{k}"] for r in draws) for k in range(3)}) == 3
