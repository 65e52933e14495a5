"""Blocked products and the inverted file against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.operators import ann
from kestrel.operators import similarity as sim
from kestrel.sources import tables as T

from conftest import SF_MID

VECTORS = "vec_id long, embedding array<float>, label int"


def _queries(corpus, every):
    return corpus.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.col("label").alias("query_filter"))


def _rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "similarity").collect())


def _awkward(spark):
    """Copies of one vector in a third of the rows, repeated ids, NULLs, zero vectors, other lengths, a NULL label."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)], i % 3) for i in range(120)]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1) for i in range(60)]
    rows += [(1000, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 1), (5, rows[5][1], 2), (300, None, 1), (301, [0.0] * 6, 1), (302, [1.0], 1),
             (303, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (304, [1.0] * 6, None), (305, [float("nan")] + [1.0] * 5, 1)]
    return spark.createDataFrame(rows, VECTORS)


@pytest.mark.parametrize("block_bytes,group", [(64 * 8 * 7, 3), (1 << 20, 1 << 16)])
def test_blocks_equal_the_exact_search(spark, block_bytes, group):
    corpus = T.load_embeddings(spark, SF_MID)
    queries = _queries(corpus, 7)
    want = _rows(sim.knn(corpus, queries, n=4))
    assert len(want) == 4 * queries.count()
    assert _rows(sim.knn_blocks(corpus, queries, 4, block_bytes=block_bytes, query_group=group)) == want
    assert _rows(sim.knn(corpus, queries, n=4, max_broadcast_rows=5)) == want        # beyond the limit: blocks


@pytest.mark.parametrize("search", ["blocks", "small blocks", "ivf", "ivf few lists"])
@pytest.mark.parametrize("label", ["label", None])
def test_awkward_vectors(spark, search, label):
    corpus = _awkward(spark)
    queries = _queries(corpus, 5)
    want = _rows(sim.knn(corpus, queries, 5, label))
    got = {"blocks": lambda: sim.knn_blocks(corpus, queries, 5, label),
           "small blocks": lambda: sim.knn_blocks(corpus, queries, 5, label, block_bytes=6 * 8 * 4, query_group=7),
           "ivf": lambda: ann.knn_ivf(corpus, queries, 5, label),
           "ivf few lists": lambda: ann.knn_ivf(corpus, queries, 5, label, lists=2)}[search]()
    # A query that stands there twice (a repeated id) is one query to knn's rank, as it is here.
    assert _rows(got) == want


def test_empty_sets(spark):
    corpus = _awkward(spark)
    none = corpus.where("vec_id < 0")
    assert sim.knn_blocks(none, _queries(corpus, 5)).count() == 0
    assert sim.knn_blocks(corpus, _queries(none, 5)).count() == 0
    assert ann.knn_ivf(none, _queries(corpus, 5)).count() == 0
    assert ann.knn_ivf(corpus, _queries(none, 5)).count() == 0


def _compared(spark, corpus, queries, n, **search):
    index = ann.build(corpus)
    found, pairs = ann.search(index, queries, n, **search)
    found = {(r["query_id"], r["vec_id"]) for r in found.collect()}
    exact = {(r["query_id"], r["vec_id"]) for r in sim.knn_blocks(corpus, queries, n).collect()}
    of_label = {r["label"]: r["count"] for r in corpus.groupBy("label").count().collect()}
    all_pairs = sum(of_label[r["query_filter"]] - 1 for r in queries.collect())
    return len(found & exact) / len(exact), pairs.count() / all_pairs, found == exact


def test_ivf_compares_few_pairs_and_finds_all(spark):
    corpus = T.load_embeddings(spark, "/root/testdata/sf0.1")
    recall, share, same = _compared(spark, corpus, _queries(corpus, 50), 10)
    assert same and recall == 1 and share < 0.1


def test_ivf_at_a_hundred_times_the_rows(spark):
    """The table's vectors, each with 99 neighbours around it."""
    base = T.load_embeddings(spark, "/root/testdata/sf0.1")
    near = F.transform("embedding", lambda x, i: (x + 0.1 * F.sin(x * 1000 + i * (1 + F.col("k")))).cast("float"))
    corpus = (base.crossJoin(F.broadcast(spark.range(100).withColumnRenamed("id", "k")))
              .select((F.col("vec_id") * 100 + F.col("k")).alias("vec_id"),
                      F.when(F.col("k") == 0, F.col("embedding")).otherwise(near).alias("embedding"), "label"))
    corpus = sim.materialize(corpus, "many")
    assert corpus.count() == 200_000
    queries = _queries(corpus, 10_000)
    index = ann.build(corpus, lists=200)
    exact = {(r["query_id"], r["vec_id"]) for r in sim.knn_blocks(corpus, queries, 10).collect()}
    total = 20_000 * queries.count()            # rows of a label, about
    for probes in (None, 20):
        found, pairs = ann.search(index, queries, 10, probes=probes)
        found = {(r["query_id"], r["vec_id"]) for r in found.collect()}
        assert len(found & exact) / len(exact) >= (1 if probes is None else 0.9)
        assert pairs.count() / total < 0.1
