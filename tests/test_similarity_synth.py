"""Approximate search against exact search; embedding and generator checks."""

import math

from pyspark.sql import functions as F

from kestrel.operators import similarity as sim
from kestrel.operators import synth
from kestrel.sources import tables as T

from conftest import SF_MID, SF_SMALL


def test_lsh_recall_against_exact(spark):
    corpus = T.load_embeddings(spark, SF_MID)
    queries = corpus.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"),
                                                    F.col("label").alias("query_filter"))
    exact = {(r["query_id"], r["vec_id"]) for r in sim.knn(corpus, queries, n=3).collect()}
    approx = [(r["query_id"], r["vec_id"]) for r in sim.knn_lsh(corpus, queries, n=3).collect()]
    assert len(exact & set(approx)) / len(exact) >= 0.9
    assert len(approx) == len(set(approx)) == 3 * queries.count()        # n rows for every query
    keys = corpus.select("label", F.explode(sim.lsh_keys(F.col("embedding"), 64, 2, 10, 7)).alias("k"))
    largest = keys.groupBy("label", "k").count().agg(F.max("count")).first()[0]
    assert largest < 0.08 * corpus.count()          # 500 rows, 10 labels: a label alone has up to 13 %


def test_lsh_answers_queries_that_meet_nothing(spark):
    corpus = T.load_embeddings(spark, SF_MID)
    queries = sim.latest_per_label(corpus)
    got = sim.knn_lsh(corpus, queries, n=3, bits=40, num_tables=1)
    want = sim.knn(corpus, queries, n=3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_text_embed_unit_vectors(spark):
    docs = T.read_table(spark, SF_SMALL, "documents")
    emb = sim.text_embed(docs)
    assert emb.count() == docs.count()
    row = emb.where(F.size("embedding") > 0).select(
        F.size("embedding").alias("d"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("sq")).first()
    assert row["d"] == 384
    assert math.isclose(row["sq"], 1.0, rel_tol=1e-4) or row["sq"] == 0.0


def test_synth_logs_moments(spark):
    spine = spark.range(20000).withColumnRenamed("id", "event_id")
    logs = synth.synth_logs(spine)
    s = logs.agg(F.avg("error_count").alias("err"),
                 F.corr("db_lock_time", F.col("error_count").cast("double")).alias("c"),
                 F.min("pool_wait_ms").alias("pmin")).first()
    assert 0.0 < s["err"] < 0.5
    assert s["c"] > 0.2                      # lock time drives errors
    assert s["pmin"] >= 0.0
    # Before the incident lock time is exponential with mean 0.1.
    pre = logs.where(F.col("event_id") * 30 <= 18 * 3600).agg(F.avg("db_lock_time")).first()[0]
    assert abs(pre - 0.1) < 0.02
