"""Similar texts through bounded posting lists against exact scoring; the encoder plug-in."""

import inspect
import math
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrel.operators import encoding, similarity, textsearch

from conftest import SF_SMALL


def _words(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def _vector(text, texts, df):
    w = {t: (1 + math.log(c)) * (math.log((texts + 1) / (df[t] + 1)) + 1) for t, c in Counter(_words(text)).items()}
    norm = math.sqrt(sum(x * x for x in w.values()))
    return {t: x / norm for t, x in w.items()}


def _exact(docs, queries, n, exclude_self):
    out = []
    for q, fkey, text in queries:
        own = [d for d in docs if d[1] == fkey and fkey is not None]
        df = Counter(t for d in own for t in set(_words(d[2])))
        qv = _vector(text, len(own), df)
        scored = []
        for d in own:
            dv = _vector(d[2], len(own), df)
            score = sum(x * dv[t] for t, x in qv.items() if t in dv)
            if set(qv) & set(dv) and not (exclude_self and d[0] == q):
                scored.append((-round(score, 9), -d[3], d[0]))
        out += [(q, fkey, i, d, -s) for i, (s, _, d) in enumerate(sorted(scored)[:n], 1)]
    return sorted(out)


def _search(spark, docs, queries, n, exclude_self):
    texts = spark.createDataFrame(docs, "id long, fkey string, text string, newest long")
    asked = spark.createDataFrame(queries, "query_id long, fkey string, text string")
    found, pairs = textsearch.search(textsearch.build(texts), asked, n, exclude_self)
    return sorted((r["query_id"], r["fkey"], r["rank"], r["id"], r["score"]) for r in found.collect()), pairs.count()


def test_search_equals_exact_scoring(spark, monkeypatch):
    monkeypatch.setattr(textsearch, "BLOCK", 3)
    monkeypatch.setattr(textsearch, "LIST", 8)
    rng = np.random.default_rng(1)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(150)]
    docs = [(i, f"f{i % 2}", " ".join([*rng.choice(common, rng.integers(0, 9)), *rng.choice(rare, rng.integers(0, 6))]), i) for i in range(300)]
    docs += [(400, "f0", docs[0][2], 400), (401, "f0", docs[0][2], 401), (402, "f0", None, 1), (403, "f0", "  --  ", 1), (404, None, "c1", 1),
             (405, "f1", "Ünïcode C1 c1, R5!", 9)]
    queries = [(d[0], d[1], d[2]) for d in docs if d[0] % 7 == 0 or d[0] >= 400] + [(900, "f0", "unknown words"), (901, "nowhere", "c1")]
    for n, exclude in ((1, True), (4, True), (400, False)):
        got, _ = _search(spark, docs, queries, n, exclude)
        assert got == _exact(docs, queries, n, exclude)


def test_search_compares_few_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("fkey"), "text", F.col("doc_id").alias("newest"))
    queries = docs.where("id % 50 = 0").select(F.col("id").alias("query_id"), "fkey", "text")
    found, pairs = textsearch.search(textsearch.build(docs), queries, 1, True)
    sizes = {r["fkey"]: r["count"] for r in docs.groupBy("fkey").count().collect()}
    every = sum(sizes[r["fkey"]] - 1 for r in queries.collect())
    assert found.count() == queries.count() and pairs.count() < every


def test_texts_of_the_same_common_words_are_not_all_compared(spark, monkeypatch):
    # No bound of a term tells such texts apart; their sums do, in cells of some texts and some queries.
    monkeypatch.setattr(textsearch, "CELL_ENTRIES", 2000, raising=False)
    monkeypatch.setattr(textsearch, "CELL_TERMS", 100, raising=False)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(80)]
    docs = [(i, "f", " ".join(rng.choice(words, 40)), i) for i in range(400)] + [(500 + i, "g", f"w{i} alone", i) for i in range(5)]
    queries = [(d[0], d[1], d[2]) for d in docs if d[0] % 50 == 0] + [(901, "g", "w1 w2 w70")]
    got, pairs = _search(spark, docs, queries, 3, True)
    assert got == _exact(docs, queries, 3, True)
    assert pairs < 200


def test_tables_take_few_bytes_a_posting(spark, monkeypatch, tmp_path):
    # A row for each text and term took several times the texts' bytes; a cell's postings are packed.
    names = iter(range(1000))
    monkeypatch.setattr("kestrel.session.scratch_path", lambda _, name: str(tmp_path / f"{name}-{next(names)}"))
    rng = np.random.default_rng(5)
    docs = [(i, "f", " ".join(f"w{t}" for t in rng.integers(0, 2000, 150)), i) for i in range(1500)]
    got, _ = _search(spark, docs, [d[:3] for d in docs[:20]], 2, True)
    assert len(got) == 40
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 0.8 * sum(len(d[2]) for d in docs)


def test_small_filter_values_share_blocks(spark, monkeypatch):
    # The same ids in each: only texts of the query's own value are found, and its own text alone is left out.
    monkeypatch.setattr(textsearch, "SMALLEST", 1.0, raising=False)
    rng = np.random.default_rng(7)
    docs = [(i, f"f{f}", " ".join(rng.choice(["a", "b", "c", "d", f"x{f}"], 6)), -i) for f in range(40) for i in range(5)]
    queries = [d[:3] for d in docs if d[0] < 2]
    got, _ = _search(spark, docs, queries, 3, True)
    assert got == _exact(docs, queries, 3, True)


def test_equal_texts_of_many_cells_come_by_newest(spark, monkeypatch):
    monkeypatch.setattr(textsearch, "LIST", 8)
    rng = np.random.default_rng(9)
    newest = rng.permutation(200)
    docs = [(i, "f", ["same words here", "words same here", "other words"][i % 3], int(newest[i]) // 2) for i in range(200)]
    queries = [d[:3] for d in docs[:12]]
    got, pairs = _search(spark, docs, queries, 4, True)
    assert got == _exact(docs, queries, 4, True)


def test_words_are_split_as_the_sql_does():
    texts = ["Ünïcode C1 c1, R5!", None, "", "--", "a", "b\u0080c \x7f", "日本 語", "x\x00y", "tail_", "Z" * 40]
    found, sizes = textsearch.words(pa.array(["skipped", *texts, "skipped"])[1:-1])
    assert found.to_pylist() == [w for t in texts for w in _words(t)]
    assert sizes.tolist() == [len(_words(t)) for t in texts]


def test_empty_texts(spark):
    got, pairs = _search(spark, [], [(1, "f", "a")], 3, True)
    assert got == [] and pairs == 0


def test_similar_incidents_by_message(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", i, start + timedelta(minutes=i), m, 1) for i, m in enumerate(
        ["disk full on node", "pool exhausted", "pool exhausted", "disk slow", "pool wait timeout", "pool exhausted", None])]
    rows += [("a", 50, start + timedelta(days=9), "pool exhausted", 1), ("a", 51, start, "pool exhausted", 0), ("b", 60, start, "pool exhausted", 1)]
    logs = spark.createDataFrame(rows, "service string, event_id long, timestamp timestamp_ntz, message string, error_count int")
    index = similarity.incident_index(logs, F.lit(start + timedelta(days=1)).cast("timestamp_ntz"))
    asked = spark.createDataFrame([("a", "Pool EXHAUSTED!"), ("b", "disk"), ("c", "pool")], "service string, message string")
    got = [(r["service"], r["rank"], r["event_id"]) for r in similarity.similar_incidents(index, asked, 4).orderBy("service", "rank").collect()]
    assert got == [("a", 1, 5), ("a", 2, 2), ("a", 3, 1), ("a", 4, 4)]


def _counting():
    """An encoder that writes how many texts it was handed, how often it was called, and how long each text is."""
    class Counting:
        def __init__(self):
            self.calls = 0

        def __call__(self, texts):
            self.calls += 1
            return np.array([[len(texts), self.calls, 0, len(t)] for t in texts], float)
    return Counting()


@pytest.mark.parametrize("arrow_rows", [3, 1000])
def test_encoder_gets_full_batches_and_lives_with_its_worker(spark, arrow_rows):
    name = f"counting-{arrow_rows}"
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        docs = spark.createDataFrame([(i, None if i == 4 else "x" * i) for i in range(23)], "k int, text string").coalesce(1)
        # By value: workers don't have this folder.
        source = inspect.getsource(_counting)
        scope = {"np": np}
        exec(source, scope)
        got = encoding.encode_texts(docs, scope["_counting"], 4, name, batch_size=10).orderBy("k").collect()
        tasks = encoding.encode_texts(spark.range(80).select(F.lit("x").alias("text")).repartition(80), scope["_counting"], 4, name)
        calls = [r["embedding"][1] for r in tasks.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r["embedding"][0] for r in got] == [10] * 20 + [3] * 3
    assert [r["embedding"][3] for r in got] == [0 if i == 4 else i for i in range(23)]
    own = sorted({r["embedding"][1] for r in got})
    assert own == [own[0], own[0] + 1, own[0] + 2]
    assert len(calls) == 80 and max(calls) > 3            # far more tasks than workers: they met their encoders again


def test_encoder_with_another_shape_ends_the_job(spark):
    docs = spark.createDataFrame([("a",)], "text string")
    with pytest.raises(Exception, match="encoder short"):
        encoding.encode_texts(docs, lambda: lambda texts: np.zeros((len(texts), 2)), 3, "short").collect()


def test_hashed_words_are_unit_vectors(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    v = encoding.encode_texts(docs, lambda: encoding.HashedWords(64), 64, "hashed-64", keep=["doc_id"])
    norms = v.select(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x).alias("n")).collect()
    assert len(norms) == docs.count() and all(abs(r["n"] - 1) < 1e-5 or r["n"] == 0 for r in norms)
