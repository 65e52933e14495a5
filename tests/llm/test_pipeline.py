"""The corpus pipeline against a plain version: every stage on what the one before kept, then the whole."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kestrel.llm import quality, queries

from . import cases

SF = "/root/testdata/sf0.001"
EXTRA = ["score", "root", "begin", "h", "n"]        # names that stages use on the way


# ---- plain stages: lists of (doc_id, text, lang, source, n_chars) ------------

def plain_quality(rows, labelled):
    """Scores by one pass over dictionaries; the classifier's weights from Newton steps of its own."""
    value: dict[int, int] = {}
    for i, q in labelled:
        if i is not None and q is not None and zlib.crc32(str(i).encode()) % 5:
            value[i] = max(q, value.get(i, q))
    first = {}
    for r in rows:
        if r[0] in value:
            key = (cases.xxh(r[1]) if r[1] is not None else 42, tuple(quality.features((r[1] or "").encode())))
            first[r[0]] = min(first.get(r[0], key), key)
    ids = sorted(first)
    y = np.array([value[i] for i in ids], float)
    weights, bias = np.zeros(quality.N_FEATURES), 0.0
    if len(set(y)) == 2:
        z = np.array([[*first[i][1], 1.0] for i in ids])
        w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], quality.RIDGE * len(y))
        ridge[-1] = 1e-9
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w = w + np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(ridge + 1e-9), z.T @ (y - p) - ridge * w)
        weights, bias = w[:-1], w[-1]

    def evidence(text):
        if not (text or "").encode().split():
            return quality.NO_WORDS
        return float(np.clip(quality.features(text.encode()) @ weights + bias, -20, 20))
    e = [evidence(r[1]) for r in rows]
    p = [1 / (1 + math.exp(-x)) for x in e]
    host, path = defaultdict(list), defaultdict(list)
    for r, x in zip(rows, p, strict=True):
        host[r[3]].append(round(x, 6))
        path[r[3], r[2]].append(round(x, 6))
    n = len(rows)
    rate = min(1 - 1e-6, max(1e-6, sum(map(sum, host.values())) / n))

    def strength(groups, centre, free):
        """Moments: what the groups' means differ by beyond the noise of their sizes."""
        excess = sum(len(g) * (sum(g) / len(g) - centre(k)) ** 2 for k, g in groups.items())
        noise, spread = rate * (1 - rate), n - sum(len(g) ** 2 for g in groups.values()) / n
        tau = (excess - free * noise) / max(spread, 1e-9) if len(groups) > free > 0 else 0
        return min(quality.MAX_STRENGTH, max(1.0, noise / tau - 1)) if tau > 0 else quality.MAX_STRENGTH
    of_host = strength(host, lambda k: rate, len(host) - 1)
    of_path = strength(path, lambda k: sum(host[k[0]]) / len(host[k[0]]), len(path) - len(host))

    def logit(x):
        x = min(max(x, 1e-9), 1 - 1e-9)
        return math.log(x / (1 - x))
    out = []
    for r, x, own in zip(rows, e, p, strict=True):
        h, g = host[r[3]], path[r[3], r[2]]
        at_host = (sum(h) - own + of_host * rate) / (len(h) - 1 + of_host)
        at_path = (sum(g) - own + of_path * at_host) / (len(g) - 1 + of_path)
        out.append(1 / (1 + math.exp(-(x + logit(at_path) - logit(rate)))))
    return out


def hit_by(rows, items):
    """Whether each text holds a window of an item, by every window's words."""
    windows = defaultdict(set)
    for text in items:
        w = cases.word_list(text)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows[len(w[i:i + 10])].add(tuple(w[i:i + 10]))
    out = []
    for r in rows:
        w = cases.word_list(r[1])
        out.append(any(tuple(w[i:i + k]) in some for k, some in windows.items() for i in range(len(w) - k + 1)))
    return out


def plain_mix(rows):
    """The mix by walking round each source's stream until its words are taken."""
    sizes: dict = defaultdict(int)
    for r in rows:
        sizes[r[3]] += cases.size(r[1])
    out = []
    for source, target in cases.targets(dict(sizes)).items():
        left = math.floor(target + 0.5)
        some = [r for r in rows if r[3] == source and cases.size(r[1])]
        some.sort(key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] is not None, r[0] or 0,
                                 cases.size(r[1])))
        while left > 0:
            for r in some:
                n = min(left, cases.size(r[1]))
                if n == cases.size(r[1]):
                    out.append(r)
                elif n:
                    cut = re.match(r"(?:[\x20\x09-\x0D]*[^\x20\x09-\x0D]+){%d}" % n, r[1])[0]
                    out.append((*r[:1], cut, *r[2:4], len(cut)))
                left -= n
    return out


# ---- tests ------------------------------------------------------------------

@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Test documents and awkward ones with extra columns whose names clash, their labels and benchmark."""
    at = str(tmp_path_factory.mktemp("pipeline"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("bigint"))
    awkward = [(None if r[0] is None else r[0] + 100_000, *r[1:]) for r in cases.awkward()]
    docs = docs.unionByName(cases.frame(spark, awkward)).withColumns({c: F.lit(f"x-{c}") for c in EXTRA})
    docs.repartition(5).write.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic")
    labels.unionByName(cases.labels(spark).withColumn("doc_id", F.col("doc_id") + 100_000)).write.parquet(f"{at}/labels.parquet")
    cases.benchmark(spark).unionByName(spark.read.parquet(f"{SF}/benchmark.parquet").select(
        F.col("item_id").cast("bigint"), "text")).write.parquet(f"{at}/benchmark.parquet")
    return at


def _rows(docs):
    """Documents as tuples, the extra columns checked and left out."""
    rows = docs.collect()
    assert all(r[c] == f"x-{c}" for r in rows for c in EXTRA)
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows]


def test_stages_are_the_plain_ones(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages, columns = dict(corpus_pipeline.STAGES), docs.columns
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "mixing", "token_files"]

    def step(name, docs):
        out = stages[name](spark, docs, tables)
        assert name == "token_files" or out.columns == columns
        path = f"{tables}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    rows = _rows(docs)
    labelled = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{tables}/labels.parquet").collect()]
    scores = plain_quality(rows, labelled)
    got = quality.classify(docs, spark.read.parquet(f"{tables}/labels.parquet")).collect()
    assert np.allclose(sorted(r.score for r in got), sorted(scores), atol=1e-6)
    docs = step("quality", docs)
    kept = _rows(docs)
    assert Counter(kept) == Counter(r for r, s in zip(rows, scores, strict=True) if s >= 0.5)
    assert 100 < len(kept) < len(rows)

    docs = step("near_duplicates", docs)
    one = _rows(docs)
    group = {r: g for r, (*_, g) in zip(kept, cases.grouped(kept), strict=True)}
    low: dict = {}
    for r, g in group.items():
        if r[0] is not None:
            low[g] = min(low.get(g, r[0]), r[0])
    assert Counter(group[r] for r in one) == Counter(set(group.values()))        # one of each group, every group
    assert all(r[0] == low.get(group[r]) for r in one) and len(one) < len(kept)

    docs = step("decontamination", docs)
    clean = _rows(docs)
    items = [r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    assert Counter(clean) == Counter(r for r, hit in zip(one, hit_by(one, items), strict=True) if not hit)
    assert len(clean) < len(one)

    docs = step("mixing", docs)
    mixed = _rows(docs)
    assert Counter(mixed) == Counter(plain_mix(clean))
    assert max(Counter(r[0] for r in mixed).values()) > 1

    last = cases.rows_of(step("token_files", docs).select("doc_id", "start", "n_tokens", "ids_crc32"))
    assert last == sorted(cases.token_files(mixed), key=repr)

    run = queries.QUERIES.get("pipeline", corpus_pipeline.run)(spark, tables)
    assert cases.rows_of(run.select("doc_id", "start", "n_tokens", "ids_crc32")) == last


@pytest.mark.parametrize("empty", ["documents", "labels", "benchmark"])
def test_empty_tables_pass_every_stage(spark, tables, tmp_path, empty):
    for name in ("documents", "labels", "benchmark"):
        t = spark.read.parquet(f"{tables}/{name}.parquet")
        (t.limit(0) if name == empty else t).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(rows) > 0) == (empty != "documents")
