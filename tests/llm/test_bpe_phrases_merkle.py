"""Byte-level BPE against its library; phrases and the Merkle manifest against plain versions."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from kestrel.llm import byte_bpe, collocations, merkle
from kestrel.llm.queries import QUERIES

from . import cases

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return byte_bpe.Codec(RANKS)


# ---- 11: byte-level BPE ----------------------------------------------------

def _same(codec, library, texts):
    ids, bounds = codec.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode_ordinary(t or ""), t
    assert [bytes(x) for x in codec.decode(ids, bounds)] == [(t or "").encode() for t in texts]


def test_perfect_hash_is_minimal(codec):
    keys = [b"a", b"ab", b"ba", b"\x00", b"\x00\x00"] + [b"%d" % i for i in range(3000)]
    h = byte_bpe.PerfectHash(keys)
    data, offsets = byte_bpe._packed(keys)
    assert h.slots(byte_bpe.hashes(data, offsets)).tolist() == list(range(len(keys)))
    assert sorted(h.key_at.tolist()) == list(range(len(keys)))


def test_bpe_pretokens(codec, library):
    _same(codec, library, ["", None, " ", "  ", "\n", "'s", " 's", "  's", "x's's", "''s", "'re'll've'", "a'really", "'", "''",
                           "s'", "x  \n y", "x \n\n  y'd", "I'Ll'll", "a'", "'l", "'le", "don't 1'd", "z" * 70_000, "'s" * 500])
    rng = random.Random(1)
    alphabet = "aZé日ñ'''stdmrevl   \n\t\r\x0b　  12٣½!?.,;-_́𝔘\x1c\x85﻿​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(5000)]
    _same(codec, library, texts)


def test_bpe_sees_every_character_as_the_library_does(codec, library):
    every = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    # Each between a letter, a blank, a digit, two blanks and a letter: its class decides where the pre-tokens begin.
    for i in range(0, len(every), 40_000):
        _same(codec, library, ["".join(f"a{c} {c}1{c}  {c}b" for c in every[j:j + 40]) for j in range(i, min(i + 40_000, len(every)), 40)])


def test_bpe_cuts_long_texts(library):
    rng = random.Random(2)
    words = ["the", " ", "  ", "\n", "naïve", "don't", "日本語", "　", "!?", "12345", "x" * 50, "'s", "𝔘"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(300))) for _ in range(100)]
    for size in (7, 64, 1000):
        _same(byte_bpe.Codec(RANKS, piece_bytes=size), library, texts)


@pytest.mark.parametrize("awkward", [True, False])
def test_bpe_operators(spark, docs, library, awkward):
    df = cases.frame(spark, clashing=True) if awkward else docs
    rows = cases.awkward() if awkward else [tuple(r) for r in docs.collect()]
    got = byte_bpe.decode(byte_bpe.encode(df, RANKS), RANKS).select("doc_id", "ids", "decoded").collect()
    want = [(r[0], library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got), key=repr) == sorted(want, key=repr)
    digests = [(i, len(t), hashlib.sha256(",".join(map(str, t)).encode()).hexdigest(), hashlib.sha256(d).hexdigest()) for i, t, d in want]
    assert cases.rows_of(byte_bpe.round_trip(df, RANKS, keep=["doc_id"])) == sorted(digests, key=repr)


def test_bpe_decodes_null_and_refuses_strangers(spark, codec):
    rows = spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert [bytes(r.decoded) for r in byte_bpe.decode(rows, RANKS).collect()] == [b"", b""]
    with pytest.raises(ValueError):
        codec.decode(np.array([10**6]), np.array([0, 1]))
    assert byte_bpe.round_trip(cases.frame(spark, []), RANKS).count() == 0


# ---- 12: collocations ------------------------------------------------------

def _counts(rows, longest):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", cases.lower_az(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    return f, n


def _collocations(rows, least, longest=5, top=2000):
    out = []
    f, n = _counts(rows, longest)
    for lang, c in f.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i:i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1)
                  if 100 * b >= 100 * c[q[i:i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in inside:
                s, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((s, a, " ".join(p), c[p[:k]], c[p[k:]]))
        scored.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, x, y, n[lang], s) for i, (s, a, p, x, y) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def test_index_counts_phrases_both_ways():
    rng = random.Random(3)
    for _ in range(40):
        text = np.array([*rng.choices(range(rng.choice([3, 6, 40])), k=rng.randrange(300)), 0], np.int32)
        index = collocations.BidirectionalIndex(text, 5)
        for k, at, n in [x for longest in (2, 3, 4, 5) for x in index.ngrams(longest)]:
            want = collections.Counter(tuple(text[i:i + k].tolist()) for i in range(len(text) - k + 1) if 0 not in text[i:i + k])
            assert {tuple(text[i:i + k].tolist()): m for i, m in zip(at.tolist(), n.tolist(), strict=True)} == dict(want)
        # The two intervals stay in step, whichever side is extended first.
        one = index.words()
        a, b = index.right(*index.left(*one)[1])[1], index.left(*index.right(*one)[1])[1]
        assert sorted(zip(*map(np.ndarray.tolist, a), strict=True)) == sorted(zip(*map(np.ndarray.tolist, b), strict=True))


@pytest.mark.parametrize("least,top,shard", [(3, 50, 1000), (2, 10**9, 1 << 21)])
def test_collocations(spark, docs, least, top, shard):
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert cases.rows_of(collocations.collocations(docs, least, top=top, shard_words=shard)) == _collocations(rows, least, top=top)


@pytest.mark.parametrize("longest", [2, 3, 6])
def test_phrases_and_their_extensions(spark, docs, longest):
    f, n = _counts([(r.text, r.lang) for r in docs.collect()], longest)
    got, sizes = collocations.phrases(docs, 20, longest, 5000)
    want = {}
    for lang, c in f.items():
        for p, a in c.items():
            if a >= 20:
                want[lang, " ".join(p)] = [len(p), a, None, None]
        for p, a in c.items():
            if a >= 20 and len(p) > 1:
                for side, q in ((2, p[1:]), (3, p[:-1])):
                    own = want[lang, " ".join(q)]
                    own[side] = max(own[side] or 0, a)
    assert {(r.lang, r.phrase): [r.k, r.f, r.left, r.right] for r in got.collect()} == want
    assert {r.lang: r.n for r in sizes.collect()} == dict(n)


def test_collocations_of_awkward_documents(spark):
    rows = cases.awkward() + [(20 + i, "One\ttwo,  THREE four\x0bfive one two " * 3, None, "a", 1) for i in range(4)]
    got = cases.rows_of(collocations.collocations(cases.frame(spark, rows, clashing=True), 2))
    assert got == _collocations([(r[1], r[2]) for r in rows], 2) and got
    assert collocations.collocations(cases.frame(spark, [])).count() == 0
    assert collocations.collocations(cases.frame(spark, [(1, None, None, None, None), (2, "a", "en", "x", 1)]), 1).count() == 0


def test_scores_pass_64_bits(spark):
    score = spark.sql("SELECT cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) "
                      "div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s "
                      "FROM VALUES (4000000000L, 90000000000000L, 4000000001L, 4100000000L) AS t(a, n, l, r)").first().s
    assert score == 1000 * 4000000000 * 90000000000000 // (4000000001 * 4100000000)


# ---- 13: Merkle manifest ---------------------------------------------------

def _digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _tree(nodes):
    """(root, for each node its siblings before and after it, level by level)."""
    proofs, owners = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, above_owners = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i:i + 8]
            for j in range(len(run)):
                for o in owners[i + j]:
                    proofs[o].append((run[:j], run[j + 1:]))
            above.append(_digest(*run))
            above_owners.append([o for j in range(len(run)) for o in owners[i + j]])
        nodes, owners = above, above_owners
    return nodes[0] if nodes else None, proofs


def _manifest(rows):
    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            changed = cases.lower_az(text)
        head = [_value(x) for x in (doc_id, source, lang, n)]
        groups[lang].append((doc_id, _digest(*head, _value(text)), _digest(*head, _value(changed))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        trees[g] = _tree([r[1] for r in groups[g]])
    root, top = _tree([trees[g][0] for g in order])
    out = []
    for g, upper in zip(order, top, strict=True):
        for (doc_id, leaf, now), lower in zip(groups[g], trees[g][1], strict=True):
            for before, after in lower + upper:
                now = _digest(*before, now, *after)
            proof = _digest(*[x for before, after in lower + upper for x in before + after])
            out.append((doc_id, leaf, trees[g][0], root, proof, now, now == root))
    return sorted(out, key=repr)


def _query(df):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return merkle.manifest(df, {"text": F.when(tampered, merkle.lower_az(F.col("text"))).otherwise(F.col("text"))})


@pytest.mark.parametrize("kind", ["awkward", "table", "one", "many groups", "one group"])
def test_manifest(spark, docs, kind):
    rows = {"awkward": cases.awkward(), "table": [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()],
            "one": [(7, "Only", "en", "a", 4)], "many groups": [(i, f"Text {i}", f"l{i % 700}", "a", i) for i in range(1500)],
            "one group": [(i // 2, f"Text {i}", None, "a", i) for i in range(4200)]}[kind]
    got = cases.rows_of(_query(cases.frame(spark, rows, clashing=kind == "awkward")))
    assert got == _manifest(rows)
    assert {r[-1] for r in got} == ({True, False} if len(rows) > 1 else {False} if zlib.crc32(b"7") % 3 == 0 else {True})


def test_proofs_fold_by_themselves(spark, docs):
    got = merkle.manifest(docs, with_proofs=True).collect()
    assert all(r.verified and merkle.fold(r.leaf, r.proof) == r.root for r in got)
    assert all(merkle.fold("0" * 64, r.proof) != r.root for r in got)
    assert merkle.manifest(cases.frame(spark, [])).count() == 0


def test_equal_rows_spread_over_ranges(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("grp"), F.lit(1).alias("x"))
    placed = merkle.places(rows, [F.col("grp"), F.col("x")], "grp")
    assert sorted(r.at for r in placed.collect()) == list(range(20_000))
    parts = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(8, "grp", "x", "_tie")
    sizes = [r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5_000


# ---- the registered queries ------------------------------------------------

def test_registered_queries(spark, docs, library):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert cases.rows_of(QUERIES["op13_merkle_manifest"](spark, SF)) == _manifest(rows)
    assert cases.rows_of(QUERIES["op12_collocations"](spark, SF)) == _collocations([(r[1], r[2]) for r in rows], 100)
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    for r in rows:
        assert got[r[0]].n_tokens == len(library.encode_ordinary(r[1] or ""))
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
