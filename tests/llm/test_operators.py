"""Each operator against a plain version: on the awkward documents, on a test table, and on empty tables."""

from __future__ import annotations

import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kestrel.llm import (decontaminate, licenses, mixing, prefix_hash, quality, secrets, simhash, tokenfile, tokenizing,
                         toxicity)
from kestrel.session import scratch_path

from . import cases

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def doc_rows(docs):
    return [tuple(r) for r in docs.collect()]


# ---- 1: fingerprints ------------------------------------------------------

def _fingerprints(rows):
    def last(v):
        return (v is None, -(v or 0))
    order = sorted(rows, key=lambda r: (last(r[0]), cases.xxh(r[1] or ""), r[1] or ""))
    out = []
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        out.append((r[0], text, prefix_hash.edited(text, following), following))
    return out


@pytest.mark.parametrize("awkward", [True, False])
def test_fingerprints(spark, docs, doc_rows, awkward):
    import hashlib
    rows = cases.awkward() if awkward else doc_rows
    got = prefix_hash.fingerprints(cases.frame(spark, clashing=True) if awkward else docs).collect()
    want = []
    for doc_id, text, changed, following in _fingerprints(rows):
        want.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(),
                     len(os.path.commonprefix([text, changed])), len(os.path.commonprefix([text, following]))))
    key = [(r.doc_id, r.n_chars, r.edited_sha256, r.prefix_edited, r.prefix_next) for r in got]
    assert sorted(key, key=repr) == sorted(want, key=repr)
    by_text = {}
    for text, r in ((next(x[1] for x in rows if x[0] == r.doc_id and len(x[1] or "") == r.n_chars) or "", r) for r in got):
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(text, set()).add(r.fingerprint)
        if r.n_chars > 40 and len(set(text)) > 5:
            assert r.near_edited > 0.3
    assert all(len(v) == 1 for v in by_text.values())
    assert len({f for v in by_text.values() for f in v}) == len(by_text)


def test_prefix_hashes_answer_spans():
    rng = random.Random(1)
    text = "".join(rng.choice("ab") for _ in range(400))
    other = text[:123] + "c" + text[124:]
    for block in (50, 1 << 18):
        assert prefix_hash.Document(text, block).common_prefix(prefix_hash.Document(other, block)) == 123
    x = prefix_hash.PrefixHashes(prefix_hash.code_points(text))
    for _ in range(300):
        i, j, n = rng.randrange(380), rng.randrange(380), rng.randrange(1, 20)
        assert x.same(i, x, j, n) == (text[i:i + n] == text[j:j + n])
    assert (prefix_hash.Document(text, 50).sketch == prefix_hash.Document(text).sketch).all()


def test_likeness_follows_the_shared_part():
    words = [f"word{i}" for i in range(500)]
    text = " ".join(words)
    f = prefix_hash.Document(text).fingerprint()
    for share in (0.9, 0.5):
        k = int(500 * share)
        changed = " ".join(words[:k] + [f"new{i}" for i in range(500 - k)])
        assert abs(prefix_hash.likeness(f, prefix_hash.Document(changed).fingerprint()) - share) < 0.25
    assert prefix_hash.likeness(f, prefix_hash.Document(" ".join(f"q{i}z" for i in range(400))).fingerprint()) < 0.1


# ---- 2: mixing ------------------------------------------------------------

@pytest.mark.parametrize("awkward", [True, False])
@pytest.mark.parametrize("block", [50, 1000, mixing.BLOCK_WORDS])
def test_mixing(spark, docs, doc_rows, awkward, block):
    rows = cases.awkward() if awkward else doc_rows
    mixed, slots = mixing.mix(cases.frame(spark, clashing=True) if awkward else docs, block)
    got = mixed.collect()
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + cases.size(r[1])
    target = cases.targets(sizes)
    assert sorted(((r.doc_id, r.size, r.source_size) for r in got), key=repr) == sorted(
        ((r[0], cases.size(r[1]), sizes[r[3]]) for r in rows), key=repr)
    taken = {}
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    # The slots' pieces hold each document as often as was counted, and fill the slots.
    pieces = mixing.block_documents(mixed, slots).withColumn("w", F.col("to_word") - F.col("from_word"))
    per_slot = {(r.source, r["rank"]): r.w for r in pieces.groupBy("source", "rank").agg(F.sum("w").alias("w")).collect()}
    plan = slots.collect()
    assert per_slot == {(r.source, r["rank"]): r.last_word - r.first_word for r in plan}
    steps = sorted(r.step for r in plan)
    assert len(set(steps)) == len(steps)
    per_doc, want = {}, {}
    for r in pieces.groupBy("doc_id").agg(F.sum("w").alias("w")).collect():
        per_doc[r.doc_id] = r.w
    for r in got:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert per_doc == {k: v for k, v in want.items() if v}


def test_taken_comes_from_the_blocks(spark, docs, monkeypatch):
    """Without a source's slots, nothing of it is taken; the registered mix spreads every source over its sequence."""
    plan = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda t, block: plan(t, block).where("source <> 'src3'"))
    taken = {r.source: r.w for r in mixing.mix(docs, 100)[0].groupBy("source").agg(F.sum("taken").alias("w")).collect()}
    assert taken["src3"] == 0 and min(w for s, w in taken.items() if s != "src3") > 0
    monkeypatch.undo()
    documents, slots = mixing.mix(docs, 50)
    order = [r.source for r in slots.orderBy("step").collect()]
    share = {r.source: r.target for r in documents.select("source", "target").distinct().collect()}
    total = sum(share.values())
    for n in range(50, len(order), 50):
        for source, target in share.items():
            assert abs(order[:n].count(source) - target / total * n) <= 14


def test_resample_is_what_the_blocks_hold(spark):
    """A plain mixer: each source's shuffled stream, taken word by word up to its target."""
    rng = random.Random(5)
    rows = [(i % 37 or None, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))), "en", f"s{i % 4}", 0) for i in range(200)]
    got = sorted((r.source, r.text) for r in mixing.resample(cases.frame(spark, rows), 16).collect())
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + cases.size(r[1])
    want = []
    takes = mixing.shuffled(mixing.row_marks(cases.frame(spark, rows)).withColumn("size", mixing.word_count(F.col("text"))))
    stream: dict = {}
    for r in sorted(takes.collect(), key=lambda r: r.begin):
        if r["size"]:
            stream.setdefault(r.source, []).append(r.text)
    for source, target in cases.targets(sizes).items():
        left, texts, at = round(target), stream[source], 0
        while left > 0:
            words = texts[at % len(texts)].split()
            want.append((source, " ".join(words[:left])))
            left, at = left - len(words), at + 1
    assert [(s, " ".join(t.split())) for s, t in got] == sorted(want)


def test_rows_that_differ_in_a_map_are_different_rows(spark):
    df = spark.sql("SELECT 1 AS doc_id, 'a b' AS text, 's' AS source, m FROM VALUES (map('k', 1)), (map('k', 2)), (NULL) AS t(m)")
    assert mixing.distinct_rows(mixing.row_marks(df)).count() == 3
    assert mixing.resample(df, 1).count() == 3


def test_schedule_is_low_discrepancy(spark):
    targets = spark.createDataFrame([("a", 100.0), ("b", 200.0), ("c", 700.0)], "source string, target double")
    order = [r.source for r in mixing.schedule(targets, 1).orderBy("step").collect()]
    assert len(order) == 1000
    for n in (50, 100, 500, 900):
        for source, share in (("a", 0.1), ("b", 0.2), ("c", 0.7)):
            assert abs(order[:n].count(source) - share * n) <= 12


def test_resample(spark, docs, doc_rows):
    for df, rows in ((docs, doc_rows), (cases.frame(spark, clashing=True), None)):
        out = mixing.resample(df, 100)
        assert out.columns == df.columns
        words = {r.source: r.w for r in out.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()}
        takes, _ = mixing.mix(df, 100)
        want = {r.source: r.w for r in takes.groupBy("source").agg(F.sum("taken").alias("w")).collect()}
        assert words == {k: v for k, v in want.items() if v}


def test_resample_repeats_whole_documents(spark):
    rows = [(i, f"a{i} b c d", "en", "big", 9) for i in range(90)] + [(1000, "x y\tz", "en", "small", 5)]
    got = {r["doc_id"]: r["n"] for r in mixing.resample(cases.frame(spark, rows), 7).groupBy("doc_id").agg(
        F.count("*").alias("n")).collect()}
    assert got[1000] == 3            # its target stops at three times its size


# ---- 3, 10: tokens --------------------------------------------------------

@pytest.mark.parametrize("awkward", [True, False])
def test_token_counts(spark, docs, doc_rows, awkward):
    lib = cases.library()
    rows = cases.awkward() if awkward else doc_rows
    got = tokenizing.count_tokens(cases.frame(spark, clashing=True) if awkward else docs, cases.VOCABULARY, keep=["doc_id"])
    want = []
    for r in rows:
        n = len(lib.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 2048))
    assert cases.rows_of(got) == sorted(want, key=repr)


@pytest.mark.parametrize("chunk,overlap", [(64, 4), (300, 20), (1000, 1)])
def test_overlaps_resynchronise(doc_rows, chunk, overlap):
    lib, enc = cases.library(), tokenizing.Encoder(cases.VOCABULARY, chunk, overlap)
    odd = ["x" * 3000 + " ab " + "y" * 900 + "\n" + "q", "!? " * 700, "don't  I'll\t\tgo <|endoftext|> x <|startoftext|>y " * 40,
           "Hello, WORLD!! (it's) Émile... Ñandú%%% x<y> A-B a. ÀÉ, o'Neill; ǅ ß! 'S 'Tis ÷× n~ ~~ ab~, " * 30,
           "é́ ́b ΣΑΣ Σ 日本語   \x0b\x0c\x1c! " * 60, " " * 500 + "a" + " " * 500, "z" * 4000]
    for t in [r[1] for r in doc_rows[:120]] + odd:
        assert enc.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_other_vocabularies():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert not tokenizing.splits_at_blanks(path) and tokenizing.splits_at_blanks(cases.VOCABULARY)
    text = "Hello  world, it's\n\nfine <|endoftext|> ñ"
    assert tokenizing.Encoder(path).ids(text).tolist() == Tokenizer.from_file(path).encode(
        text, add_special_tokens=False).ids
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert tokenizing.Encoder(path).ids(text).tolist() == sentencepiece.SentencePieceProcessor(
        model_file=path).encode(text)


def test_simple8b_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 59, 60, 61, 1000, 5000):
        for high in (2, 100, 65_536, 2 ** 40, 2 ** 60, 2 ** 64 - 1):
            v = rng.integers(0, high, n, dtype=np.uint64)
            if n > 5:
                v[::3] = 7
                v[n // 2] = high - 1
            assert (tokenfile.decode(*tokenfile.encode(v), n) == v).all()
    assert len(tokenfile.encode(np.zeros(600, np.uint64))[0]) == 10


@pytest.mark.parametrize("awkward", [True, False])
def test_token_files(spark, docs, doc_rows, awkward):
    path = scratch_path(spark, "test-tokens")
    tokenfile.write(cases.frame(spark, clashing=True) if awkward else docs, path, cases.VOCABULARY, block_ids=500)
    want = cases.token_files(cases.awkward() if awkward else doc_rows)
    assert cases.rows_of(tokenfile.read_documents(spark, path)) == sorted(want, key=repr)
    ids = {(r.doc_id, r.start): r.ids for r in tokenfile.read_documents(spark, path, with_ids=True).collect()}
    assert all(len(ids[d, s]) == n and ids[d, s][-1] == 1 for d, s, n, _ in want)


# ---- 4: licenses ----------------------------------------------------------

def test_licenses(spark, docs, doc_rows):
    lines = {t: n for n, t in licenses.TEMPLATES.items() if n.endswith("-line")}
    want = []
    for r in doc_rows:
        for line, name in lines.items():
            want += [(r[0], name, m.start(), m.end()) for m in re.finditer(re.escape(line.rstrip(".")), r[1] or "")]
    got = licenses.scan_licenses(docs).where("coverage = 1")
    assert cases.rows_of(got.select("doc_id", "license", "first_char", "last_char")) == sorted(want, key=repr)
    found = licenses.scan_licenses(cases.frame(spark, clashing=True)).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in found] == [(16, "MIT-line", 1.0)]


def test_license_alignment_bridges_edits():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    words = licenses.TEMPLATES["MIT"].split()
    for changed in (words[:20] + words[23:], words[:30] + ["some", "new", "words"] + words[30:], ["Zwar"] + words + ["und"]):
        (name, m, coverage, first, end), = index.scan(" ".join(changed).encode())
        assert name == "MIT" and coverage > 0.9 and end - first <= len(decontaminate.words_of(" ".join(changed).encode()))
    assert index.scan(" ".join(words[:20]).encode()) == []
    twice = " ".join(["Released under the MIT License."] * 2).encode()
    assert [(n, a, b) for n, _, _, a, b in index.scan(twice)] == [("MIT-line", 0, 5), ("MIT-line", 5, 10)]


def test_sibling_licenses_are_told_apart(spark):
    work = "This work is licensed under the GNU {} Public License, version {}."
    texts = {work.format("Lesser General", "3"): "LGPL-3.0-line", work.format("Affero General", "3"): "AGPL-3.0-line",
             work.format("General", "2"): "GPL-2.0-line", "Licensed under CC BY 4.0.": "CC-BY-4.0-line",
             "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0-line", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-line",
             licenses.TEMPLATES["BSD-3-Clause"]: "BSD-3-Clause", licenses.TEMPLATES["BSD-2-Clause"]: "BSD-2-Clause",
             "under the GNU General Public License version 3 or later": "GPL-3.0-or-later-line"}
    others = [work.format("Foo General", "3"), work.format("General", "3.5"), "under the GPLv3+", "under the Lesser GPL version 3"]
    part = " ".join(licenses.TEMPLATES["MIT"].split()[:20])
    rows = [(i, f"Before it {t} after it", "en", "a", 0) for i, t in enumerate([*texts, *others, part])]
    got = {r.doc_id: r for r in licenses.scan_licenses(cases.frame(spark, rows)).collect()}
    assert [(got[i].license, got[i].kind) for i in range(len(texts))] == [(n, "whole") for n in texts.values()]
    assert all((got[len(texts) + i].license, got[len(texts) + i].kind) == (None, "similar") for i in range(len(others)))
    last = got[len(rows) - 1]
    assert (last.license, last.kind, last.matched_words) == ("MIT", "part", 20) and last.coverage < 0.4
    assert (last.first_word, last.last_word) == (2, 22)


def _plain_alignment(template, words, shift, band, part):
    """Cell by cell: (matched words, first word, end)."""
    far = -10 ** 9
    none = (0, 0, 0)
    row = {k: none for k in range(2 * band + 1)}
    best = (0 if part else far, 0, 0, 0)
    for i, t in enumerate(template):
        new = {}
        for k in range(2 * band + 1):
            j = i + shift - band + k
            s, m, f = row.get(k + 1, none if part else (far, 0, 0))
            cell = (s - 1, m, f)
            if 0 <= j < len(words):
                s, m, f = row[k]
                met = (s + 1, m + 1, f if m else j) if words[j] == t else (s - 1, m, f if m else j)
                if met[0] > cell[0]:
                    cell = met
                    if part and words[j] == t and cell[0] > best[0]:
                        best = (*cell, j + 1)
            if k and new[k - 1][0] - 1 > cell[0]:
                cell = (new[k - 1][0] - 1, *new[k - 1][1:])
            new[k] = none if part and cell[0] <= 0 else cell
        row = new
    if not part:
        for k, (s, m, f) in row.items():
            if m and s > best[0]:
                best = (s, m, f, min(max(len(template) + shift - band + k, f + 1), len(words)))
    return best[1:]


@pytest.mark.parametrize("part", [False, True])
def test_license_alignment_by_rows_is_the_plain_one(part, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(licenses, "ALIGN_PAIRS", 64)
    for band in (1, 2, 3, 5):
        pairs = [([rng.randrange(6) for _ in range(rng.randint(1, 15))], [rng.randrange(-2, 6) for _ in range(rng.randint(0, 30))],
                  rng.randint(-5, 20)) for _ in range(400)]
        got = licenses.align_many([np.array(t) for t, _, _ in pairs], [np.array(w, np.int64) for _, w, _ in pairs],
                                  [s for _, _, s in pairs], band, part)
        assert got == [_plain_alignment(t, w, s, band, part) for t, w, s in pairs]


def test_license_scan_against_every_alignment(spark, doc_rows):
    """Each template by itself: a document has a whole or similar notice if any alignment, unindexed, has one."""
    rng = random.Random(12)
    names = ["MIT-line", "Apache-2.0-line", "GPL-3.0-line", "CC-BY-NC-4.0-line", "ISC", "MPL-2.0"]
    texts = [r[1] for r in doc_rows if r[1] and ("icense" in r[1] or r[0] % 40 == 0)][:60]
    for name in names:                  # edited wordings in running text
        for _ in range(6):
            w = licenses.TEMPLATES[name].split()
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                i = rng.randrange(len(w))
                w[i:i + 1] = rng.choice([[], ["other"], [w[i], "word"]])
            texts.append("Some words " + " ".join(w) + " and more of it")
    docs = cases.frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])
    for name in names:
        template = decontaminate.words_of(licenses.TEMPLATES[name].encode())
        got = {r.doc_id for r in licenses.scan_licenses(docs, {name: licenses.TEMPLATES[name]}).where("kind <> 'part'").collect()}
        run = licenses.GRAM + licenses.WINDOW - 1
        runs = {tuple(template[i:i + run]) for i in range(len(template) - run + 1)}
        share, want = set(), set()
        for i, t in enumerate(texts):
            words = decontaminate.words_of(t.encode())
            if any(tuple(words[j:j + run]) in runs for j in range(len(words))):
                share.add(i)
            if i in share | got and _plain_alignment(template, words, 0, len(words) + len(template), False)[0] >= (
                    licenses.MIN_COVERAGE * len(template)):
                want.add(i)
        # Winnowing promises those that share a run of words; it may find others, all of which some alignment holds.
        assert want & share <= got <= want and len(got) >= 4


def test_many_mentions_of_a_license_take_little_time():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    line = "File {} says: This work is licensed under the GNU Lesser General Public License, version 2.1 or later. "
    for text in (line.format("a") * 2000, "".join(line.format(f"n{i}") for i in range(2000))):
        begin = time.perf_counter()
        found = index.findings(text.encode())
        assert [f[0] for f in found] == ["LGPL-2.1-or-later-line"] * 2000
        assert time.perf_counter() - begin < 30          # 2 to 3 s here; cell by cell 80 s


def test_common_wordings_and_whole_texts(spark):
    t = licenses.TEMPLATES
    texts = {"This project is licensed under the terms of the MIT license.": "MIT-line",
             "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0-line",
             "Licensed under the EUPL, Version 1.2 only": "EUPL-1.2-line", "It is placed in the public domain.": "public-domain-line",
             "Copyright (c) 2020 A. Name " + t["MIT#2"]: "MIT", "ISC License " + t["ISC#2"]: "ISC", "Zero " + t["0BSD#2"]: "0BSD",
             "Copyright A. Name. All rights reserved. " + t["BSD-2-Clause#2"]: "BSD-2-Clause", t["BSD-3-Clause#3"] + " end": "BSD-3-Clause",
             t["Zlib"]: "Zlib", "Boost " + t["BSL-1.0"]: "BSL-1.0", t["Unlicense"]: "Unlicense"}
    found = licenses.scan_licenses(cases.frame(spark, [(i, x, "en", "a", 0) for i, x in enumerate(texts)]))
    got = [(r.doc_id, r.license) for r in found.where("kind = 'whole'").orderBy("doc_id").collect()]
    assert got == list(enumerate(texts.values()))
    whole = {r.template for r in found.where("kind = 'whole' and coverage = 1").collect()}
    assert {"MIT#2", "ISC#2", "0BSD#2", "BSD-2-Clause#2", "BSD-3-Clause#3", "Zlib", "BSL-1.0", "Unlicense"} <= whole


def test_license_expressions(spark):
    texts = ["SPDX-License-Identifier: MIT OR Apache-2.0", "x\n// SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND Foo-1 end",
             "SPDX-License-Identifier: MIT and Apache-2.0", "SPDX-License-Identifier: MIT OR (ISC AND GPL-3.0+)", "é MIT OR Apache-2.0"]
    rows = licenses.scan_licenses(cases.frame(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])).collect()
    got = [[(r.license, texts[r.doc_id][r.first_char:r.last_char]) for r in rows if r.doc_id == i] for i in range(len(texts))]
    tag = "SPDX-License-Identifier: "
    assert got == [[("MIT-line", tag + "MIT"), ("Apache-2.0-line", "Apache-2.0")],
                   [("GPL-2.0-line", tag.replace(": ", ": (") + "GPL-2.0-only"), (None, "Foo-1")],
                   [("MIT-line", tag + "MIT")],
                   [("MIT-line", tag + "MIT"), ("ISC-line", "ISC"), ("GPL-3.0-or-later-line", "GPL-3.0")], []]


def test_winnowing_keeps_every_shared_run():
    rng = random.Random(2)
    h = [rng.randrange(1000) for _ in range(200)]
    kept = licenses.winnow(h)
    assert all(any(i + k in kept for k in range(licenses.WINDOW)) for i in range(len(h) - licenses.WINDOW + 1))


# ---- 5: toxicity ----------------------------------------------------------

def _maximal(scores):
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                best = (total, i, j + 1)
    if best is None:
        return []
    _, i, j = best
    return _maximal(scores[:i]) + [(i, j)] + [(a + j, b + j) for a, b in _maximal(scores[j:])]


def test_maximal_segments():
    rng = random.Random(3)
    for _ in range(500):
        rest = -rng.choice([0.37, 1.13, 2.41])
        scores = [rng.choice([rest, rest, rng.random() * 3]) for _ in range(rng.randint(1, 16))]
        at = [i for i, s in enumerate(scores) if s > 0]
        got = toxicity.maximal_segments(at, [scores[i] for i in at], rest)
        assert [(b, e) for b, e, _ in got] == _maximal(scores)


def test_toxicity_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    l = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(d, l)
    held = l.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = toxicity.score(d.join(held, "doc_id"), model).select("toxic", "predicted").collect()
    true = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    assert true / sum(r.toxic for r in rows) > 0.85
    assert true / sum(r.predicted for r in rows) > 0.95
    found = toxicity.passages(d.where("doc_id < 500"), model).collect()
    assert found and all(r.e_value < toxicity.E_VALUE and r.first_word < r.last_word for r in found)


def test_toxicity_of_awkward_documents(spark):
    d = cases.frame(spark, clashing=True)
    for labelled in (cases.labels(spark), cases.labels(spark, [(1, 1, 0)]), cases.labels(spark).limit(0)):
        out = toxicity.score(d, toxicity.fit(d, labelled), ["doc_id"]).collect()
        assert len(out) == d.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_rare_toxic_labels_keep_their_terms(spark):
    docs = [(i, ("vermin moron " if i < 12 else "") + " ".join(f"w{(i * 7 + k * k) % 400:03d}x" for k in range(30)), "en", "a", 0)
            for i in range(2000)]
    d = cases.frame(spark, docs)
    labels = spark.createDataFrame([(r[0], 0, int(r[0] < 12)) for r in docs], "doc_id bigint, quality int, toxic int")
    for limit in (toxicity.MAX_LABELLED, 200):      # toxic rows are used before the others
        model = toxicity.fit(d, labels, limit)
        assert {"vermin", "moron"} <= {t.decode("utf-8", "replace") if isinstance(t, bytes) else t for t in model.scores}
        assert not any(str(t).lstrip("b'").startswith("w") for t in model.scores)
        assert model.score("vermin moron vermin moron") > model.score("w001x w002x w003x w004x")
    ids, ratio = toxicity.sampled_labels(labels, 200)
    taken = sum(r.toxic for r in ids.collect())
    assert ids.count() == 200 and taken == sum(r.toxic for r in toxicity.training_labels(labels, "toxic").collect()) and ratio > 0
    model = toxicity.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"),
                         spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert {"moron", "pathetic", "disgusting", "stupid"} <= {t.decode("utf-8", "replace") if isinstance(t, bytes) else t for t in model.scores}


def test_toxic_words_in_any_script():
    assert toxicity.tokens("“idiot” — moron\xa0scum ¡tonto! Don't") == ["idiot", "moron", "scum", "tonto", "don", "t"]
    assert toxicity.terms("придурок")[0] == "прид" and toxicity.terms("придурок")[-1] == "придурок"
    for word, text in (("笨蛋", "今天天气很好我们一起去公园散步然后回家你是笨蛋吗"), ("バカ", "きょうはいいてんきですねあなたはバカです"),
                       ("โง่", "วันนี้อากาศดีมากคุณโง่จริง"), ("idiot", "he said “idiot”"), ("придурок", "он — придурок"),
                       ("मूर्ख", "वह मूर्ख है")):
        model = toxicity.Model({word: 5.0}, rest=-1.0)
        n, found = model.passages(text)
        assert [(e - b, s) for b, e, s in found] == [(1, 5.0)], text
        assert found[0][0] < n
        assert any(word in toxicity.terms(w) for w in toxicity.tokens(text))


# ---- 6: secrets -----------------------------------------------------------

def test_secrets(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = secrets.scan_secrets(d)
    assert out.columns == ["doc_id", "first_char", "last_char", "value_sha256", "probability", "secret"]
    text = d.select(F.col("doc_id").alias("d"), "text")
    rows = out.join(text, F.col("doc_id") == F.col("d")).collect()
    assert len(rows) > 100
    for r in rows:
        value, before = r.text[r.first_char:r.last_char], r.text[:r.first_char].lower()
        if before.endswith('token = "'):
            assert r.secret
        elif value.isdigit():
            assert not r.secret


def test_secrets_of_awkward_documents(spark):
    d = cases.frame(spark, clashing=True)
    out = secrets.scan_secrets(d).collect()
    assert {(r.doc_id, r.secret) for r in out} >= {(15, True), (15, False)}
    first = min(r.first_char for r in out if r.doc_id == 15)
    given = spark.createDataFrame([(15, first, 0)], "doc_id bigint, first_char bigint, label int")
    assert len(secrets.scan_secrets(d, given).collect()) == len(out)


def test_rare_secrets_are_trained_on(spark):
    key = "AKIA" + "Z3Q7" * 4
    rows = [(i, f"number {4785380592391139 + i * 977} here", "en", "a", 0) for i in range(400)]
    rows += [(1000 + i, f"the key {key} is kept", "en", "a", 0) for i in range(2)]
    out = secrets.scan_secrets(cases.frame(spark, rows), limit=20).collect()
    assert all(r.secret == (r.doc_id >= 1000) for r in out) and len(out) == 402
    assert {round(r.probability, 6) for r in out} != {0.0, 1.0}           # by a forest, not by the seeds
    unknown = [(1, "see a1b2c3d4e5f6a7b8c9d0 there", "en", "a", 0)]
    assert [r.secret for r in secrets.scan_secrets(cases.frame(spark, unknown)).collect()] == [False]


def test_secret_candidates_of_every_form():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9PlFUP0THsR8U"
    sent = "SG.ngeVfQFYQlKU0ufo8x5d1A.TwL2iGABf9DHoTf09kqeF8tAmbihYzrnopKc1s5cr"
    for text, want in (('password = "hunter2!x9"', "hunter2!x9"), ("api_key: 'ab12cd34ef56'", "ab12cd34ef56"),
                       ('secret="correct-horse-battery-staple"', "correct-horse-battery-staple"), (f"a {jwt} b", jwt),
                       ("see https://bob:p@ss.w0rd!@db.example.org/x", "p@ss.w0rd!"), (f"key {sent}.", sent),
                       ('passwd = "p@s$.w!rd"', "p@s$.w!rd")):
        assert [text[b:e] for b, e, _ in secrets.spans(text)] == [want], text
    assert secrets.seed_label(jwt, "a", " ", " ") == secrets.seed_label(sent, "key", " ", ".") == 1
    assert secrets.seed_label("server-0123456789abc.example.org", "see", " ", " ") == 0


# ---- 7: decontamination ---------------------------------------------------

@pytest.mark.parametrize("blocks", [1, 4])
def test_decontamination(spark, docs, doc_rows, blocks):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for df, rows, items in ((docs, doc_rows, bench), (cases.frame(spark, clashing=True), cases.awkward(), cases.benchmark(spark))):
        half = items.agg(F.sum(F.length("text"))).first()[0] / 2
        block_words = decontaminate.BLOCK_WORDS if blocks == 1 else int(half / blocks) + 1
        got = decontaminate.mark(df, items, keep=["doc_id"], block_words=block_words)
        assert cases.rows_of(got) == sorted(cases.decontamination(rows, [tuple(r) for r in items.collect()]), key=repr)
        clean = decontaminate.remove(df, items, block_words=block_words)
        assert clean.columns == df.columns and clean.count() == got.where("not contaminated").count()


def test_prefix_filter_loses_nothing():
    rng = random.Random(4)
    items = [(str(i), " ".join(rng.choice("abcde") for _ in range(rng.randint(1, 14))).encode()) for i in range(30)]
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for window in (4, 10):
        index = decontaminate.WindowIndex(items, window)
        counts = np.zeros(len(index.known), np.int64)
        for t in texts:
            index.count(t.encode().split(), counts)
        index.choose_prefixes(counts)
        for t in texts:
            words = t.split()
            want = set()
            for name, item in items:
                w = item.decode().split()
                for k in range(max(1, len(w) - window + 1)):
                    piece = w[k:k + window]
                    want |= {(i, i + len(piece), name) for i in range(len(words) - len(piece) + 1) if words[i:i + len(piece)] == piece}
            b, e, w = index.match(t.encode().split())
            got = {(x, y, index.names[n]) for x, y, z in zip(b.tolist(), e.tolist(), w.tolist(), strict=True)
                   for n in index.items_of(np.array([z]))}
            assert got == want


# ---- 8: SimHash -----------------------------------------------------------

@pytest.mark.parametrize("tile_rows", [simhash.TILE_ROWS, 4])
def test_simhash(spark, docs, doc_rows, tile_rows):
    for df, rows in ((docs, doc_rows), (cases.frame(spark, clashing=True), cases.awkward())):
        got = simhash.components(df, tile_rows=tile_rows).select(
            "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
        assert cases.rows_of(got) == sorted(cases.components(rows), key=repr)
        left = simhash.representatives(df)
        assert left.columns == df.columns
        ids = [r.doc_id for r in left.select("doc_id").collect()]
        want = {r[3]: r[2] for r in cases.grouped(rows)}          # one document a group, the one with the smallest id
        assert sorted(ids, key=repr) == sorted(want.values(), key=repr)


def test_fingerprint_links_in_large_tiles(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = set(centres)
    for c in centres[:20]:
        for _ in range(120):
            x = c
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(22)          # near copies that share two bands
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "fp bigint")
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    want = {}
    for i, s in enumerate(signed):
        want.setdefault(find(i), set()).add(s)
    for tile in (simhash.TILE_ROWS, 16):
        groups = {}
        for r in simhash.contract(simhash.links(df, 2, tile)).collect():
            groups.setdefault(r.root, set()).add(r.node)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_contract_long_chain(spark):
    order = list(range(300))
    random.Random(6).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint")
    assert {r.root for r in simhash.contract(edges).collect()} == {0}
    assert simhash.contract(edges.limit(0)) is None


# ---- 9: quality -----------------------------------------------------------

def test_quality_on_held_out_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    l = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = l.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    rows = quality.classify(d, l).join(held, "doc_id").select("quality", "kept").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_sparse_sites_shrink(spark):
    rows = [(i, "t", "p", f"h{i % 4}", 1) for i in range(400)] + [(999, "t", "p", "lone", 1)]
    scored = cases.frame(spark, rows).withColumn("evidence", F.when(F.col("source") == "h0", -2.0)
                                                 .when(F.col("source") == "lone", -2.0).otherwise(2.0))
    table, prior = quality.groups(scored, F.col("source"), F.col("lang"))
    out = {r.source: r for r in quality.combine(scored, table, prior, F.col("source"), F.col("lang"))
           .dropDuplicates(["source"]).collect()}
    assert out["h0"].site_rate < 0.3 < 0.8 < out["h1"].site_rate
    assert abs(out["lone"].site_rate - prior.rate) < 0.01         # alone: nothing but the global rate is known
    assert out["h0"].score < out["lone"].score


def test_quality_of_awkward_documents(spark):
    d = cases.frame(spark, clashing=True)
    for labelled in (cases.labels(spark), cases.labels(spark).limit(0)):
        out = quality.classify(d, labelled).collect()
        assert len(out) == d.count() and all(0 <= r.score <= 1 for r in out)
        assert all(not r.kept for r in out if r.doc_id in (4, 5, 6))
        left = quality.keep_good(d, labelled)
        assert left.columns == d.columns
        assert left.count() == sum(r.kept for r in out)


# ---- empty tables ---------------------------------------------------------

def test_empty_tables(spark):
    none, items, labelled = cases.frame(spark).limit(0), cases.benchmark(spark), cases.labels(spark)
    path = scratch_path(spark, "test-empty")
    tokenfile.write(none, path, cases.VOCABULARY)
    for out in (prefix_hash.fingerprints(none), *mixing.mix(none), mixing.resample(none),
                tokenizing.count_tokens(none, cases.VOCABULARY), licenses.scan_licenses(none),
                toxicity.score(none, toxicity.fit(none, labelled)), secrets.scan_secrets(none),
                decontaminate.mark(none, items), decontaminate.remove(none, items.limit(0)), simhash.components(none),
                simhash.representatives(none), quality.classify(none, labelled), quality.keep_good(none, labelled),
                tokenfile.read_documents(spark, path)):
        assert out.count() == 0
    some = cases.frame(spark)
    assert decontaminate.mark(some, items.limit(0)).where("contaminated or n_items > 0").count() == 0


# ---- 3, 10: words apart from their marks -----------------------------------

def test_every_letter_before_every_mark():
    lib, enc = cases.library(), tokenizing.Encoder(cases.VOCABULARY)
    texts = [f"{x}{m} a{x}{m}{m}b {x}{x}{m}- {x.upper()}{m}" for x in tokenizing._LETTERS for m in tokenizing._MARKS]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for overlaps in (True, False):
        ids, n = enc.batch(pa.array(texts), overlaps)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_words_of_mixed_scripts():
    rng = random.Random(7)
    alphabet = "abzABZéÉßİıŞşǅǆŉǰΣςσЖжя日本ñ́̇𝔘ªºʼ'’\"!?.,:;-_()[]{}~`^|<>0129½٣"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 9))) for _ in range(10_000)]
    lib, enc = cases.library(), tokenizing.Encoder(cases.VOCABULARY, chunk=64, overlap=8)
    texts = [" ".join(words[i:i + n]) for i in range(0, 10_000, 50) for n in (3, 50)]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for overlaps in (True, False):
        ids, n = enc.batch(pa.array(texts), overlaps)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_counts_do_not_change_with_the_length():
    enc = tokenizing.Encoder(cases.VOCABULARY)
    lib = cases.library()
    for chars in (tokenizing.CHUNK_CHARS - 20, tokenizing.CHUNK_CHARS + 20):
        text = ("TARİHİ, ŞEHRİ. " * 3000)[:chars]
        want = lib.encode(text, add_special_tokens=False).ids
        assert all(enc.batch(pa.array([text]), o)[0].tolist() == want for o in (True, False))


# ---- 1: long texts -----------------------------------------------------------

def test_likeness_is_the_same_from_either_end():
    rng = random.Random(11)
    part = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))      # noqa: E731
    shared, a, b = part(6000), part(2000), part(2000)
    for block in (500, 1 << 18):
        f = [prefix_hash.Document(t, block).fingerprint() for t in (shared + a, shared + b, a + shared, b + shared)]
        ahead, behind = prefix_hash.likeness(f[0], f[1]), prefix_hash.likeness(f[2], f[3])
        assert abs(ahead - behind) < 1e-12 and ahead > 0.6


def test_suffix_anchors_over_blocks():
    rng = random.Random(12)
    text = "".join(rng.choices("ab", k=3001))
    x = prefix_hash.PrefixHashes(prefix_hash.code_points(text))
    lengths = prefix_hash.ANCHORS[prefix_hash.ANCHORS <= len(text)]
    want = (prefix_hash.mix64(x.spans(len(text) - lengths, np.full(len(lengths), len(text)))) >> np.uint64(56)).astype(np.uint8).tobytes()
    for block in (50, 700, 5000):
        assert prefix_hash.Document(text, block).anchors[-len(lengths):] == want


# ---- 6: long and short values ------------------------------------------------

def test_values_of_any_length_are_candidates():
    long = "Ab3" * 100
    text = f'token = "{long}" pwd="s3cr3t!!" ftp://{"u" * 300}:{"p9" * 200}@host x.{"y" * 600}.{"k1" * 10}'
    found = [text[b:e] for b, e, _ in secrets.spans(text)]
    assert long in found and "s3cr3t!!" in found and "p9" * 200 in found
    assert f'x.{"y" * 600}.{"k1" * 10}' in found


def test_dotted_candidates_as_by_the_pattern():
    rng = random.Random(8)
    before = re.compile(r"(?:[A-Za-z0-9_\-]+\.)+$")
    for _ in range(300):
        text = "".join(rng.choice(["a", "b.", ".", "..", " ", "key1key2key3key4", "/x", "-"]) for _ in range(rng.randrange(30)))
        for b, e, _ in secrets.spans(text):
            inner = secrets._CANDIDATE.search(text, b, e)
            start = inner.start() if inner else b
            left = before.search(text, 0, start) if text[start - 1:start] == "." else None
            assert b == (left.start() if left else start) or b > (left.start() if left else start)


def test_most_frequent_words(spark):
    rng = random.Random(6)
    rows = [(f"w{i}", rng.choice([1, 1, 1, 2, 3, 9, 17, 300, 5000])) for i in range(500)]
    words = spark.createDataFrame(rows, "word string, n long")
    for limit in (1, 20, 200, 499, 500, 900):
        want = [w for w, _ in sorted(rows, key=lambda r: (-r[1], r[0]))[:limit]]
        assert sorted(secrets._most_frequent(words, limit)) == sorted(want)


def test_smallest_hashes(spark):
    from kestrel.llm.common import smallest_hashes
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    want = sorted(r.h for r in rows.collect())
    for limit in (10, 1000, 19_999, 50_000):
        assert [r.h for r in smallest_hashes(rows, limit, F.col("h")).collect()] == want[:limit]


def test_no_secret_is_written(spark):
    path = secrets.materialize
    seen = []
    try:
        secrets.materialize = lambda df, name="t": (seen.append((name, df.columns)), path(df, name))[1]
        secrets.scan_secrets(cases.frame(spark)).collect()
    finally:
        secrets.materialize = path
    assert seen and all("value" not in columns for _, columns in seen)


# ---- 7: one text under many ids ----------------------------------------------

@pytest.mark.parametrize("block_words", [20, decontaminate.BLOCK_WORDS])
def test_a_third_of_the_benchmark_is_one_text(spark, block_words):
    words = cases.PROSE.split()
    items = [(i, " ".join(words[5:25])) for i in range(60)] + [(100 + i, f"item number {i} has words of its own that nobody else uses {i}") for i in range(120)]
    items += [(None, " ".join(words[5:25])), (7, None)]
    got = cases.rows_of(decontaminate.mark(cases.frame(spark), cases.benchmark(spark, items), keep=["doc_id"], block_words=block_words))
    assert got == sorted(cases.decontamination(cases.awkward(), items), key=repr)


# ---- 9: a repeated id --------------------------------------------------------

def test_one_text_of_a_repeated_id_is_learnt_from(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    again = rows + [(r[0], (r[1] or "") + " more words 123", *r[2:]) for r in rows]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    models = [quality.fit(cases.frame(spark, order).repartition(n), labels) for order, n in ((again, 1), (again[::-1], 7))]
    assert np.allclose(models[0].weights, models[1].weights)
