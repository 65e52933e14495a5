"""Secret scan: candidates by pattern, false positives removed by a random forest.

1. Candidates, anywhere in a whole text: runs of 16 or more characters of the
   alphabets keys are written in, with a digit among them, and the parts that
   dots join to them; what stands in quotes after a naming word (4 characters
   or more, any but blanks); passwords in URLs.
2. Their features: length and character classes; how likely their character
   transitions are in the corpus's words; how much of them dictionary words
   cover (both learnt from all documents); the path (the document's source);
   the neighbouring words before, and the marks around.
3. A random forest is trained on labelled findings and gives each candidate
   the probability of being a secret.

Where no labelled findings are given, ``seed_labels`` marks candidates of a
bounded sample: assigned in quotes to a name that says it is secret, or of the
published form of a known key, is a secret; a run of digits only, a part of a
mail address, host or path is none; others aren't used.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import slices, smallest_hashes, text_bytes, texts
from kestrel.llm.decontaminate import words_of
from kestrel.session import materialize

MAX_FINDINGS = 20_000      # labelled findings that the forest is trained on (of each label, the smallest hashes)
UNKNOWN = 0.25             # probability of a candidate that neither a forest nor a seed speaks for
DICTIONARY_WORDS = 20_000  # the most frequent words
TREES, DEPTH, SEED = 20, 6, 42
NEIGHBOURS = 16            # buckets of the word before a candidate
PATHS = 8                  # buckets of the path
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9_\-+/])(?=[A-Za-z_\-+/]*[0-9])[A-Za-z0-9_\-+/]{16,}={0,2}(?![A-Za-z0-9_\-+/])")
_DOTTED = re.compile(r"[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)*")
_DOTTED_AFTER = re.compile(r"(?:\.[A-Za-z0-9_\-]+)+")
_QUOTED = re.compile(r"(?i)(?:token|secret|passwo?r?d|pwd|api_?key|credential|auth_?key|private_?key)[\"']?\s{0,4}[:=]\s{0,4}"
                     r"(?:\"([^\"\s]{4,})\"|'([^'\s]{4,})')")
_IN_URL = re.compile(r"://[^\s/@:\"']*:([^\s/\"']+)@(?=[A-Za-z0-9\[])")
_BEFORE = re.compile(r"([A-Za-z_][A-Za-z0-9_\-]*)([^A-Za-z0-9]{0,6})$")
# Names that say a value is secret, and published key forms.
_NAMES = re.compile(r"(?i)(token|secret|passw(or)?d|pwd|api_?key|credential|auth_?key|private_?key)$")
_FORMS = re.compile(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{24,}|AIza[0-9A-Za-z_\-]{35}"
                    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]*)$")
_HOST_OR_FILE = re.compile(r"^[A-Za-z0-9_\-]+(\.[A-Za-z0-9_\-]+)*\.[a-z]{2,5}$")
_CLASSES = 30              # 26 letters, digit, mark, begin, end


def classes(text: bytes) -> np.ndarray:
    a = np.frombuffer(text.lower(), np.uint8)
    out = np.full(len(a), 27, np.int64)
    letter, digit = (a >= 97) & (a <= 122), (a >= 48) & (a <= 57)
    out[letter] = a[letter] - 97
    out[digit] = 26
    return out


def corpus_language(docs: DataFrame) -> tuple[np.ndarray, frozenset[str]]:
    """Log-probabilities of character transitions in words, and the most frequent words, over all documents.

    Counts combine per batch and again before the shuffle; the transition
    table (a fixed size) and ``DICTIONARY_WORDS`` words reach the driver.
    """
    def count(batches):
        for b in batches:
            counts: Counter[bytes] = Counter()
            for t in text_bytes(b):
                counts.update(words_of(t))
            few = [(w.decode(), n) for w, n in counts.items() if len(w) >= 3]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in few], pa.string()), pa.array([n for _, n in few], pa.int64())],
                                             names=["word", "n"])
    words = materialize(docs.select("text").mapInArrow(count, "word string, n bigint")
                        .groupBy("word").agg(F.sum("n").alias("n")), "words")

    def transitions(batches):
        total = np.zeros(_CLASSES * _CLASSES, np.int64)
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                c = classes(w.encode())
                np.add.at(total, np.concatenate(([28], c)) * _CLASSES + np.concatenate((c, [29])), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "n"])
    rows = words.mapInArrow(transitions, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    table = np.ones(_CLASSES * _CLASSES)
    for r in rows:
        table[r["at"]] += r["n"]
    table = table.reshape(_CLASSES, _CLASSES)
    return np.log(table / table.sum(axis=1, keepdims=True)), frozenset(_most_frequent(words.where(F.length("word") <= 24), DICTIONARY_WORDS))


def _most_frequent(words: DataFrame, limit: int) -> list[str]:
    """The first ``limit`` of ``words`` (word, n) by falling n, then by word.

    The count from which words are in is found first, from counts of counts, so
    that about ``limit`` words leave the executors, not as many from each partition.
    """
    power = F.floor(F.log2(F.col("n").cast("double") + 0.5))
    have, cut = 0, None
    for r in sorted(words.groupBy(power.alias("k")).count().collect(), key=lambda r: -r["k"]):      # at most 64 rows
        if have + r["count"] >= limit:
            cut = r["k"]
            break
        have += r["count"]
    if cut is None:
        return [r["word"] for r in words.select("word").collect()]           # fewer than the limit
    for r in sorted(words.where(power == cut).groupBy("n").agg(F.count("*").alias("c")).collect(), key=lambda r: -r["n"]):
        least = r["n"]
        if have + r["c"] >= limit:
            break
        have += r["c"]
    rows = words.where(F.col("n") > least).select("word").collect()
    return [r["word"] for r in [*rows, *words.where(F.col("n") == least).orderBy("word").limit(limit - have).select("word").collect()]]


def dictionary_cover(text: str, words: frozenset[str]) -> float:
    """Share of the characters that words of the dictionary cover, longest first from the left."""
    low, i, covered = text.lower(), 0, 0
    while i < len(low):
        step = next((k for k in range(min(12, len(low) - i), 2, -1) if low[i:i + k] in words), 0)
        covered += step
        i += step or 1
    return covered / len(low)


def features(value: str, before: str, mark: str, after: str, path: str, table: np.ndarray, words: frozenset[str]) -> list[float]:
    n = len(value)
    kinds = Counter("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value)
    entropy = -sum(v / n * math.log2(v / n) for v in Counter(value).values())
    c = classes(value.encode())
    chain = table[np.concatenate(([28], c)), np.concatenate((c, [29]))].mean()
    near, place = [0.0] * NEIGHBOURS, [0.0] * PATHS
    if before:
        near[xxhash.xxh64_intdigest(before.lower(), 1) % NEIGHBOURS] = 1.0
    place[xxhash.xxh64_intdigest(path, 2) % PATHS] = 1.0
    return [float(n), kinds["d"] / n, kinds["u"] / n, kinds["l"] / n, kinds["o"] / n, entropy, float(chain),
            dictionary_cover(value, words), float(bool(re.fullmatch("[0-9a-fA-F]+", value))),
            float(bool(_NAMES.search(before))), float("=" in mark or ":" in mark), float(mark[-1:] in "\"'" and mark != ""),
            float(after[:1] in "\"'" and after != ""), float(mark[-1:] in "@./" and mark != ""), *near, *place]


def seed_label(value: str, before: str, mark: str, after: str) -> int | None:
    """1: a secret, 0: none, None: not known; by rules of high precision."""
    if _FORMS.match(value) or _NAMES.search(before) and re.fullmatch(r"\s*[:=]\s*[\"']", mark) and after[:1] in ("'", '"'):
        return 1
    if value.isdigit() or mark[-1:] in ("@", "/") or after[:1] in ("@",) or _HOST_OR_FILE.match(value):
        return 0
    return None


class _Runs:
    """Words joined by single dots, in the order of the text."""

    def __init__(self, text: str):
        self.found = _DOTTED.finditer(text)
        self.at = next(self.found, None)

    def start(self, end: int) -> int:
        """Where the run that the dot at ``end`` goes on begins (``end + 1``: no word stands before it); ends only grow."""
        while self.at is not None and self.at.end() < end:
            self.at = next(self.found, None)
        return self.at.start() if self.at is not None and self.at.start() < end <= self.at.end() else end + 1


def spans(text: str) -> list[tuple[int, int, bool]]:
    """(begin, end, password of a URL) of every candidate: passwords in URLs, values quoted after a naming word, and
    runs of key characters with the parts that dots join to them; of overlapping ones the first kind."""
    found = [(*m.span(1), True) for m in _IN_URL.finditer(text)] if "://" in text else []
    found += [(*m.span(m.lastindex), False) for m in _QUOTED.finditer(text)]
    taken, last = sorted(found), 0
    out: list[tuple[int, int, bool]] = []
    for b, e, u in taken:
        if not out or b >= out[-1][1]:
            out.append((b, e, u))
    special = list(out)
    at, dotted = 0, None             # runs of words joined by dots, read along with the candidates
    for m in _CANDIDATE.finditer(text):
        b, e = m.span()
        if b < last:
            continue                 # a part of the dotted one before
        if text[b - 1:b] == "." and b > 1:
            dotted = dotted or _Runs(text)
            first = max(last, dotted.start(b - 1))
            b = first + (text[first] == ".") if first < b else b
        right = _DOTTED_AFTER.match(text, e) if text[e:e + 1] == "." else None
        e = right.end() if right else e
        last = e
        while at < len(special) and special[at][1] <= b:
            at += 1
        if at == len(special) or special[at][0] >= e:
            out.append((b, e, False))
    return sorted(out)


_SCHEMA = "doc_id bigint, first_char bigint, last_char bigint, value string, features array<double>, seed int"


def candidates(docs: DataFrame, table: np.ndarray, words: frozenset[str], path: str = "source") -> DataFrame:
    """Every candidate of every whole text, with its features: doc_id, first_char, last_char (exclusive, in code
    points), value, features, seed (``seed_label``)."""
    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.int32())
        for b in slices(batches):
            rows = []
            places = b.column(path).cast(pa.string()).to_pylist()
            for d, t, place in zip(b.column("doc_id").to_pylist(), texts(b), places, strict=True):
                for begin, end, in_url in spans(t):
                    around = _BEFORE.search(t[max(0, begin - 64):begin])
                    before, mark = around.groups() if around else ("", t[max(0, begin - 1):begin])
                    after = t[end:end + 1]
                    value = t[begin:end]
                    rows.append((d, begin, end, value, features(value, before, mark, after, place or "", table, words),
                                 1 if in_url else seed_label(value, before, mark, after)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "first_char", "last_char", "value", "features", "seed"])
    return docs.select("doc_id", "text", path).mapInArrow(run, _SCHEMA)


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source",
                 limit: int = MAX_FINDINGS) -> DataFrame:
    """Candidates of every whole text and the forest's verdict, a row for each.

    Columns: doc_id, first_char, last_char, value_sha256 (the value itself is
    not handed on), probability, secret (probability >= 0.5).
    ``labelled``: findings (doc_id, first_char, label 0/1) to train on
    instead of the seeds.  At most ``limit`` are used, distinct by value and
    features, of each label those with the smallest hashes.  Where the
    findings don't hold both labels, no forest can be trained and a
    candidate's probability is its seed label (unknown: ``UNKNOWN``, not a
    secret).  Texts without candidates (NULL and empty ones) give no row;
    repeated rows repeat theirs; a NULL path is the path ''.
    """
    # What is written holds digests of the values, not the values.
    found = candidates(docs, *corpus_language(docs), path).withColumns(
        {"h": F.xxhash64("value", "features"), "value_sha256": F.sha2(F.col("value").cast("binary"), 256)}).drop("value")
    found = materialize(found, "candidates")
    if labelled is None:
        train = found.where("seed is not null").select("features", F.col("seed").cast("double").alias("label"), "h")
    else:
        l = labelled.select(F.col("doc_id").alias("d"), F.col("first_char").alias("f"), F.col("label").cast("double").alias("label"))
        train = found.join(l, (F.col("doc_id") == F.col("d")) & (F.col("first_char") == F.col("f"))).select(
            "features", "label", "h")
    # Copies of a finding count once; each label has half the places, and those that the other one leaves.
    train = train.dropDuplicates(["label", "h"])
    train = materialize(train.select(array_to_vector("features").alias("x"), "label", "h"), "distinct_findings")
    n = {r["label"] > 0: r["count"] for r in train.groupBy((F.col("label") > 0).cast("double").alias("label")).count().collect()}
    yes, no = n.get(True, 0), n.get(False, 0)
    take = min(yes, max(limit // 2, limit - no))
    train = smallest_hashes(train.where("label > 0"), take, F.col("h")).unionByName(
        smallest_hashes(train.where("label <= 0"), min(no, limit - take), F.col("h")))
    train = materialize(train.select("x", "label"), "findings")
    kinds = train.groupBy("label").count().collect()
    rows = found
    if len(kinds) < 2:
        scored = rows.withColumn("probability", F.coalesce(F.col("seed").cast("double"), F.lit(UNKNOWN)))
    else:
        least = min(r["count"] for r in kinds)
        weights = {r["label"]: least / r["count"] for r in kinds}        # both kinds weigh alike
        train = train.withColumn("w", F.when(F.col("label") > 0, weights[1.0]).otherwise(weights[0.0]))
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="w", probabilityCol="p", numTrees=TREES,
                                        maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(train)
        scored = forest.transform(rows.withColumn("x", array_to_vector("features")))
        scored = scored.withColumn("probability", vector_to_array("p")[1])
    return scored.select("doc_id", "first_char", "last_char", "value_sha256", "probability",
                         (F.col("probability") >= 0.5).alias("secret"))
