"""Toxic passages by maximum-scoring segments over token log-odds.

1. Tokens are words (lower case; runs of Unicode letters, digits and the marks
   on them) and, for words that were never seen, their beginnings
   (``MIN_TERM`` to ``MAX_TERM`` characters).  In scripts without blanks every
   character begins a token, the next ``MAX_GRAM`` characters, whose beginnings
   from ``MIN_GRAM`` on are overlapping grams.  A term's log-odds between
   toxic and clean labelled documents is smoothed with an informative
   Dirichlet prior (the term's share in both kinds together).  Kept are the
   terms that toxic documents hold more often than chance allows: by the tail
   of the binomial distribution (its Chernoff bound, exact for terms that no
   clean document holds), the threshold set so that the share kept by chance
   is ``FALSE_TERMS``; it follows the number of labels and of terms.  A word
   scores as its longest kept
   beginning; all other words share one negative score, the log-ratio of
   their shares in the two kinds.
2. A linear-time scan (all maximal-scoring subsequences) finds every passage
   whose score no extension or part improves.
3. Extreme-value calibration: under clean text a maximal score S among n words
   has P(S > x) = 1 - exp(-K n e^(-lambda x)); lambda solves
   E[e^(lambda s)] = 1 over the clean distribution of scores, K is its maximum
   likelihood estimate on clean labelled documents.  A passage is significant
   if its expected number K n e^(-lambda S) is below ``E_VALUE``.  A document's
   score is a logistic function, fitted on the same rows, of its best
   passage's normalised score lambda S - ln(K n) and its number of
   significant passages.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import add_columns, slices, smallest_hashes, texts
from kestrel.llm.quality import logistic, training_labels
from kestrel.session import materialize

MAX_LABELLED = 20_000     # labelled rows that the model is fitted on (of each label, those with the smallest id hashes)
MAX_TERMS = 20_000        # terms of the model: the most significant ones
MIN_TERM, MAX_TERM = 4, 12
MIN_GRAM, MAX_GRAM = 2, 4
PRIOR = 0.05              # strength of the Dirichlet prior, as a share of all counted terms
FALSE_TERMS = 0.04        # share of the kept terms that may be there by chance
MIN_LOG_ODDS = 1.5
E_VALUE = 0.01
NO_PASSAGE = -10.0        # normalised score of a document without any toxic term


# Thai, Lao, Tibetan, Myanmar, Khmer, kana, Han: written without blanks between words.
_UNSPACED = ((0xE00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100), (0x31F0, 0x3200),
             (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xA9E0, 0xAA00), (0xAA60, 0xAA80), (0xF900, 0xFB00), (0xFF66, 0xFFA0),
             (0x1B000, 0x1B170), (0x20000, 0x32400))


def _word_characters() -> tuple[str, str]:
    """Character classes (ranges of a pattern) of words: with blanks between them, and without."""
    out: tuple[list, list] = ([], [])
    spaceless = bytearray(0x32400)
    for lo, hi in _UNSPACED:
        spaceless[lo:hi] = b"\1" * (hi - lo)
    for c in range(0x32400):
        ch = chr(c)
        if ch.isalnum() or c in (0x200C, 0x200D) or unicodedata.category(ch)[0] == "M":
            runs = out[spaceless[c]]
            if not runs or runs[-1][1] != c - 1:
                runs.append([c, c])
            else:
                runs[-1][1] = c
    spaced, unspaced = ("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) for runs in out)
    return spaced, unspaced


_SPACED_CLASS, _UNSPACED_CLASS = _word_characters()
_RUN = re.compile(f"[{_SPACED_CLASS}]+|[{_UNSPACED_CLASS}]+")
_NO_BLANKS = re.compile(f"[{_UNSPACED_CLASS}]")
_LATIN = bytes(c if chr(c).isalnum() else 32 for c in range(256))     # U+0000 to U+00FF, the same words faster


def tokens(text: str) -> list[str]:
    """Words in order; in a run of a script without blanks, the characters from each one on."""
    text = text.lower()
    try:
        return text.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        runs = _RUN.findall(text)
    if not _NO_BLANKS.search("".join(set(text))):
        return runs
    out: list[str] = []
    for run in runs:
        if _NO_BLANKS.match(run):
            out.extend(run[i:i + MAX_GRAM] for i in range(len(run)))
        else:
            out.append(run)
    return out


def terms(word: str) -> list[str]:
    """Beginnings of a word that may be terms, the shortest first; a shorter word is its own only term."""
    least, most = (MIN_GRAM, MAX_GRAM) if word[0] >= "\u0e00" and _NO_BLANKS.match(word) else (MIN_TERM, MAX_TERM)
    return [word[:k] for k in range(least, min(most, len(word)) + 1)] or [word]


def maximal_segments(at: list[int], score: list[float], rest: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score), in order, of a sequence in which the positions ``at`` have
    the positive ``score`` and every other position the negative ``rest``.

    Linear time: each positive position becomes a candidate, which joins the
    nearest earlier one that begins lower, if that ends lower too; every
    candidate keeps the place of that nearest one, so the search skips those between.
    """
    kept: list[list] = []        # begin, end, sum before the segment, sum up to its end, the nearest that begins lower
    total, last = 0.0, 0
    for i, s in zip(at, score, strict=True):
        total += rest * (i - last)
        last = i + 1
        new = [i, i + 1, total, total + s, -1]
        total += s
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= new[2]:
                j = kept[j][4]
            new[4] = j
            if j < 0 or kept[j][3] >= new[3]:
                break
            new = [kept[j][0], new[1], kept[j][2], new[3], -1]
            del kept[j:]
        kept.append(new)
    return [(b, e, right - left) for b, e, left, right, _ in kept]


@dataclass
class Model:
    scores: dict[str, float] = field(default_factory=dict)
    rest: float = -0.01
    lam: float = 1.0
    k: float = 1.0
    weights: tuple[float, float] = (0.0, 0.0)
    bias: float = -5.0

    def __post_init__(self):
        self.stems = {t[:MIN_TERM] for t in self.scores}
        self.grams = {t[:MIN_GRAM] for t in self.scores if _NO_BLANKS.match(t)}

    def hits(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(place, longest kept beginning) of every word that has one."""
        stems, grams, scores = self.stems, self.grams, self.scores
        for i in [i for i, w in enumerate(words) if w[:MIN_TERM] in stems or w[:MIN_GRAM] in grams]:
            t = next((t for t in reversed(terms(words[i])) if t in scores), None)
            if t is not None:
                yield i, t

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of words, and the maximal-scoring passages (begin, end, score) in words."""
        words = tokens(text)
        found = list(self.hits(words))
        return len(words), maximal_segments([i for i, _ in found], [self.scores[t] for _, t in found], self.rest)

    def normalised(self, score: float, n: int) -> float:
        """lambda S - ln(K n): the log of the inverse of the expected number of such passages in clean text."""
        return self.lam * score - math.log(self.k * max(n, 1))

    def features(self, text: str) -> tuple[float, float]:
        n, found = self.passages(text)
        if not found:
            return NO_PASSAGE / 10, 0.0
        values = [self.normalised(s, n) for _, _, s in found]
        significant = sum(v > -math.log(E_VALUE) for v in values)
        return max(NO_PASSAGE, min(30.0, max(values))) / 10, math.log1p(significant)

    def score(self, text: str) -> float:
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x * self.weights[0] + y * self.weights[1] + self.bias))))


def _count_terms(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, toxic, clean): labelled documents of each kind that hold a term; and the totals of both columns."""
    def count(batches):
        found = (Counter(), Counter())
        for b in batches:
            for toxic, text in zip(b.column("toxic").to_pylist(), texts(b), strict=True):
                found[toxic > 0].update({t for w in set(tokens(text)) for t in terms(w)})
        for toxic, counter in enumerate(found):
            if counter:
                n = np.fromiter(counter.values(), np.int64, len(counter))
                z = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(counter), pa.string()), pa.array(n if toxic else z), pa.array(z if toxic else n)],
                    names=["term", "toxic", "clean"])
    counts = (sample.select("toxic", "text").mapInArrow(count, "term string, toxic bigint, clean bigint")
              .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    counts = materialize(counts, "terms")
    total = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    return counts, total[0] or 0, total[1] or 0


def _tail(t: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Chernoff bound of log P(t or more of n documents are toxic), where each is with probability ``p``."""
    t, n = np.asarray(t, float), np.asarray(n, float)
    c = n - t
    with np.errstate(divide="ignore", invalid="ignore"):
        out = -(np.where(t > 0, t * np.log(t / (n * p)), 0) + np.where(c > 0, c * np.log(c / (n * (1 - p))), 0))
    return np.where(t > n * p, out, 0.0)


def _by_chance(limit: float, n: np.ndarray, terms: np.ndarray, p: float) -> float:
    """How many of ``terms[i]`` terms in ``n[i]`` documents each reach the log-probability ``limit`` by chance."""
    low, high = np.floor(n * p), n + 1.0            # the least number of toxic documents that reaches it is in (low, high]
    while (high - low > 1).any():
        middle = np.floor((low + high) / 2)
        reaches = _tail(np.minimum(middle, n), n, p) <= limit
        low, high = np.where(reaches, low, middle), np.where(reaches, middle, high)
    return float((terms * np.where(high <= n, np.exp(_tail(np.minimum(high, n), n, p)), 0.0)).sum())


def _significant(counts: DataFrame, toxic: int, clean: int) -> list:
    """Terms with significant log-odds under the informative Dirichlet prior: (term, log_odds, toxic, clean).

    The threshold is the weakest at which the terms expected by chance (each
    term's own number of documents considered) are ``FALSE_TERMS`` of those
    that pass.  Only counts of counts reach the driver.
    """
    p = toxic / (toxic + clean)
    strength = PRIOR * (toxic + clean)
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("clean"))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(a / (toxic + strength - a)) - F.log(b / (clean + strength - b))
    rows = counts.select("term", odds.alias("log_odds"), "toxic", "clean").where(F.col("log_odds") >= MIN_LOG_ODDS)
    held = counts.groupBy((F.col("toxic") + F.col("clean")).alias("n")).agg(F.count("*").alias("terms")).collect()
    n, terms = (np.array([r[k] for r in held], float) for k in ("n", "terms"))
    kinds = rows.groupBy("toxic", "clean").agg(F.count("*").alias("terms")).collect()
    tail = _tail(np.array([r.toxic for r in kinds]), np.array([r.toxic + r.clean for r in kinds]), p)
    passing = sum(r.terms for r in kinds)
    order = sorted(range(len(kinds)), key=lambda i: (-tail[i], kinds[i].toxic))
    kept = {}
    for at, i in enumerate(order):
        if _by_chance(tail[i], n, terms, p) <= FALSE_TERMS * passing:
            kept = {(kinds[k].toxic, kinds[k].clean): float(tail[k]) for k in order[at:]}
            break
        passing -= kinds[i].terms
    if not kept:
        return []
    kept = rows.sparkSession.createDataFrame([(*k, v) for k, v in kept.items()], "toxic long, clean long, tail double")
    rows = rows.join(F.broadcast(kept), ["toxic", "clean"]).select("term", "log_odds", "tail", "toxic", "clean")
    return rows.orderBy("tail", "term").limit(MAX_TERMS).collect()


def _lambda(background: list[tuple[float, float]]) -> float:
    """The positive root of sum(p e^(lambda s)) = 1 over (p, s), whose mean score is negative."""
    def excess(x):
        return sum(p * math.exp(min(700.0, x * s)) for p, s in background) - 1
    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def sampled_labels(labels: DataFrame, limit: int) -> tuple[DataFrame, float]:
    """(doc_id, toxic) of at most ``limit`` labelled ids (rules as in ``training_labels``), and the log-ratio of the
    shares of toxic and of clean ids taken.

    Each label has half the places, and those that the other one leaves.
    """
    rows = materialize(training_labels(labels, "toxic"), "labels")
    n = {bool(r.t): r.n for r in rows.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    take = min(toxic, max(limit // 2, limit - clean))
    rest = min(clean, limit - take)
    first = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = smallest_hashes(rows.where("toxic > 0"), take, *first).unionByName(smallest_hashes(rows.where("toxic <= 0"), rest, *first))
    return ids, math.log(take / toxic / (rest / clean)) if take and rest else 0.0


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Fit on ``labels.toxic`` of at most ``limit`` documents outside the held-out fifth, rare labels first.

    Texts alone are looked at.  The model's size is bounded by ``MAX_TERMS``: of the terms that pass the test, the most
    significant ones.  The intercept is corrected for the shares in
    which the labels were sampled.  Without labels of both kinds the model has
    no terms and scores every text alike, low.
    """
    ids, ratio = sampled_labels(labels, limit)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    sample = materialize(sample.dropDuplicates(["doc_id", "text"]), "labelled")
    counts, toxic, clean = _count_terms(sample)
    if not toxic or not clean:
        return Model()
    rows = _significant(counts, toxic, clean)
    model = Model({r.term: r.log_odds for r in rows})

    def shares(batches):        # words, and words that score, in the documents of each kind
        n = np.zeros((2, 2), np.int64)
        by = Counter()
        for b in batches:
            for label, text in zip(b.column("toxic").to_pylist(), texts(b), strict=True):
                words = tokens(text)
                hits = [t for _, t in model.hits(words)]
                n[int(label > 0)] += (len(words), len(hits))
                if not label:
                    by.update(hits)
        out = [*[(None, int(k), int(w), int(h)) for k, (w, h) in enumerate(n)], *[(t, 0, 0, c) for t, c in by.items()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
            names=["term", "kind", "words", "hits"])
    found = (sample.select("toxic", "text").mapInArrow(shares, "term string, kind int, words bigint, hits bigint")
             .groupBy("term", "kind").agg(F.sum("words").alias("words"), F.sum("hits").alias("hits")).collect())
    total = {r.kind: (r.words, r.hits) for r in found if r.term is None}
    own = {r.term: r.hits for r in found if r.term is not None}
    q = (total[1][1] + 0.5) / (total[1][0] + 1)                      # share of scoring words in toxic text
    p = (total[0][1] + 0.5) / (total[0][0] + 1)                      # and in clean text
    model.rest = min(-1e-4, math.log((1 - q) / (1 - p)))
    each = 0.5 / max(1, len(model.scores))
    background = [((own.get(t, 0) + each) / (total[0][0] + 1), s) for t, s in model.scores.items()]
    model.lam = _lambda([(1 - sum(x for x, _ in background), model.rest), *background])

    def best(batch):
        out = []
        for text in texts(batch):
            n, segments = model.passages(text)
            out.append((max(n, 1), max((s for _, _, s in segments), default=0.0)))
        return [[x[0] for x in out], [x[1] for x in out]]
    made = add_columns(sample, {"n": "bigint", "best": "double"}, lambda: best, ["toxic"])
    low = made.where("toxic = 0").agg(F.count("*").alias("docs"), F.sum(
        F.col("n") * F.exp(-F.lit(model.lam) * F.col("best"))).alias("mass")).first()
    model.k = max(1e-9, low.docs / low.mass) if low.mass else 1.0
    rows = add_columns(sample, {"x": "double", "y": "double"},
                       lambda: lambda b: [list(c) for c in zip(*map(model.features, texts(b)), strict=True)] or [[], []],
                       ["doc_id", "toxic"]).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x, r.y))
    w, bias = logistic(np.array([(r.x, r.y) for r in rows]), np.array([float(r.toxic > 0) for r in rows]))
    model.weights, model.bias = (float(w[0]), float(w[1])), bias - ratio
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) plus ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5), from whole texts.

    NULL, empty and word-less texts score as texts without any toxic term; equal texts score alike.
    """
    out = add_columns(docs, {"score": "double"}, lambda: lambda b: [[model.score(t) for t in texts(b)]], keep)
    names = [c for c in out.columns if c != "predicted"]
    return out.select(*names, F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Every significant passage: doc_id, first_word, last_word (exclusive; places in ``tokens``), score, e_value."""
    def run(batches):
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
                n, found = model.passages(t)
                for begin, end, s in found:
                    e = math.exp(min(700.0, -model.normalised(s, n)))
                    if e < E_VALUE:
                        rows.append((d, begin, end, s, e))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "first_word", "last_word", "score", "e_value"])
    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, first_word bigint, last_word bigint, score double, e_value double")
