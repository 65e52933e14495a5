"""Quality by hierarchical empirical Bayes: document evidence with host- and path-level posteriors.

1. A document classifier (logistic regression on shape features of the whole
   text, fitted on a bounded sample of labelled rows) gives each document's
   log-odds of being good.
2. Grouped aggregates over all documents give every host's and every path's
   expected number of good documents.  Method-of-moments estimates of the
   variance between hosts, and between paths of a host, give the strengths
   with which sparse hosts shrink to the global rate and sparse paths to
   their host.
3. A document's score adds its evidence to the log-odds by which its path's
   posterior (the document itself left out) differs from the global rate.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import add_columns, smallest_hashes, text_bytes
from kestrel.session import materialize

MAX_LABELLED = 20_000     # labelled rows the classifier is fitted on (those with the smallest id hashes)
RIDGE = 1e-4              # L2 penalty per labelled row
NO_WORDS = -20.0          # evidence of a text without words
MAX_STRENGTH = 1e6
MICRO = 1_000_000         # probabilities are summed in whole millionths: the sums don't depend on the order
REJECT_BELOW = 0.5

_PUNCTUATION = np.array([c for c in range(33, 127) if not chr(c).isalnum()])
_PAIR = re.compile(rb"[!-/:-@\[-`{-~]{2}(?=\s|$)")
N_FEATURES = len(_PUNCTUATION) + 13


def features(text: bytes) -> np.ndarray:
    """Shape features of a whole text, each about 0 to 1 (square roots of shares)."""
    out = np.zeros(N_FEATURES)
    n = len(text)
    words = text.split()
    if not words:
        return out
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    k = len(_PUNCTUATION)
    out[:k] = hist[_PUNCTUATION] / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    sentences = [x for x in re.split(rb"[.!?]\s", text) if x.strip()]
    kinds = len(set(words))
    out[k:] = (hist[65:91].sum() / n, hist[97:123].sum() / n, hist[48:58].sum() / n, hist[10] / n,
               hist[128:].sum() / n, hist[32] / n, 1 - len(set(lines)) / len(lines),
               1 - len(set(sentences)) / len(sentences) if sentences else 0, len(_PAIR.findall(text)) / len(words),
               min(1.0, n / len(words) / 25), min(1.0, np.log1p(len(words)) / 12),
               (np.log(kinds) / np.log(len(words)) if len(words) > 1 else 1.0) ** 2,
               sum(map(operator.eq, words, words[1:])) / len(words))
    return np.sqrt(out)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def evidence(self, text: bytes) -> float:
        """Log-odds that the text is good; ``NO_WORDS`` for a text without words."""
        if not text.split():
            return NO_WORDS
        return float(np.clip(features(text) @ self.weights + self.bias, -20, 20))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the intercept is not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(z.shape[1], ridge * len(x))
    penalty[-1] = 1e-9
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def training_labels(labels: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    """(doc_id, value) of at most ``limit`` (None: all) labelled ids outside the held-out fifth, the smallest id hashes first.

    An id labelled more than once counts as ``value`` = its largest label; rows without an id or label are left out.
    """
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull())
            .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
            .groupBy("doc_id").agg(F.max(value).cast("int").alias(value)))
    return rows if limit is None else smallest_hashes(rows, limit, F.xxhash64("doc_id"), F.col("doc_id"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Fit the document classifier on ``labels.quality``; without labels of both kinds all evidence is 0.

    Only the sample's ids are broadcast and only its feature vectors reach the driver (both bounded by ``limit``).
    """
    sample = training_labels(labels, "quality", limit)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(sample), "doc_id")
    rows = add_columns(rows, {"x": "array<double>"}, lambda: lambda b: [[features(t).tolist() for t in text_bytes(b)]],
                       ["doc_id", "quality", "h"])
    # A repeated id counts once: the text with the smallest hash.
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), F.struct("h", "x")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.quality for r in rows], float)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(N_FEATURES), 0.0)
    return Model(*logistic(np.array([r.x for r in rows]), y))


def evidence(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) plus ``evidence``, from each whole text."""
    return add_columns(docs, {"evidence": "double"},
                       lambda: lambda b: [[model.evidence(t) for t in text_bytes(b)]], keep)


def _p(e: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-e))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
    return F.log(q / (F.lit(1.0) - q))


@dataclass
class Prior:
    rate: float
    host_strength: float
    path_strength: float


def _strength(excess: float, rows: float, squares: float, groups: int, free: int, rate: float) -> float:
    """Prior strength rate(1-rate)/tau2 - 1, tau2 the method-of-moments variance between groups."""
    noise = rate * (1 - rate)
    tau2 = (excess - free * noise) / max(rows - squares / max(rows, 1), 1e-9) if groups > free > 0 else 0.0
    return float(min(MAX_STRENGTH, max(1.0, noise / tau2 - 1))) if tau2 > 0 else MAX_STRENGTH


def groups(scored: DataFrame, host: Column, path: Column) -> tuple[DataFrame, Prior]:
    """Path table (g_host, g_path, host_n, host_s, path_n, path_s) and the global prior, from all documents.

    ``scored`` has ``evidence``.  Counts and sums of probabilities combine
    before the shuffle, so a host with a third of all rows costs nothing extra.
    NULL hosts and paths are groups of their own.
    """
    p = F.round(_p(F.col("evidence")) * MICRO).cast("long")
    paths = (scored.select(host.alias("g_host"), path.alias("g_path"), p.alias("p"))
             .groupBy("g_host", "g_path").agg(F.count("*").alias("path_n"), F.sum("p").alias("path_u")))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("g_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_u").alias("host_u"))
    both = paths.join(hosts.withColumnRenamed("g_host", "h2"), F.col("g_host").eqNullSafe(F.col("h2"))).drop("h2")
    both = both.select("g_host", "g_path", "path_n", (F.col("path_u") / MICRO).alias("path_s"), "host_n",
                       (F.col("host_u") / MICRO).alias("host_s"))
    total = paths.agg(F.sum("path_n").alias("n"), F.sum("path_u").alias("u")).first()
    n = float(total.n or 0)
    rate = min(1 - 1e-6, max(1e-6, (total.u or 0) / MICRO / n)) if n else 0.5
    h = hosts.select(F.col("host_n").alias("n"), (F.col("host_u") / MICRO / F.col("host_n")).alias("r")).agg(
        F.sum(F.col("n") * (F.col("r") - rate) ** 2).alias("e"), F.sum(F.col("n") ** 2).alias("q"), F.count("*").alias("g")).first()
    w = both.agg(F.sum(F.col("path_n") * (F.col("path_s") / F.col("path_n") - F.col("host_s") / F.col("host_n")) ** 2).alias("e"),
                 F.sum(F.col("path_n") ** 2).alias("q"), F.count("*").alias("g")).first()
    return materialize(both, "posteriors"), Prior(
        rate, _strength(h.e or 0.0, n, h.q or 0.0, h.g, h.g - 1, rate),
        _strength(w.e or 0.0, n, w.q or 0.0, w.g, w.g - h.g, rate))


def combine(scored: DataFrame, table: DataFrame, prior: Prior, host: Column, path: Column) -> DataFrame:
    """``scored`` plus ``site_rate`` (its path's posterior without the document) and ``score`` (0 to 1).

    The path table is written beforehand, so Spark knows its size: below the
    broadcast threshold it is sent to the tasks, above it the join is shuffled
    and a hot host is split by adaptive execution.
    """
    keep = [c for c in scored.columns if c not in ("site_rate", "score")]
    j = scored.select(*keep, host.alias("__host"), path.alias("__path")).join(
        table, F.col("__host").eqNullSafe(F.col("g_host")) & F.col("__path").eqNullSafe(F.col("g_path")), "left")
    own = _p(F.col("evidence"))
    at_host = ((F.col("host_s") - own + prior.host_strength * prior.rate)
               / (F.col("host_n") - 1 + prior.host_strength))
    at_path = (F.col("path_s") - own + prior.path_strength * at_host) / (F.col("path_n") - 1 + prior.path_strength)
    rate = F.coalesce(at_path, F.lit(prior.rate))
    score = _p(F.col("evidence") + _logit(rate) - _logit(F.lit(prior.rate)))
    return j.select(*keep, rate.alias("site_rate"), score.alias("score"))


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
             limit: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, evidence, site_rate, score (0 to 1), kept (score >= 0.5).

    A text without words (NULL, empty, only spaces) has evidence -20 and is
    rejected; repeated rows are scored alike; an empty table gives an empty
    result.  ``host`` and ``path`` name columns (here a document's source
    and, within it, its language).
    """
    model = fit(docs, labels, limit)
    scored = materialize(evidence(docs, model, list(dict.fromkeys(["doc_id", host, path]))), "evidence")
    table, prior = groups(scored, F.col(host), F.col(path))
    out = combine(scored, table, prior, F.col(host), F.col(path))
    return out.select("doc_id", "evidence", "site_rate", "score", (F.col("score") >= REJECT_BELOW).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang",
              limit: int = MAX_LABELLED) -> DataFrame:
    """``docs`` without the rejected documents, all columns unchanged (rules as in ``classify``).

    Evidence is computed twice, once for the posteriors and once beside the
    texts, so that no text is shuffled.
    """
    columns = docs.columns
    model = fit(docs, labels, limit)
    narrow = [c for c in dict.fromkeys([host, path])]
    table, prior = groups(materialize(evidence(docs, model, narrow), "evidence"), F.col(host), F.col(path))
    clash = {c: f"__in_{c}" for c in columns if c in ("evidence", "site_rate", "score") or c in table.columns}
    named = docs.withColumnsRenamed(clash)
    scored = combine(evidence(named, model), table, prior, F.col(clash.get(host, host)), F.col(clash.get(path, path)))
    return scored.where(F.col("score") >= REJECT_BELOW).select(*[F.col(clash.get(c, c)).alias(c) for c in columns])
