"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

Every item is cut into its windows: all runs of ``WINDOW_WORDS`` consecutive
words, or the whole item if it has fewer.  A window's tokens are its word
shingles.  For full containment the necessary prefix of a token set, in any
fixed order, is its first token; shingles are ordered by rarity over all
documents, so that a window is looked up by the one shingle of it that the
corpus holds least often.  In a document, each occurrence of such a shingle
names the windows that it is the prefix of; the shingle's place in the window
fixes where the window would have to begin (positional bound) and end (length
bound), and what is left is verified word by word.

Two passes over the documents (shingle counts, then matches), both map-only but
for the counts.  The benchmark is the stated query set: it is handled in
blocks of at most ``BLOCK_WORDS`` words (a longer item is a block's own), each
small enough to be sent to every task; a hot document or passage therefore
never meets in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import add_columns, text_bytes
from kestrel.session import materialize

WINDOW_WORDS = 10
SHINGLE_WORDS = 3
BLOCK_WORDS = 500_000   # benchmark words handled, and sent to each task, at a time

# Word characters: every code point but the ASCII ones outside 0-9 and letters (A-Z lower-cased).
_TABLE = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32)
               for c in range(256))
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [starts[i], starts[i] + lengths[i])."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class WindowIndex:
    """Windows of one block of benchmark items, keyed by their prefix shingle.

    Words are numbered; a shingle is the number of three word numbers (fewer
    in a shorter item), exact since numbers stay below 2^20.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW_WORDS):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.names: list[str | None] = []
        flat: list[int] = []
        found: dict[tuple[int, ...], set[int]] = {}
        names: dict[str | None, int] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            item = names.setdefault(name, len(names))
            ids = [self.number.setdefault(w, len(self.number)) for w in words]
            if len(self.number) >= 1 << 20:
                raise ValueError("a benchmark block holds over a million distinct words: lower block_words or split the item")
            for i in range(max(1, len(ids) - window + 1)):
                found.setdefault(tuple(ids[i:i + window]), set()).add(item)
        self.names = list(names)
        self.length = np.array([len(w) for w in found], np.int64)
        self.start = np.cumsum(self.length) - self.length
        for w in found:
            flat.extend(w)
        self.flat = np.array(flat, np.int64)
        owners = list(found.values())
        self.n_owners = np.array([len(o) for o in owners], np.int64)
        self.owner_at = np.cumsum(self.n_owners) - self.n_owners
        self.owners = np.array([i for o in owners for i in sorted(o)], np.int64)
        # All shingles of all windows: code, window, offset in the window.
        self.widths = sorted({int(min(n, SHINGLE_WORDS)) for n in self.length})
        code, wid, off = [], [], []
        for width in self.widths:
            own = np.flatnonzero(np.minimum(self.length, SHINGLE_WORDS) == width)
            n = self.length[own] - width + 1
            w, o = np.repeat(own, n), _runs(np.zeros(len(own), np.int64), n)
            code.append(self.codes(self.flat, self.start[w] + o, width))
            wid.append(w)
            off.append(o)
        empty = np.zeros(0, np.int64)
        self.shingle = np.concatenate([empty, *code])
        self.shingle_window = np.concatenate([empty, *wid])
        self.shingle_offset = np.concatenate([empty, *off])
        self.known = np.unique(self.shingle)

    @staticmethod
    def codes(ids: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Word numbers side by side; the top bits hold the width."""
        code = np.full(len(at), width, np.int64)
        for k in range(SHINGLE_WORDS):
            code = (code << 20) | (ids[at + k] if k < width else 0)
        return code

    def document_shingles(self, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes and positions of the document's shingles of ``width`` whose words all occur in the block."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = ids[:n] >= 0
        for k in range(1, width):
            ok &= ids[k:n + k] >= 0
        at = np.flatnonzero(ok)
        return self.codes(ids, at, width), at

    def numbers(self, words: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in words), np.int64, len(words))

    def count(self, words: list[bytes], counts: np.ndarray) -> None:
        """Add the document's occurrences of the block's shingles to ``counts`` (beside ``known``)."""
        ids = self.numbers(words)
        for width in self.widths:
            code, _ = self.document_shingles(ids, width)
            at = np.searchsorted(self.known, code)
            at = at[(at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == code)]
            np.add.at(counts, at, 1)

    def choose_prefixes(self, counts: np.ndarray) -> None:
        """Keep each window's rarest shingle only; ``counts`` stands beside ``known``."""
        rank = counts[np.searchsorted(self.known, self.shingle)]
        order = np.lexsort((self.shingle_offset, self.shingle, rank, self.shingle_window))
        first = order[np.concatenate(([True], np.diff(self.shingle_window[order]) > 0))] if len(order) else order
        first = first[np.argsort(self.shingle[first], kind="stable")]
        self.prefix = self.shingle[first]
        self.prefix_window = self.shingle_window[first]
        self.prefix_offset = self.shingle_offset[first]
        del self.shingle, self.shingle_window, self.shingle_offset, self.known

    def match(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, window) of every occurrence of a window in the document."""
        ids = self.numbers(words)
        begins, windows = [], []
        for width in self.widths:
            code, at = self.document_shingles(ids, width)
            lo = np.searchsorted(self.prefix, code, "left")
            n = np.searchsorted(self.prefix, code, "right") - lo
            hit = np.flatnonzero(n)
            entry = _runs(lo[hit], n[hit])
            window = self.prefix_window[entry]
            begin = np.repeat(at[hit], n[hit]) - self.prefix_offset[entry]
            fits = (begin >= 0) & (begin + self.length[window] <= len(ids))
            begins.append(begin[fits])
            windows.append(window[fits])
        empty = np.zeros(0, np.int64)
        begin, window = np.concatenate([empty, *begins]), np.concatenate([empty, *windows])
        if not len(begin):
            return begin, begin, window
        for k in range(self.window):      # verify word by word
            inside = self.length[window] > k
            same = np.ones(len(begin), bool)
            b, w = begin[inside], window[inside]
            same[inside] = ids[b + k] == self.flat[self.start[w] + k]
            begin, window = begin[same], window[same]
        return begin, begin + self.length[window], window

    def items_of(self, windows: np.ndarray) -> list[int]:
        w = np.unique(windows)
        return np.unique(self.owners[_runs(self.owner_at[w], self.n_owners[w])]).tolist()


def covered(begin: np.ndarray, end: np.ndarray) -> int:
    """Positions inside at least one of the intervals [begin, end)."""
    order = np.argsort(begin, kind="stable")
    b, e = begin[order], end[order]
    reach = np.maximum.accumulate(e)
    prior = np.concatenate(([0], reach[:-1])) if len(b) else b
    return int(np.maximum(0, e - np.maximum(b, prior)).sum())


def items_digest(names) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _blocks(benchmark: DataFrame, block_words: int) -> tuple[DataFrame, int]:
    """Items (item, text, key: of the text, block) and the number of blocks: one that holds every item, or several of
    distinct texts, so that a text of many items takes one place."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.sum(F.length("text") / 2)       # a word and its gap: two characters at least
    n = 1
    if (items.agg(words).first()[0] or 0) > block_words:
        n = max(2, int(-(-(items.select("text").distinct().agg(words).first()[0] or 0) // block_words)))
    items = items.withColumn("key", F.md5(F.col("text").cast("binary")))
    return items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n))), n


def _index(docs: DataFrame, items: DataFrame, block: int, window: int, name: str) -> WindowIndex:
    """The window index of one block, by items (``name`` "item") or by texts ("key"), its prefixes chosen by shingle counts
    over all documents."""
    rows = items.where(F.col("block") == block).select(F.col(name).alias("name"), "text").distinct().collect()
    index = WindowIndex(sorted(((r.name, r.text.encode()) for r in rows), key=lambda r: (r[0] is None, r[0] or "", r[1])), window)
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def counts(batches):
        ix = sent.value
        total = np.zeros(len(ix.known), np.int64)
        for b in batches:
            for t in text_bytes(b):
                ix.count(words_of(t), total)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["shingle", "n"])

    found = (docs.select("text").mapInArrow(counts, "shingle bigint, n bigint")
             .groupBy("shingle").agg(F.sum("n").alias("n")).collect())    # at most one row per shingle of the block
    total = np.zeros(len(index.known), np.int64)
    for r in found:
        total[r.shingle] = r.n
    index.choose_prefixes(total)
    sent.unpersist()
    return index


RESULT = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, keep: list[str] | None = None,
         block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` (its ``keep`` columns) plus, for each document,

    ``n_words``; ``n_hit`` (words inside an occurrence of a window);
    ``n_items`` and ``items_sha256`` (the items with occurring windows; ids as
    strings, sorted, comma-joined); ``contaminated`` (n_hit > 0).

    Documents without words (NULL, empty) are clean; items without words have
    no window; an item id that repeats, with equal or other texts, is one
    item; a NULL item id hits words but isn't listed as an item.  Equal rows
    give equal results, an empty benchmark marks nothing.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    items, n = _blocks(benchmark, block_words)
    if n == 1:
        index = docs.sparkSession.sparkContext.broadcast(_index(docs, items, 0, window, "item"))

        def make():
            ix = index.value

            def columns(batch):
                rows = []
                for t in text_bytes(batch):
                    words = words_of(t)
                    b, e, w = ix.match(words)
                    names = [ix.names[i] for i in ix.items_of(w) if ix.names[i] is not None]
                    hit = covered(b, e)
                    rows.append((len(words), hit, len(names), items_digest(names), hit > 0))
                return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in RESULT]
            return columns
        return add_columns(docs.select(*dict.fromkeys([*keep, "text"])), RESULT, make, keep)
    return _mark_blocks(docs, items, n, window, keep)


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated documents (rules as in ``mark``), all columns unchanged."""
    clash = {c: f"__in_{c}" for c in docs.columns if c in RESULT}
    marked = mark(docs.withColumnsRenamed(clash), benchmark, window, block_words=block_words)
    return marked.where(~F.col("contaminated")).select(*[F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def _mark_blocks(docs: DataFrame, items: DataFrame, n: int, window: int, keep: list[str]) -> DataFrame:
    """``mark`` for a benchmark of several blocks: hits of each block, written, merged by text, joined back.

    Hits are keyed by two hashes of the text, so equal texts share a row; the
    merge is a union of intervals and texts hit, which repeated rows don't
    change.  The ids of the items with these texts are joined to them on Spark.
    """
    key = [F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h1"),
           F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("__h2")]
    parts = None
    for block in range(n):
        index = docs.sparkSession.sparkContext.broadcast(_index(docs, items, block, window, "key"))

        def make(index=index):
            ix = index.value

            def columns(batch):
                out = [[], [], []]
                for t in text_bytes(batch):
                    b, e, w = ix.match(words_of(t))
                    for o, v in zip(out, (b.tolist(), e.tolist(), [ix.names[i] for i in ix.items_of(w)]), strict=True):
                        o.append(v)
                return out
            return columns
        hits = add_columns(docs.select(*key, "text"), {"b": "array<bigint>", "e": "array<bigint>", "i": "array<string>"},
                           make, ["__h1", "__h2"]).where(F.size("b") > 0)
        hits = materialize(hits.dropDuplicates(["__h1", "__h2"]), "hits")
        index.unpersist()
        parts = hits if parts is None else parts.unionByName(hits)
    merged = parts.groupBy("__h1", "__h2").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("b", "e")])
    ids = items.groupBy("key").agg(F.collect_set("item").alias("ids"))           # without NULL
    owned = parts.select("__h1", "__h2", F.explode("i").alias("key")).distinct().join(ids, "key")
    owned = owned.groupBy("__h1", "__h2").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("i"))
    merged = merged.join(owned, ["__h1", "__h2"], "left")

    def count():
        return lambda batch: [[len(words_of(t)) for t in text_bytes(batch)]]

    def digest():
        def columns(batch):
            rows = []
            for b, e, i in zip(*(batch.column(c).to_pylist() for c in ("b", "e", "i")), strict=True):
                names = {x for x in i or [] if x is not None}
                hit = covered(np.array(b or [], np.int64), np.array(e or [], np.int64))
                rows.append((hit, len(names), items_digest(names), hit > 0))
            return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]
        return columns
    counted = add_columns(docs.select(*dict.fromkeys([*keep, "text"]), *key), {"n_words": "bigint"}, count, [*keep, "__h1", "__h2"])
    joined = counted.join(merged, ["__h1", "__h2"], "left")
    rest = {k: v for k, v in RESULT.items() if k != "n_words"}
    return add_columns(joined, rest, digest, [*keep, "n_words"]).select(*keep, *RESULT)
