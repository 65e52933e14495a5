"""Collocations by FM-indexes over word ids.

1. A task cuts its texts into pieces and words and writes them as sections, a
   language and at most ``SHARD_WORDS`` words each (a piece is never cut): the
   section's distinct words with their counts, and its text as word ids, 0
   between pieces.  Counts are summed over the sections; words rarer than the
   threshold become breaks, since no phrase that holds one can reach it.
2. Sections of a language that lie side by side make a shard of about
   ``SHARD_WORDS`` words, which is indexed over what is left: the
   Burrows-Wheeler columns of the text and of its reverse.  A phrase is an interval of suffixes in each;
   extending it by a word on the left reads the first column's symbols in its
   interval, on the right the second's, and keeps both intervals in step.
   Suffixes are sorted as deep as the longest phrase only.  The extensions of
   single words are the shard's pairs; their counts are summed over the shards.
3. The texts are broken where a pair is too rare, indexed anew, and the
   intervals extended to phrases of 3 words and more.  Their counts are summed
   over the shards; what a frequent phrase has as frequent extensions on
   either side follows from the phrases one word longer.

Every sum counts all occurrences: a shard's own counts are never cut off.  A
phrase is at most one row per shard, so that no key is hot, and a task holds
one shard.  Sums and the rows they keep come from one exchange.  Texts travel as
compressed byte planes of their ids; so do pairs and longer phrases with their
counts, as a sorted list of a shard for each bucket of their hash, and a
bucket's lists are added up together.  A longer phrase is named by its pairs.

NULL texts are empty, a NULL language is ``und``; other columns are ignored,
repeated rows count as often as they are there; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.scans import prefix_before
from kestrel.llm.byte_bpe import mixed
from kestrel.llm.common import slices, text_bytes
from kestrel.llm.tokenizing import deal
from kestrel.session import materialize

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
SHARD_WORDS = 1 << 21
ROWS_AT_ONCE = 1 << 19         # of a shard's index, extended together
BUCKETS = 4                    # of pairs and phrases, per partition of a shuffle, at most
BUCKET_WORDS = 1 << 18         # words of all texts for each bucket, at least
SECTIONS_AT_ONCE = 1 << 42     # numbers of sections whose running sum is one window: those of 1,024 tasks
NO_LANGUAGE = "und"

_BREAKS, _BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_SECTION = "section bigint, lang string, n_words bigint, words array<string>, counts array<bigint>, ids binary"
_PAIRS = "shard bigint, bucket int, a binary, b binary, n binary, ids binary, names binary"
_FREQUENT_PAIRS = "shard bigint, a binary, b binary, name binary, f binary"
_LONGER = "bucket int, k binary, x binary, y binary, z binary, n binary"
_FREQUENT = "k int, x bigint, y bigint, z bigint, f bigint"


# ---- the index ---------------------------------------------------------------

def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``text`` sorted by the ``depth`` symbols (or more) that begin there; past the end stand zeros."""
    rank, done = text.astype(np.int64), 1
    while True:
        bits = max(1, int(rank.max(initial=0)).bit_length())
        take = max(2, min(63 // bits, -(-depth // done)))
        if take * bits > 63:
            raise ValueError("a shard of more than 2^31 words")
        key = rank.copy()
        for i in range(1, take):
            key <<= bits
            at = i * done
            key[:max(0, len(rank) - at)] |= rank[at:]
        order = np.argsort(key)
        done *= take
        if done >= depth:
            return order
        key = key[order]
        fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(key) else key
        rank = np.empty_like(rank)
        rank[order] = fresh


class _Column:
    """The Burrows-Wheeler column of a text, with the rank of a symbol before any row."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_order(text, depth).astype(np.int32)
        self.symbols = text[self.order - 1]
        self.n = len(text)
        self._sorted = None

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The first row of the suffixes that begin with ``symbol`` and go on as those from ``row`` on."""
        if self._sorted is None:
            self._sorted = self.symbols.astype(np.int64) * self.n + np.arange(self.n)
            self._sorted.sort()
        return np.searchsorted(self._sorted, symbol.astype(np.int64) * self.n + row)


class BidirectionalIndex:
    """Phrases of a text (word ids from 1; 0 breaks, and ends it) as intervals of its suffixes and of its reverse's.

    Intervals are three arrays: first row in the index of the text, first row
    in that of the reverse, number of rows (the phrase's occurrences).
    """

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.sigma = int(text.max(initial=0)) + 1
        self.forward = _Column(text, depth)
        self._backward = None

    @property
    def backward(self) -> _Column:
        if self._backward is None:
            self._backward = _Column(np.ascontiguousarray(self.text[::-1]), self.depth)
        return self._backward

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The intervals of the single words that occur."""
        n = np.bincount(self.text, minlength=self.sigma)
        first = np.cumsum(n) - n
        own = np.flatnonzero(n)
        own = own[own > 0]
        return first[own], first[own], n[own]

    def _extended(self, column: _Column, near: np.ndarray, size: np.ndarray):
        """(number of the phrase, word, count, occurrences of smaller words there, a row of each) of all extensions by a
        word of ``column``; the rows of some ``ROWS_AT_ONCE`` are looked at together."""
        total = np.cumsum(size)
        cuts = [0]
        while cuts[-1] < len(near):
            done = total[cuts[-1] - 1] if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, done + ROWS_AT_ONCE, "right"))))
        parts = [[np.zeros(0, np.int64)] * 5]
        for first, last in zip(cuts, cuts[1:], strict=False):
            rows = deal(near[first:last], size[first:last])
            key = np.repeat(np.arange(first, last) * self.sigma, size[first:last])
            key += column.symbols[rows]
            key, row, n = np.unique(key, return_index=True, return_counts=True)
            phrase, symbol = np.divmod(key, self.sigma)
            before = np.cumsum(n) - n
            smaller = before - before[np.searchsorted(phrase, phrase)]        # in the same interval
            keep = symbol > 0
            parts.append([phrase[keep], symbol[keep], n[keep], smaller[keep], rows[row[keep]]])
        return [np.concatenate(p) for p in zip(*parts, strict=True)]

    def left(self, lo, back, size):
        """Every phrase with a word before it: (number of the phrase, interval)."""
        phrase, word, n, smaller, _ = self._extended(self.forward, lo, size)
        return phrase, (self.forward.step(word, lo[phrase]), back[phrase] + smaller, n)

    def right(self, lo, back, size):
        """Every phrase with a word after it: (number of the phrase, interval)."""
        phrase, word, n, smaller, _ = self._extended(self.backward, back, size)
        return phrase, (lo[phrase] + smaller, self.backward.step(word, back[phrase]), n)

    def ngrams(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, a place of each phrase of k words, its count) for k from 2: intervals extended on the left and right in turn."""
        own = self.words()
        longest = min(longest, self.depth)
        for k in range(2, longest):
            _, own = (self.left if k % 2 == 0 else self.right)(*own)
            yield k, self.forward.order[own[0]], own[2]
        # The last extension needs no intervals, only where a row of it stands in the text.
        if longest % 2 == 0:
            _, _, n, _, row = self._extended(self.forward, own[0], own[2])
            yield longest, self.forward.order[row] - 1, n
        else:
            _, _, n, _, row = self._extended(self.backward, own[1], own[2])
            yield longest, len(self.text) - self.backward.order[row] - (longest - 1), n


def pruned(text: np.ndarray, join: np.ndarray) -> np.ndarray:
    """Which symbols to keep and where to break: places of ``text`` (-1: a break), pieces of one word left out.

    ``join[i]`` says that symbols i and i + 1 stay neighbours.
    """
    before = np.concatenate([[False], join[:-1]])
    keep = np.flatnonzero(before | join)
    last = ~join[keep]
    out = np.full(len(keep) + int(last.sum()), -1, np.int64)
    out[np.arange(len(keep)) + np.cumsum(last) - last] = keep
    return out


# ---- sections and shards -------------------------------------------------------

def packed(ids: np.ndarray) -> bytes:
    """Ids as compressed planes of their bytes (after the count and the width): most planes hold zeros."""
    head = np.array([len(ids), ids.itemsize], "<i8").tobytes()
    planes = np.ascontiguousarray(ids.view(np.uint8).reshape(len(ids), ids.itemsize).T)
    return head + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data[:16], "<i8").tolist()
    planes = pa.decompress(data[16:], decompressed_size=n * width, codec="zstd", asbytes=True)
    planes = np.frombuffer(planes, np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(f"<i{width}")

def _cut_words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts, A-Z in lower case, and which of them begin a piece."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8).copy()
    upper = (data >= 65) & (data <= 90)
    data[upper] += 32
    kind = np.zeros(256, np.uint8)
    kind[list(_BLANKS)], kind[list(_BREAKS)] = 1, 2
    kind = kind[data]
    inside = np.concatenate([[False], kind == 0])        # the last byte is a break
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    if len(edge) % 2:
        edge = np.append(edge, len(data))
    begin, end = edge[::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(kind == 2), begin)
    fresh = np.ones(len(begin), bool)
    fresh[1:] = piece[1:] != piece[:-1]
    # Words and the gaps between them lie side by side in one buffer: every second entry is a word.
    both = np.empty(2 * len(begin) + 1, np.int32)
    both[:-1:2], both[1::2] = begin, end
    both[-1] = len(data)
    spans = pa.Array.from_buffers(pa.binary(), 2 * len(begin), [None, pa.py_buffer(both), pa.py_buffer(data)])
    words = spans.take(pa.array(np.arange(0, 2 * len(begin), 2)))
    return words.dictionary_encode(), fresh


class _Open:
    """A section that is being filled."""

    def __init__(self):
        self.words: list[pa.DictionaryArray] = []
        self.fresh: list[np.ndarray] = []
        self.n = 0

    def add(self, texts: list[bytes]) -> None:
        words, fresh = _cut_words(texts)
        self.words.append(words)
        self.fresh.append(fresh)
        self.n += len(words)

    def row(self, section: int, lang: str) -> pa.RecordBatch:
        whole = pa.chunked_array(self.words).unify_dictionaries()
        ids = np.concatenate([c.indices.to_numpy() for c in whole.chunks]).astype(np.int64) + 1
        fresh = np.concatenate(self.fresh)
        text = np.zeros(len(ids) + int(fresh.sum()) + 1, np.int32)
        text[np.arange(len(ids)) + np.cumsum(fresh)] = ids
        names = pc.cast(whole.chunk(0).dictionary,
                        options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))
        counts = np.bincount(ids, minlength=len(names) + 1)[1:]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), v) for v in (names, pa.array(counts))]
        return pa.RecordBatch.from_arrays(
            [pa.array([section]), pa.array([lang]), pa.array([self.n]), *lists, pa.array([packed(text)], pa.binary())],
            names=["section", "lang", "n_words", "words", "counts", "ids"])


def sections(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The texts of ``docs`` (text, lang) as sections of word ids; a task has at most ``shard_words`` words open."""
    rows = docs.select("text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"))

    def fill(batches):
        base, number, open_ = TaskContext.get().partitionId() << 32, 0, {}
        for b in slices(batches):
            langs = b.column("lang").dictionary_encode()
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = b.filter(pc.equal(langs.indices, i))
                open_.setdefault(lang, _Open()).add(text_bytes(own))
            while sum(s.n for s in open_.values()) > shard_words:
                lang = max(open_, key=lambda x: (open_[x].n, x))
                yield open_.pop(lang).row(base + number, lang)
                number += 1
        for lang in sorted(open_):
            yield open_[lang].row(base + number, lang)
            number += 1

    return rows.mapInArrow(fill, _SECTION)


def _in_buckets(keys: list[np.ndarray], n: np.ndarray, buckets: int) -> Iterator[tuple[int, list[bytes]]]:
    """(bucket, packed keys and counts, sorted by the keys) of phrases."""
    h = np.zeros(len(n), np.uint64)
    for k in keys:
        h = mixed(h ^ k.astype(np.uint64))
    bucket = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((*keys[::-1], bucket))
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for i in np.flatnonzero(np.diff(at)).tolist():
        own = order[at[i]:at[i + 1]]
        yield i, [packed(v[own]) for v in (*keys, n)]


def _added_up(keys: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(one place of each distinct key, its sum, which of them each row has)."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[first], np.add.reduceat(n[order], first) if len(first) else n, which


def _unpack(table: pa.Table, columns: str | list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """(the lists of all rows one after the other, by column; how many each row has)."""
    parts = [[unpacked(v) for v in table.column(c).to_pylist()] for c in columns]
    return [np.concatenate(p) for p in parts], np.array([len(v) for v in parts[0]], np.int64)


def _frequent_pairs(least: int):
    """Of one bucket: the pairs that occur ``least`` times, each shard's own for it, and one row of all with their counts."""
    def add(lists: pa.Table) -> pa.Table:
        (a, b, n), size = _unpack(lists, ["a", "b", "n"])
        at, total, which = _added_up([a, b], n)
        good = total >= least
        name = np.where(good, (np.int64(lists.column("bucket")[0].as_py()) << 32) + np.cumsum(good) - 1, -1)
        rows = [(None, packed(a[at[good]]), packed(b[at[good]]), packed(name[good]), packed(total[good]))] if good.any() else []
        ends = np.cumsum(size)
        for shard, begin, end in zip(lists.column("shard").to_pylist(), (ends - size).tolist(), ends.tolist(), strict=True):
            own = begin + np.flatnonzero(good[which[begin:end]])
            if len(own):
                rows.append((shard, packed(a[own]), packed(b[own]), packed(name[which[own]]), None))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "a", "b", "name", "f"])
    return add


def _frequent_longer(least: int):
    """Of one bucket: the longer phrases that occur ``least`` times."""
    def add(lists: pa.Table) -> pa.Table:
        (*keys, n), _ = _unpack(lists, ["k", "x", "y", "z", "n"])
        at, total, _ = _added_up(keys, n)
        good = total >= least
        return pa.table([pa.array(keys[0][at[good]].astype(np.int32)), *[pa.array(k[at[good]]) for k in keys[1:]], pa.array(total[good])],
                        names=["k", "x", "y", "z", "f"])
    return add


def _pairs_of_shard(buckets: int):
    schema = pa.schema([("shard", pa.int64()), ("bucket", pa.int32()), *[(c, pa.binary()) for c in ("a", "b", "n", "ids", "names")]])

    def pairs(parts: pa.Table, words: pa.Table) -> pa.Table:
        """The text of a shard's frequent words and its pairs with their counts, words by their names (ids over all shards)."""
        if not parts.num_rows or not words.num_rows:
            return schema.empty_table()
        section, local, name = (words.column(c).to_numpy() for c in ("from_section", "local", "name"))
        names, number = np.unique(name, return_inverse=True)
        number = number.astype(np.int32) + 1                                          # 0: a break
        texts = []
        for own, ids in zip(parts.column("section").to_pylist(), parts.column("ids").to_pylist(), strict=True):
            ids, here = unpacked(ids), section == own
            numbered = np.zeros(int(max(ids.max(), local[here].max(initial=0))) + 1, np.int32)
            numbered[local[here]] = number[here]
            texts.append(numbered[ids])
        text = np.concatenate(texts)
        del texts
        # Frequent words get the smallest numbers; names: a break's first.
        order = np.argsort(-np.bincount(text, minlength=len(names) + 1)[1:], kind="stable")
        new = np.zeros(len(names) + 1, np.int32)
        new[1 + order] = np.arange(1, len(names) + 1)
        names, text = np.concatenate([[-1], names[order]]), new[text]
        places = pruned(text, np.append((text[1:] > 0) & (text[:-1] > 0), False))
        text = np.append(np.where(places >= 0, text[places], 0), 0).astype(np.int32)
        del places
        shard = parts.column("shard")[0].as_py()
        whole = [pa.array([packed(text)], pa.binary()), pa.array([packed(names)], pa.binary())]
        out = [pa.table([pa.array([shard]), *[pa.nulls(1, f.type) for f in list(schema)[1:5]], *whole], schema=schema)]
        for _, at, n in BidirectionalIndex(text, 2).ngrams(2):
            lists = list(_in_buckets([names[text[at]], names[text[at + 1]]], n, buckets))
            k = len(lists)
            columns = [pa.array([v[i] for _, v in lists], pa.binary()) for i in range(3)]
            out.append(pa.table([pa.array(np.full(k, shard)), pa.array([i for i, _ in lists], pa.int32()), *columns,
                                 pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary())], schema=schema))
        return pa.concat_tables(out)
    return pairs


def _longer_of_shard(longest: int, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("k", "x", "y", "z", "n")]])

    def phrases(shard: pa.Table, pairs: pa.Table) -> pa.Table:
        """A shard's phrases of 3 words and more whose pairs are all frequent, with their counts."""
        if not shard.num_rows or not pairs.num_rows:
            return schema.empty_table()
        text, names = (unpacked(shard.column(c)[0].as_py()) for c in ("ids", "names"))
        (first, second, pair_names), _ = _unpack(pairs, ["a", "b", "name"])
        place = np.argsort(names)
        key = [place[np.searchsorted(names, v, sorter=place)] for v in (first, second)]
        key = key[0] * len(names) + key[1]
        order = np.argsort(key)
        key, pair_names = key[order], pair_names[order]
        here = text[:-1].astype(np.int64) * len(names) + text[1:]
        at = np.minimum(np.searchsorted(key, here), len(key) - 1)
        join = np.append((key[at] == here) & (text[1:] > 0) & (text[:-1] > 0), False)
        pair_at = np.append(pair_names[at], -1)
        places = pruned(text, join)
        keep = places >= 0
        text = np.append(np.where(keep, text[places], 0), 0).astype(np.int32)
        pair_at = np.append(np.where(keep, pair_at[places], -1), [-1] * longest)
        index = BidirectionalIndex(text, longest)
        found = [[np.zeros(0, np.int64)] * 5]
        for k, at, n in index.ngrams(longest):
            if k > 2:        # named by pairs: the first, every second one, the last
                own = [pair_at[at + i] for i in _pair_places(k)]
                found.append([np.full(len(at), k), *own, *[np.full(len(at), -1)] * (3 - len(own)), n])
        *keys, n = [np.concatenate(c) for c in zip(*found, strict=True)]
        lists = list(_in_buckets(keys, n, buckets))
        return pa.table([pa.array([i for i, _ in lists], pa.int32()), *[pa.array([v[i] for _, v in lists], pa.binary()) for i in range(5)]],
                        schema=schema)
    return phrases


def _pair_places(k: int) -> list[int]:
    """Where the pairs begin that together name a phrase of k words."""
    return sorted({*range(0, k - 1, 2), k - 2})


# ---- operators ---------------------------------------------------------------

def _frequent(dealt: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows (n, ...) whose keys' ``f``, the sum of n, is at least ``least``; ``id`` tells rows apart, ``name`` is the keys'
    smallest.  ``dealt`` has a key's rows in one partition already; ids are given there, after the exchange."""
    w = Window.partitionBy(*keys)
    rows = dealt.withColumn("id", F.monotonically_increasing_id())
    return rows.withColumns({"f": F.sum("n").over(w), "name": F.min("id").over(w)}).where(F.col("f") >= least)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST,
            shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``longest`` (2 to 6) words that occur at least ``min_count`` times in their language, and the languages.

    Returns (phrases: lang, k, phrase, f, left, right; sizes: lang, n).  ``left``
    and ``right`` are the counts of the most frequent phrase of one word more
    on that side (NULL: none that is frequent, or none that short enough).
    """
    if not 2 <= longest <= 6:
        raise ValueError("longest must be from 2 to 6")
    base = materialize(sections(docs, shard_words), "sections")
    sizes = base.groupBy("lang").agg(F.sum("n_words").alias("n"))
    # Sections of a language in their order, cut into shards by a running sum (a row per section; in two levels).
    before = prefix_before(base.select("lang", "section", "n_words"), ["lang"], "section", "n_words", SECTIONS_AT_ONCE)
    part = before.withColumn("part", F.expr(f"_before div {shard_words}"))
    first = part.groupBy("lang", "part").agg(F.min("section").alias("shard"))
    part = materialize(part.join(first, ["lang", "part"]).select("section", "shard"), "shards")

    base = base.join(part, "section")
    listed = base.select("shard", "section", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "_e"))
    listed = listed.select("shard", "section", "lang", (F.col("local") + 1).alias("local"), F.col("_e.words").alias("word"),
                           F.col("_e.counts").alias("n"))
    listed = materialize(_frequent(listed.repartition("lang", "word"), ["lang", "word"], min_count).select(
        "shard", "section", "local", "name", "f", *[F.when(F.col("id") == F.col("name"), F.col(c)).alias(c) for c in ("lang", "word")]),
        "words")
    words = listed.where(F.col("lang").isNotNull()).select("lang", "word", "f", "name")

    own = listed.select(F.col("shard").alias("to"), F.col("section").alias("from_section"), "local", "name")
    text = base.select("shard", "section", "ids").groupBy("shard").cogroup(own.groupBy("to"))
    words_of_all = sizes.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-words_of_all // BUCKET_WORDS)))
    paired = materialize(text.applyInArrow(_pairs_of_shard(buckets), _PAIRS), "pairs-by-shard")
    lists = paired.where(F.col("bucket").isNotNull()).select("shard", "bucket", "a", "b", "n")
    kept = materialize(lists.groupBy("bucket").applyInArrow(_frequent_pairs(min_count), _FREQUENT_PAIRS), "pairs")

    def spread(batches):
        for b in batches:
            if b.num_rows:
                columns, _ = _unpack(pa.Table.from_batches([b]), ["a", "b", "f", "name"])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "f", "name"])
    pairs = kept.where(F.col("shard").isNull()).select("a", "b", "f", "name").mapInArrow(spread, "a bigint, b bigint, f bigint, name bigint")

    own = kept.where(F.col("shard").isNotNull()).select(F.col("shard").alias("to"), "a", "b", "name")
    text = paired.where(F.col("bucket").isNull()).select("shard", "ids", "names").groupBy("shard").cogroup(own.groupBy("to"))
    longer = materialize(text.applyInArrow(_longer_of_shard(longest, buckets), _LONGER), "longer-by-shard")
    longer = materialize(longer.groupBy("bucket").applyInArrow(_frequent_longer(min_count), _FREQUENT), "longer")

    # Words and pairs by name, then the longer phrases from their pairs.
    w = words.select("name", "lang", "word")
    second = w.select(F.col("name").alias("b"), F.col("word").alias("last"))
    spelt = pairs.join(w.select(F.col("name").alias("a"), "lang", "word"), "a").join(second, "b")
    spelt = spelt.select("name", "lang", F.concat_ws(" ", "word", "last").alias("phrase"), "last", "f")
    spelt = materialize(spelt, "spelt")
    levels = [words.select("lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), "f"),
              spelt.select("lang", F.lit(2).alias("k"), "phrase", "f")]
    for k in range(3, longest + 1):
        at = _pair_places(k)
        p = longer.where(F.col("k") == k).join(spelt.select(F.col("name").alias("x"), "lang", "phrase"), "x")
        for name, before, here in zip("yz", at, at[1:], strict=False):
            whole = here - before == 2          # else it shares a word with the pair before it
            piece = spelt.select(F.col("name").alias(name), F.col("phrase" if whole else "last").alias("_next"))
            p = p.join(piece, name).withColumn("phrase", F.concat_ws(" ", "phrase", "_next")).drop("_next")
        levels.append(p.select("lang", "k", "phrase", "f"))
    every = levels[0]
    for p in levels[1:]:
        every = every.unionByName(p)
    every = materialize(every, "phrases")
    long = every.where("k > 1")
    sides = long.select("lang", F.regexp_replace("phrase", "^[^ ]+ ", "").alias("phrase"), F.col("f").alias("left"),
                        F.lit(None).cast("long").alias("right")).unionByName(
        long.select("lang", F.regexp_replace("phrase", " [^ ]+$", "").alias("phrase"),
                    F.lit(None).cast("long").alias("left"), F.col("f").alias("right")))
    sides = sides.groupBy("lang", "phrase").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    return every.join(sides, ["lang", "phrase"], "left").select("lang", "k", "phrase", "f", "left", "right"), sizes


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``longest`` words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its two parts at the cut with the
    lowest score floor(1000 a n / (l r)) (ties: the shortest first part), n the
    language's words; the arithmetic is exact.  A phrase that stands only
    inside one frequent longer phrase is left out: one of its one-word
    extensions then occurs as often as it does.  Order: score and a
    descending, then the phrase by its bytes.
    """
    every, sizes = phrases(docs, min_count, longest, shard_words)
    every = materialize(every, "extended")
    kept = every.where("k > 1").where(F.coalesce(F.greatest("left", "right"), F.lit(0)) < F.col("f"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    parts = kept.select("lang", "k", "phrase", F.col("f").alias("a"), cut.alias("cut"))
    parts = parts.withColumn("_l", F.expr("substring_index(phrase, ' ', cut)"))
    parts = parts.withColumn("_r", F.expr("substring_index(phrase, ' ', cut - k)")).drop("k")
    counts = every.select("lang", "phrase", "f")
    parts = parts.join(counts.select("lang", F.col("phrase").alias("_l"), F.col("f").alias("l")), ["lang", "_l"])
    parts = parts.join(counts.select("lang", F.col("phrase").alias("_r"), F.col("f").alias("r")), ["lang", "_r"])
    parts = parts.join(sizes, "lang")
    score = F.expr("cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = parts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("_b"))
    best = best.select("lang", "phrase", "a", "_b.l", "_b.r", "n", "_b.score")
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
