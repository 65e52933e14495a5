"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every i, the sum of code[j] * BASE^j
over j < i, modulo two primes below 2^31.  From it the hash of any span
[i, j) is (P[j] - P[i]) * BASE^-i: spans of equal length are equal when these
agree (``PrefixHashes.same``), and the longest common extension of two places
is found by binary search over lengths.

A fingerprint holds the text's length, the hash of the whole, a byte of the
hash of every prefix and every suffix whose length is an anchor (2^(i/4),
rounded), and a sketch: the ``SKETCH`` smallest distinct mixed hashes of all
spans of ``SPAN`` code points (a text shorter than that is one span).  The
likeness of two fingerprints is the larger of two estimates: the part of the
longer text in their common prefix and suffix, as far as the anchors agree,
and the share of distinct spans in common, from the smallest hashes of both.
Equal texts have equal fingerprints, hence likeness 1.

Texts are handled in blocks of ``BLOCK`` code points: what a document keeps
beside its text is a few numbers a block (a text of one block keeps its prefix
arrays).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.common import slices, texts
from kestrel.session import materialize

PRIMES = (2147483629, 2147483587)      # the two largest primes below 2^31 - 1: products fit in 64 bits
BASES = (1000003, 92821)
SPAN = 12
SKETCH = 32
BLOCK = 1 << 18
ANCHORS = np.unique(np.round(2 ** (np.arange(160) / 4)).astype(np.int64))


class _Powers:
    """BASE^i and BASE^-i modulo each prime for i < n, extended by doubling."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def need(self, n: int) -> None:
        for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
            for table, base in ((self.up, b), (self.down, pow(b, -1, p))):
                while len(table[k]) < n:
                    t = table[k]
                    table[k] = np.concatenate([t, t * np.uint64(pow(base, len(t), p)) % np.uint64(p)])


_POWERS = _Powers()


def code_points(text: str) -> np.ndarray:
    """Code points of a text, plus one (so that no character counts as nothing)."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def joined(parts: list) -> np.ndarray:
    return parts[0] << np.uint64(31) | parts[1]


class PrefixHashes:
    """Prefix arrays of one block of code points."""

    def __init__(self, codes: np.ndarray):
        _POWERS.need(len(codes) + 1)
        self.n = len(codes)
        self.sums = []
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(codes * _POWERS.up[k][:self.n] % np.uint64(p), out=s[1:])      # < 2^31 each: no overflow in a block
            self.sums.append(s % np.uint64(p))

    def parts(self, begin, end) -> list[np.ndarray]:
        """The hashes of the spans [begin, end), which may be arrays, modulo each prime; independent of where a span lies."""
        return [(s[end] + np.uint64(p) - s[begin]) % np.uint64(p) * _POWERS.down[k][begin] % np.uint64(p)
                for k, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True))]

    def spans(self, begin, end) -> np.ndarray:
        """The same as one number of 62 bits."""
        return joined(self.parts(begin, end))

    def same(self, i: int, other: PrefixHashes, j: int, length: int) -> bool:
        """Whether the spans of ``length`` at i here and at j there are equal."""
        return bool(self.spans(i, i + length) == other.spans(j, j + length))

    def common_extension(self, i: int, other: PrefixHashes, j: int) -> int:
        """Length of the longest common run that begins at i here and at j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            if self.same(i, other, j, middle):
                low = middle
            else:
                high = middle - 1
        return low


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads hash bits (the finaliser of splitmix64, public domain constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def smallest(h: np.ndarray, k: int) -> np.ndarray:
    """The k smallest distinct values, sorted."""
    few = 4 * k
    if len(h) > few:
        some = np.unique(np.partition(h, few)[:few])
        if len(some) >= k:
            return some[:k]
    return np.unique(h)[:k]


class Document:
    """A text's whole hash, anchor bytes and sketch, from one pass over its blocks."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.n, self.block = text, len(text), block
        whole, before, sketch = 0, 0, np.zeros(0, np.uint64)
        prefix, ends, self.single = [], [], None
        for i in range(0, self.n, block):
            # Spans that begin in the block may end in the next.
            wide = PrefixHashes(code_points(text[i:i + block + SPAN - 1]))
            n = min(block, self.n - i)
            all_of = int(wide.spans(0, n))
            whole = (whole * 1_000_003 + all_of) % ((1 << 61) - 1)
            lengths = ANCHORS[(ANCHORS > i) & (ANCHORS <= i + n)] - i
            prefix.append(mix64(wide.spans(np.zeros(len(lengths), np.int64), lengths) ^ np.uint64(before)) >> np.uint64(56))
            before = (before * 31 + all_of) % (1 << 62)
            # Suffixes that begin in the block: their part in it, to be joined with what follows.
            begin = self.n - ANCHORS[(ANCHORS <= self.n - i) & (ANCHORS > self.n - i - n)] - i
            ends.append((n, [int(x) for x in wide.parts(0, n)], n - begin, wide.parts(begin, np.full(len(begin), n))))
            begin = np.arange(min(n, max(1, wide.n - SPAN + 1))) if wide.n >= SPAN or self.n < SPAN else np.zeros(0, np.int64)
            h = mix64(wide.spans(begin, np.minimum(begin + SPAN, wide.n))) >> np.uint64(32)
            sketch = smallest(np.concatenate([sketch, h]), SKETCH)
            if self.n <= block:
                self.single = wide
        self.whole, self.sketch = whole, sketch.astype(">u4")
        prefix = np.concatenate(prefix).astype(np.uint8).tobytes() if prefix else b""
        self.anchors = prefix + _suffix_bytes(ends)

    def part(self, i: int) -> PrefixHashes:
        """The prefix arrays of block i."""
        return self.single or PrefixHashes(code_points(self.text[i * self.block:(i + 1) * self.block]))

    def common_prefix(self, other: Document) -> int:
        """Length of the longest common prefix: whole blocks first, then binary search in the one that differs."""
        total = 0
        for i in range(-(-min(self.n, other.n) // self.block)):
            a, b = self.part(i), other.part(i)
            run = a.n if a.n == b.n and a.same(0, b, 0, a.n) else a.common_extension(0, b, 0)
            total += run
            if run < max(a.n, b.n):
                break
        return total

    def fingerprint(self) -> bytes:
        """Length and whole hash (8 bytes each, big-endian), a byte per prefix and suffix anchor, then the sketch
        (4 bytes a value)."""
        return self.n.to_bytes(8, "big") + self.whole.to_bytes(8, "big") + self.anchors + self.sketch.tobytes()


def _suffix_bytes(ends: list[tuple]) -> bytes:
    """A byte of the hash of every suffix whose length is an anchor, shortest first.

    ``ends``: of each block its length, its hash modulo each prime, and of the
    suffixes that begin in it the lengths and hashes of their part in the block.
    The hash of two spans one after the other is the first's plus the
    second's times BASE to the first's length.
    """
    out, after = [], [0] * len(PRIMES)            # what follows the block, modulo each prime
    for n, whole, lengths, parts in reversed(ends):
        full = []
        for k, p in enumerate(PRIMES):
            up = _POWERS.up[k][lengths] * np.uint64(after[k]) % np.uint64(p)
            full.append((parts[k] + up) % np.uint64(p))
            after[k] = (whole[k] + int(_POWERS.up[k][n]) * after[k]) % p
        out.append((mix64(joined(full)) >> np.uint64(56)).astype(np.uint8)[np.argsort(lengths)])
    return np.concatenate(out).tobytes() if out else b""


def _agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The longest anchor up to which two runs of anchor bytes agree (0: none)."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    upto = int(apart[0]) if len(apart) else n
    return int(ANCHORS[upto - 1]) if upto else 0


def likeness(x: bytes, y: bytes) -> float:
    """How much of their texts two fingerprints have in common, 0 to 1."""
    if x == y:
        return 1.0
    parts = []
    for f in (x, y):
        n = int.from_bytes(f[:8], "big")
        p = int(np.searchsorted(ANCHORS, n, "right"))
        bytes_of = np.frombuffer(f[16:16 + 2 * p], np.uint8)
        parts.append((n, bytes_of[:p], bytes_of[p:], np.frombuffer(f[16 + 2 * p:], ">u4")))
    (n, prefix, suffix, a), (m, prefix2, suffix2, b) = parts
    if not n or not m:
        return 0.0
    ends = min(_agreeing(prefix, prefix2) + _agreeing(suffix, suffix2), n, m) / max(n, m)
    union = np.union1d(a, b)[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return max(ends, float(np.isin(union, both, assume_unique=True).mean()))


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as many characters of the following text, or all it has."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(text: str, mine: Document, following: str, theirs: Document) -> tuple:
    """Digest of a document against the one that follows it: the ``done`` columns after doc_id."""
    changed = edited(text, following)
    other = Document(changed)
    f, g, h = mine.fingerprint(), other.fingerprint(), theirs.fingerprint()
    return (mine.n, hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), f, g,
            likeness(f, g), likeness(f, h), mine.common_prefix(other), mine.common_prefix(theirs))


_SCHEMA = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("text", pa.string()),
                     ("n_chars", pa.int64()), ("sha", pa.binary()), ("fp", pa.binary()), ("edited_fp", pa.binary()),
                     ("near_edited", pa.float64()), ("near_next", pa.float64()),
                     ("prefix_edited", pa.int64()), ("prefix_next", pa.int64())])
_DDL = ("kind int, part int, doc_id bigint, text string, n_chars bigint, sha binary, fp binary, edited_fp binary, "
        "near_edited double, near_next double, prefix_edited bigint, prefix_next bigint")
DONE, FIRST, LAST = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _SCHEMA]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


def _empty(kind: int, part: int, doc_id, text: str) -> tuple:
    return (kind, part, doc_id, text, *[None] * 8)


def _in_order(batches):
    """Compare each document of an ordered part with the next; hand on the part's first and last text."""
    part, held = TaskContext.get().partitionId(), None
    for b in slices(batches):
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), texts(b), strict=True):
            own = Document(text)
            if held is None:
                rows.append(_empty(FIRST, part, doc_id, text))
            else:
                rows.append((DONE, part, held[0], None, *compare(held[1], held[2], text, own)))
            held = (doc_id, text, own)
        yield _batch(rows)
    if held is not None:
        yield _batch([_empty(LAST, part, held[0], held[1])])


def _pairs(batches):
    """Compare the last text of each part with the first of the next."""
    for b in batches:
        yield _batch([(DONE, 0, d, None, *compare(x, Document(x), y, Document(y))) for d, x, y in zip(
            b.column("doc_id").to_pylist(), texts(b), texts(b, "following"), strict=True)])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint every whole text (NULL: empty), and compare it with its edited text and its next document.

    The next document is the one with the next smaller doc_id, for the last
    the first; NULL ids come after all others, equal ids are ordered by
    content hash, then text (wholly equal rows may swap places).  A lone
    document is its own next.

    Columns: doc_id, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint (hexadecimal), near_edited, near_next (likeness of the
    fingerprints), prefix_edited, prefix_next (longest common prefix, in code
    points, by binary search over the prefix arrays).  An empty text has an
    empty sketch: likeness 1 to another empty text, else 0.

    Texts are dealt out once, by ranges of (doc_id, content hash).  Each
    part is compared in order; only its first and last text go on to the next step.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text").drop("h")
    made = materialize(rows.mapInArrow(_in_order, _DDL), "fingerprints")
    # One row a part: who comes next, the first again after the last.
    parts = made.where(F.col("kind") == FIRST).select("part")
    w = Window.partitionBy(F.lit(1)).orderBy("part")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.select("part", F.coalesce(F.lead("part").over(w), F.first("part").over(whole)).alias("next"))
    firsts = made.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = made.where(F.col("kind") == LAST).select("part", "doc_id", "text")
    ends = lasts.join(following, "part").join(firsts, "next").repartition(n, "part").select("doc_id", "text", "following")
    done = made.where(F.col("kind") == DONE).unionByName(ends.mapInArrow(_pairs, _DDL))
    low = lambda c: F.lower(F.hex(c))
    return done.select("doc_id", "n_chars", low("sha").alias("edited_sha256"), low("fp").alias("fingerprint"),
                       low("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", "prefix_edited", "prefix_next")
