"""Byte-level BPE by a rank file: encoding and decoding, with the ids of the tiktoken library.

Encoding has two tiers:

* A text is cut into the matches of the vocabulary's pattern.  The distinct
  pre-tokens of a piece of work are looked up whole in a minimal perfect hash
  of the vocabulary (hash and displace: a bucket's displacement sends its keys
  to free slots, n keys to n slots), all at once; the bytes at the slot are
  compared, so that a stranger is never taken for a token.
* What is not a token itself is merged: the bytes are linked, the adjacent
  pairs that form a token wait in a heap by (rank, place), and the lowest is
  joined until none is left.  Results are kept per worker in a bounded cache.

The pattern is applied to character classes in whole-array steps: a run of
letters, numbers or other marks is a pre-token, with one blank before it; of a
run of white space before something else the last character stands alone or
goes with what follows; ``'s 't 're 've 'm 'll 'd`` are cut where a mark run
is the apostrophe alone.  Texts are taken ``PIECE_BYTES`` at a time; longer ones
are cut where white space begins, a place no pre-token crosses or sees across.

Decoding joins the tokens' bytes.  A NULL text is empty, as is a NULL list of
ids; other columns are left alone, and an input column named like a result is
replaced.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from kestrel.llm.common import add_columns
from kestrel.llm.tokenizing import deal

PIECE_BYTES = 1 << 22     # bytes of text that are cut into pre-tokens at a time
CACHE_PIECES = 400_000    # merged pre-tokens kept per worker, and as many that were used before those
CACHED_BYTES = 64         # longer pre-tokens are not kept
KEYS_PER_BUCKET = 3       # of the perfect hash
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit values with their bits spread (the finalizer of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A polynomial hash modulo 2^64 of each key ``data[offsets[i]:offsets[i + 1]]`` (none of them empty)."""
    if len(offsets) < 2:
        return np.zeros(0, _U)
    length = np.diff(offsets)
    powers = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(int(length.max()) - 1, _BASE)]))
    place = np.arange(offsets[0], offsets[-1]) - np.repeat(offsets[:-1], length)
    terms = (data[offsets[0]:offsets[-1]].astype(_U) + _U(1)) * powers[place]
    return np.add.reduceat(terms, offsets[:-1] - offsets[0]) + length.astype(_U)


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: ``slots`` names for each query the one key it can be."""

    def __init__(self, keys: list[bytes]):
        data, offsets = _packed(keys)
        h = hashes(data, offsets)
        n = len(keys)
        if len(np.unique(h)) < n:
            raise ValueError("two keys have one hash")
        buckets = -(-n // KEYS_PER_BUCKET)
        bucket = (mixed(h) % _U(max(1, buckets))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        begins = np.searchsorted(bucket[order], np.arange(buckets + 1))
        sizes = np.diff(begins)
        self.displacement = np.zeros(max(1, buckets), np.int64)
        key_at, free = np.full(n, -1, np.int64), np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():        # large buckets first, while there is room
            if sizes[b] < 2:
                break
            own, first = order[begins[b]:begins[b + 1]], 1
            while True:
                tries = np.arange(first, first + 256)
                at = self._displaced(h[own][None, :], tries[:, None], n)
                good = free[at].all(1)
                good[good] = (np.diff(np.sort(at[good], 1), axis=1) > 0).all(1)
                hit = np.flatnonzero(good)
                if len(hit):
                    break
                first += 256
            at = at[hit[0]]
            self.displacement[b], free[at], key_at[at] = tries[hit[0]], False, own
        single = np.flatnonzero(sizes == 1)                          # the rest takes the slots that are left
        at, own = np.flatnonzero(free)[:len(single)], order[begins[single]]
        self.displacement[single], key_at[at] = -at - 1, own
        self.key_at, self.n = key_at, n

    @staticmethod
    def _displaced(h, d, n: int):
        return (mixed(h ^ (d.astype(_U) * _STEP)) % _U(n)).astype(np.int64)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The key (its number in the list) that each hash can belong to."""
        d = self.displacement[(mixed(h) % _U(len(self.displacement))).astype(np.int64)]
        return self.key_at[np.where(d < 0, -d - 1, self._displaced(h, np.maximum(d, 0), self.n))]


def _packed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(keys), np.uint8), np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int64)


def character_classes() -> np.ndarray:
    """The class of every code point (white space, letter, number or other), as the library's patterns see it."""
    import tiktoken
    single = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, (i for i in range(0x110000) if not 0xD800 <= i < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        # Only a pattern's matches are encoded: here, as their bytes.
        found = bytes(tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every))
        out[np.frombuffer(found.decode().encode("utf-32-le"), "<u4")] = kind
    return out


def code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The code points of UTF-8 ``data`` whose first bytes are at ``lead`` (broken ones: U+FFFD)."""
    out = data[lead].astype(np.int32)
    wide = np.flatnonzero(out >= 0x80)
    if len(wide):
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        at, first = lead[wide], out[wide]
        c = [padded[at + i].astype(np.int32) & 0x3F for i in (1, 2, 3)]
        two, three = (first & 0x1F) << 6 | c[0], (first & 0x0F) << 12 | c[0] << 6 | c[1]
        four = (first & 0x07) << 18 | c[0] << 12 | c[1] << 6 | c[2]
        v = np.where(first >= 0xF0, four, np.where(first >= 0xE0, three, two))
        out[wide] = np.where((first < 0xC0) | (v >= 0x110000), 0xFFFD, v)
    return out


def starts(kind: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: a mark per character, from the characters' classes, code points and text beginnings."""
    n = len(kind)
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]                    # a run begins
    run = np.flatnonzero(cut)
    space = kind == SPACE
    last = np.zeros(n, bool)                            # the last character of white space before something else
    ends = np.append(run[1:], n) - 1
    inner = np.zeros(len(run), bool)
    inner[:-1] = ~first[run[1:]]
    last[ends[space[run] & inner]] = True
    cut |= last
    blank = last & (code == 0x20)
    joined = np.zeros(n, bool)
    joined[1:] = blank[:-1]                             # goes with the blank before it
    cut &= ~joined
    # Contractions: an apostrophe that is a pre-token by itself, then the letters.
    after = lambda k, pad: np.append(code[k:], np.full(min(k, n), pad))[:n]      # noqa: E731
    stop = np.append(first[1:], True)                   # the text ends here
    lone = cut & (code == 0x27) & ~stop & np.append(kind[1:] == LETTER, False)
    at = np.flatnonzero(lone)
    if len(at):
        a, b = after(1, 0)[at], after(2, 0)[at]
        end2 = np.append(stop[1:], True)[at]            # no second letter in this text
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ~end2 & np.logical_or.reduce([(a == ord(x)) & (b == ord(y)) for x, y in ("re", "ve", "ll")])
        own = at[short | long]
        cut[own + 1] = False
        nxt = own + np.where(short[short | long], 2, 3)
        cut[nxt[nxt < n]] = True
    return cut


class Codec:
    """Encodes and decodes by a rank file."""

    def __init__(self, path: str, piece_bytes: int = PIECE_BYTES):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())}
        if any(bytes([i]) not in ranks for i in range(256)):
            raise ValueError("the rank file must hold every single byte")
        self.token_ids = np.array(list(ranks.values()), np.int32)
        self.hash = PerfectHash(list(ranks))
        self.data, self.offsets = _packed(list(ranks))
        self.single, self.pairs = [ranks[bytes([i])] for i in range(256)], pairs_of(ranks)
        by_id: list = [None] * (int(self.token_ids.max()) + 1)
        for t, i in ranks.items():
            by_id[i] = t
        self.bytes_of = pa.array(by_id, pa.large_binary())
        self.digits_of = pa.array([b"%d," % i for i in range(len(by_id))], pa.large_binary())
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.classes = character_classes()
        self.piece_bytes = piece_bytes

    # ---- encoding

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin and the last one's end)."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        ids, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        for text, part, bounds in self.pieces(data, ends):
            own, n = self.encode_piece(part, bounds)
            ids.append(own)
            counts[text:text + len(n)] += n
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(counts)])

    def pieces(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, bytes, bounds of the texts in them): texts together, or parts of a long one."""
        i, n = 0, len(ends) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + self.piece_bytes, "right")) - 1)
            part = data[ends[i]:ends[j]]
            if len(part) <= self.piece_bytes:
                yield i, part, ends[i:j + 1] - ends[i]
            else:
                for own in self.parts(part):
                    yield i, own, np.array([0, len(own)])
            i = j

    def parts(self, text: np.ndarray) -> Iterator[np.ndarray]:
        """A long text, cut where white space begins."""
        begin, size = 0, self.piece_bytes
        while begin + size < len(text):
            window = text[begin:begin + size]
            lead = np.flatnonzero((window & 0xC0) != 0x80)
            space = self.classes[code_points(window, lead)] == SPACE
            cuts = np.flatnonzero(space[1:-1] & ~space[:-2]) + 1        # the last character may be cut in two
            if len(cuts):
                at = int(lead[cuts[-1]])
                yield text[begin:begin + at]
                begin, size = begin + at, self.piece_bytes
            else:
                size *= 2
        yield text[begin:]

    def encode_piece(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of texts that lie one after the other."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = code_points(data, lead)
        first = np.zeros(len(lead), bool)
        full = np.diff(bounds) > 0
        first[np.searchsorted(lead, bounds[:-1][full])] = True
        begins = lead[starts(self.classes[code], code, first)]
        edges = np.append(begins, len(data)).astype(np.int32)
        pretokens = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        coded = pretokens.dictionary_encode()
        which = coded.indices.to_numpy()
        pool, at, n = self.lookup(coded.dictionary)
        ids = pool[deal(at[which], n[which])]
        total = np.concatenate([[0], np.cumsum(n[which])])
        return ids, np.diff(total[np.searchsorted(begins, bounds)])

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: (pool, where each one's ids begin, how many they are)."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        slot = self.hash.slots(hashes(data, offsets))
        length = np.diff(offsets)
        known = np.diff(self.offsets)[slot] == length
        at = np.flatnonzero(known)
        if len(at):
            same = data[deal(offsets[at], length[at])] == self.data[deal(self.offsets[slot[at]], length[at])]
            known[at] = np.logical_and.reduceat(same, np.cumsum(length[at]) - length[at])
        miss = np.flatnonzero(~known)
        merged = self.merged([data[offsets[i]:offsets[i + 1]].tobytes() for i in miss.tolist()])
        n = np.ones(len(words), np.int64)
        n[miss] = [len(m) // 4 for m in merged]
        begin = np.cumsum(n) - n
        pool = np.empty(int(n.sum()), np.int32)
        pool[begin[known]] = self.token_ids[slot[known]]
        pool[deal(begin[miss], n[miss])] = np.frombuffer(b"".join(merged), np.int32)
        return pool, begin, n

    def merged(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens that are no tokens, each as 32-bit integers."""
        if len(self.cache) > CACHE_PIECES:
            self.older, self.cache = self.cache, {}
        out = []
        for p in pieces:
            ids = self.cache.get(p)
            if ids is None:
                ids = self.older.get(p)
                if ids is None:
                    ids = array("i", merge(p, self.single, self.pairs)).tobytes()
                if len(p) <= CACHED_BYTES:
                    self.cache[p] = ids
            out.append(ids)
        return out

    # ---- decoding

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The bytes of each list ``ids[bounds[i]:bounds[i + 1]]``; an id outside the vocabulary is an error."""
        return _joined(self.bytes_of, ids, bounds)

    def digits(self, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
        """The ids of each list as decimals joined by commas."""
        return [d[:-1] for d in _joined(self.digits_of, ids, bounds)]


def _joined(table: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> list[memoryview]:
    if not len(ids):
        return [memoryview(b"")] * (len(bounds) - 1)
    if int(ids.min()) < 0 or int(ids.max()) >= len(table):
        raise ValueError("an id outside the vocabulary")
    taken = table.take(pa.array(ids))
    if taken.null_count:
        raise ValueError("an id outside the vocabulary")
    offsets, data = np.frombuffer(taken.buffers()[1], np.int64)[bounds], memoryview(taken.buffers()[2])
    return [data[x:y] for x, y in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]


def pairs_of(ranks: dict[bytes, int]) -> dict[int, int]:
    """The rank of every two tokens (first << 32 | second) whose bytes together are a token."""
    out = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a = ranks.get(token[:k])
            if a is not None:
                b = ranks.get(token[k:])
                if b is not None:
                    out[a << 32 | b] = rank
    return out


def merge(piece: bytes, single: list[int], pairs: dict[int, int]) -> list[int]:
    """The ids of one pre-token: linked bytes, a heap of the pairs that form a token, lowest rank first, then leftmost."""
    ids = [single[b] for b in piece]
    n = len(ids)
    nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
    get = pairs.get
    rank = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)]     # of the pair that begins here; -1: none
    rank.append(-1)
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    heapify(heap)
    while heap:
        top = heappop(heap)
        i, r = top & 0xFFFFFFFF, top >> 32
        if rank[i] != r:
            continue                        # the pair is no longer there
        j = nxt[i]
        k = nxt[i] = nxt[j]
        ids[i], ids[j], rank[j] = r, -1, -1
        if k < n:
            prev[k] = i
            rank[i] = new = get(r << 32 | ids[k], -1)
            if new >= 0:
                heappush(heap, new << 32 | i)
        else:
            rank[i] = -1
        p = prev[i]
        if p >= 0:
            rank[p] = new = get(ids[p] << 32 | r, -1)
            if new >= 0:
                heappush(heap, new << 32 | p)
    return [i for i in ids if i >= 0]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for ``path``: its cache outlives a task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


# ---- operators -------------------------------------------------------------

def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; default all) plus ``ids``: the ids of the whole text (NULL: empty)."""
    def make():
        own = codec(path)

        def columns(b):
            ids, bounds = own.encode(b.column(text))
            return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))]
        return columns
    return add_columns(docs, {"ids": "array<int>"}, make, keep)


def decode(rows: DataFrame, path: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``rows`` (its ``keep`` columns; default all) plus ``decoded``: the bytes of the ids (NULL or none: no bytes)."""
    def make():
        own = codec(path)

        def columns(b):
            lists = b.column(ids)
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().cast(pa.int32()).to_numpy(zero_copy_only=False)
            parts = own.decode(flat, np.concatenate([[0], np.cumsum(n)]).astype(np.int64))
            return [pa.array([p.tobytes() for p in parts], pa.binary())]
        return columns
    return add_columns(rows, {"decoded": "binary"}, make, keep)


def round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns; default all) plus what encoding and decoding back give, without the ids themselves:
    n_tokens, ids_sha256 (hex digest of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""
    def make():
        own = codec(path)

        def columns(b):
            ids, bounds = own.encode(b.column(text))
            return [np.diff(bounds), [hashlib.sha256(x).hexdigest() for x in own.digits(ids, bounds)],
                    [hashlib.sha256(x).hexdigest() for x in own.decode(ids, bounds)]]
        return columns
    return add_columns(docs, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, make, keep)

