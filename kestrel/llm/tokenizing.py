"""Token counts of whole texts, with overlap resynchronisation for huge ones.

The libraries do all encoding.  What is added:

* Huge documents are encoded in overlapping chunks with offsets.  Two
  neighbouring chunks are spliced at a stable common boundary: a blank between
  two words that no token of either encoding crosses.  For a vocabulary whose
  pre-tokenizer drops blanks (``splits_at_blanks`` proves it from the file's
  rules), what stands before such a blank is encoded as if the text ended
  there, and what stands after it as if it began there, so the tokens up to
  it from the left chunk and those after it from the right one are the
  library's tokens of the whole text.  Where an overlap holds none, it is
  widened, up to the whole chunk, and then the chunk itself.
* For such a vocabulary shorter texts go word by word: the distinct words of
  a batch are looked up in a bounded cache, new ones encoded by the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import add_columns

CHUNK_CHARS = 32_768     # longer texts are encoded in chunks of this many characters
OVERLAP_CHARS = 256      # of neighbouring chunks, at first
CACHE_WORDS = 200_000    # words kept per worker, and as many that were used before those
CACHED_BYTES = 64        # longer words are not kept
TOKEN_LIMIT = 2048

WORDS_AT_ONCE = 1 << 18  # words whose ids are dealt out at a time
ASK_WORDS = 512          # words per call of the library

# Letters of a word, and the ASCII marks (but the apostrophe) that may end it.
_LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
_MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]
_GAP = re.compile(r"(?<=[^\s])[ \t\n\r](?=[^\s])")


def splits_at_blanks(path: str) -> bool:
    """Whether the vocabulary's rules make every ASCII blank a boundary that no token crosses or sees across.

    True for: normalisers that map each character (or run of blanks) by
    itself (NFC, which never composes a blank with its neighbours; lower
    case; blanks to a blank), then a first pre-tokenizer that keeps only
    matches of a pattern none of whose alternatives can match a blank.
    """
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    norm = rules.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = norm["normalizers"] if norm["type"] == "Sequence" else [norm]
    plain = all(s["type"] in ("NFC", "Lowercase")
                or s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " " for s in steps)
    plain = plain and any(s["type"] == "Lowercase" for s in steps)       # words are looked up whatever their case
    pre = rules.get("pre_tokenizer") or {"type": ""}
    first = pre["pretokenizers"][0] if pre["type"] == "Sequence" else pre
    if not plain or first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    parts = re.sub(r"\[\^\\s[^\]]*\]|\[\\p\{\w+\}\]|\\p\{\w+\}", "", first["pattern"].get("Regex", " "))
    whole = not re.search(r"\\s|\\W|\.|\s|\[\^", parts)     # what is left: literals without blanks
    words = not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                    for t in rules.get("added_tokens", []))
    return whole and words and "[\\p{L}]+" in first["pattern"]["Regex"]


def parts_pattern(encode: Callable) -> str:
    """A pattern for words that may be encoded as two parts: letters, and the marks after them.

    Only letters that any mark can follow without a change of either's ids, as
    the library gives them: a letter whose lower case ends in a combining
    mark, say, is none of them, since that mark joins what follows.
    """
    alone = dict(zip(_LETTERS + _MARKS, encode(_LETTERS + _MARKS), strict=True))
    pairs = [(x, m) for x in _LETTERS for m in _MARKS]
    apart = {x for (x, m), ids in zip(pairs, encode([x + m for x, m in pairs]), strict=True) if ids != alone[x] + alone[m]}
    letters = "".join(x for x in _LETTERS if x not in apart)
    return rf"^(?P<base>[{letters}]+)(?P<tail>[!-&(-/:-@\[-`{{-~]*)$"


class Encoder:
    """Encodes texts (UTF-8) with the library for ``path``: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        self.chunk, self.overlap = chunk, overlap
        self.cache: dict[bytes, bytes] = {b"": b""}
        self.older: dict[bytes, bytes] = {}
        self.by_word, self.mark = False, None
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.many: Callable = lambda ts: model.encode(ts, num_threads=1)
            self.offsets = None
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs a worker per core already
            from tokenizers import Tokenizer, pre_tokenizers
            lib = Tokenizer.from_file(path)
            lib.no_truncation()
            lib.no_padding()
            self.by_word = splits_at_blanks(path)
            self.many = lambda ts: [e.ids for e in lib.encode_batch_fast(ts, add_special_tokens=False)]

            def offsets(text):
                e = lib.encode(text, add_special_tokens=False)
                return np.array(e.ids, np.uint32), np.array(e.offsets, np.int64).reshape(-1, 2)
            self.offsets = offsets if self.by_word else None
            mark = self.many(["~"])[0]
            self.mark = mark[0] if len(mark) == 1 else None
            if self.by_word:
                # Lower-case ASCII letters between blanks: the normalisers and the byte alphabet leave them as they
                # are, and the pattern's run of letters is the whole word.
                bare = Tokenizer.from_file(path)
                bare.no_truncation()
                bare.no_padding()
                bare.normalizer = None
                bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
                self.parts = parts_pattern(self.many)
                self.bare: Callable = lambda ts: [e.ids for e in bare.encode_batch_fast(ts, add_special_tokens=False)]

    def ids(self, text: str) -> np.ndarray:
        """All ids of a text."""
        return self.batch(pa.array([text]))[0]

    def batch(self, texts: pa.Array, overlaps: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each).

        Long texts are encoded in overlapping chunks, or (``overlaps`` false,
        vocabularies that split at blanks only) word by word like the others.
        """
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            every = [np.array(self.many([t])[0], np.uint32) for t in texts.to_pylist()]
            return np.concatenate([np.zeros(0, np.uint32), *every]), np.array([len(i) for i in every], np.int64)
        if not overlaps:
            return self.by_words(texts)
        long = pc.greater(pc.utf8_length(texts), self.chunk)
        ids, n = self.by_words(pc.if_else(long, "", texts))
        at = np.flatnonzero(long.to_numpy(zero_copy_only=False))
        if not len(at):
            return ids, n
        parts, begin = [], 0
        ends = np.cumsum(n)
        for i in at.tolist():
            own = np.concatenate(list(self.spliced(texts[i].as_py())))
            parts += [ids[begin:ends[i]], own]
            begin, n[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[begin:]]), n

    def by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts whose words, at ASCII blanks, are encoded each by itself: the distinct words of the
        batch are looked up once, their ids dealt out in whole-array steps.  Words that differ in case or in the
        marks after them are looked up by their parts."""
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        parts = pc.extract_regex(coded.dictionary, self.parts)
        apart = parts.is_valid()
        base = pc.if_else(apart, pc.ascii_lower(pc.struct_field(parts, "base")), coded.dictionary)
        tail = pc.if_else(apart, pc.struct_field(parts, "tail"), "")
        pools = [self.lookup(x) for x in (base.dictionary_encode(), tail.dictionary_encode())]
        # The ids of each distinct word: those of its base, then those of its tail.
        n = [k[which] for _, _, k, which in pools]
        count = n[0] + n[1]
        start = np.cumsum(count) - count
        pool = np.empty(int(count.sum()), np.uint32)
        for at, (ids, begin, _, which), k in zip((start, start + n[0]), pools, n, strict=True):
            pool[deal(at, k)] = ids[deal(begin[which], k)]
        which = coded.indices.to_numpy()
        out, totals = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for i in range(0, len(which), WORDS_AT_ONCE):
            w = which[i:i + WORDS_AT_ONCE]
            out.append(pool[deal(start[w], count[w])])
            totals.append(np.cumsum(count[w]) + totals[-1][-1])
        bounds = np.concatenate(totals)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return np.concatenate(out), np.diff(bounds)

    def lookup(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the distinct words one after the other, where each begins, how many it has, the words' indices)."""
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.cache) > CACHE_WORDS:
            self.older, self.cache = self.cache, {b"": b""}
        cache, older = self.cache, self.older
        found = list(map(cache.get, words))
        new = [i for i, v in enumerate(found) if v is None]
        if new:
            letters, others = [], []
            for i in new:
                w = words[i]
                v = older.get(w)
                if v is not None:
                    cache[w] = v
                elif w.isalpha() and w.islower():          # bytes: ASCII letters only
                    letters.append(w)
                else:
                    others.append(w)
            for ask, encode in ((letters, self.bare), (others, self.many)):
                for i in range(0, len(ask), ASK_WORDS):
                    cache.update(self.each(ask[i:i + ASK_WORDS], encode))
            for i in new:
                w = words[i]
                found[i] = cache.pop(w) if len(w) > CACHED_BYTES else cache[w]
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(n) - n, n, coded.indices.to_numpy()

    def each(self, words: list[bytes], encode: Callable):
        """(word, ids) of each word.  One call of the library for all: words stand between blanks and a mark, a
        one-token word that none of them contains."""
        joint = [w for w in words if b"~" not in w] if self.mark is not None else []
        ids = np.array(encode([b" ~ ".join(joint).decode()])[0], "<u4") if joint else np.zeros(0, "<u4")
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(joint) - 1:
            joint = []
        raw, at = ids.tobytes(), [0, *(4 * cuts + 4).tolist(), 4 * len(ids) + 4]
        yield from zip(joint, [raw[x:y - 4] for x, y in zip(at, at[1:], strict=False)], strict=False)
        rest = [w for w in words if b"~" in w] if joint else words
        if rest:
            yield from ((w, np.array(i, "<u4").tobytes())
                        for w, i in zip(rest, encode([w.decode() for w in rest]), strict=True))

    def spliced(self, text: str):
        """Id arrays whose concatenation is the encoding of the whole text, chunk by chunk."""
        base, size, skip = 0, self.chunk, 0      # the current chunk begins at base; its first skip tokens are done
        ids, off = self.offsets(text[:size])
        while base + size < len(text):
            end, overlap = base + size, self.overlap
            while True:
                begin = max(base + 1, end - overlap)
                right_ids, right_off = self.offsets(text[begin:begin + self.chunk])
                done = off[skip - 1, 1] if skip else 0
                at = self.boundary(text, max(begin, base + done), end, (off, base), (right_off, begin))
                if at is not None or begin == base + 1:
                    break
                overlap *= 2
            if at is None:              # not one boundary in the chunk: take it twice as long
                size *= 2
                ids, off = self.offsets(text[base:base + size])
                skip = 0 if base == 0 else int(np.searchsorted(off[:, 1], done, "right"))
                continue
            upto = int(np.searchsorted(off[:, 1], at - base, "right"))
            yield ids[skip:upto]
            skip = int(np.searchsorted(right_off[:, 1], at - begin, "right"))
            ids, off, base, size = right_ids, right_off, begin, self.chunk
        yield ids[skip:]

    @staticmethod
    def boundary(text, begin, end, *encodings) -> int | None:
        """The place of a blank in text[begin:end], nearest its middle, that no token of the encodings crosses."""
        gaps = np.array([m.start() for m in _GAP.finditer(text, begin, end)], np.int64)
        for off, base in encodings:
            after = np.searchsorted(off[:, 1], gaps - base, "right")      # the first token that ends behind the blank
            starts = np.append(off[:, 0], np.iinfo(np.int64).max)
            gaps = gaps[starts[after] >= gaps - base]
        return int(gaps[np.argmin(np.abs(gaps - (begin + end) // 2))]) if len(gaps) else None


def deal(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start[i], ..., start[i] + n[i] - 1 of each i, one run after the other."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``: its cache of words outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) plus n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Tokens of whole texts as the library gives them, without begin, end or
    added special tokens; a special string inside a text is what the library
    makes of it.  NULL and empty texts have 0; repeated rows count alike.
    """
    def make():
        enc = encoder(path)

        def columns(batch):
            texts = pc.fill_null(batch.column("text"), "")
            return [pc.binary_length(texts).cast(pa.int64()), pa.array(enc.batch(texts)[1])]
        return columns
    out = add_columns(docs, {"n_bytes": "bigint", "n_tokens": "bigint"}, make, keep, rows=4096)
    names = [c for c in out.columns if c != "over_limit"]
    return out.select(*names, (F.col("n_tokens") > limit).alias("over_limit"))
