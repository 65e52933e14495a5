"""Awkward documents and plain versions of the operators, for the tests of this folder."""

from __future__ import annotations

import hashlib
import re
import zlib

import public_tokenizers
import xxhash

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
DOCUMENT = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use for their results or on the way there.
CLASHING = ["score", "size", "n_words", "n_hit", "contaminated", "n_tokens", "over_limit", "fp", "component_id", "root",
            "target", "taken", "begin", "evidence", "site_rate", "kept", "start", "h", "kind", "part", "shard", "k",
            "predicted", "features", "seed", "words", "n", "x", "label", "path_n", "host_s", "g_host", "quota", "level"]

PROSE = ("The quick brown fox jumps over the lazy dog while seven wise owls watch from the old oak tree and count "
         "every single leaf that falls into the cold clear water of the river below them")


def awkward() -> list[tuple]:
    """NULLs in every column, empty and blank texts, a very long one, ties, repeated rows, unusual characters."""
    long_text = " ".join(f"w{i % 997} {PROSE.split()[i % 30]}" for i in range(60_000))
    near = PROSE + " " + " ".join(f"extra{i}" for i in range(200))
    rows = [
        (1, PROSE, "en", "a", len(PROSE)), (2, PROSE, "en", "a", len(PROSE)), (3, PROSE.upper(), "en", "b", len(PROSE)),
        (4, None, "en", "a", None), (5, "", None, "a", 0), (6, " \t\n ", "en", None, 4), (7, "one", "en", "b", 3),
        (8, "one two", "en", "b", 7), (9, long_text, "en", "c", len(long_text)), (None, "no id here at all", "en", "c", 17),
        (None, None, None, None, None), (10, near, "en", None, len(near)), (11, near.replace("extra7 ", "other7 "), "fr", "c", len(near)),
        (12, "é́ \x0b日本語 \x1c <|endoftext|> ~   𝔘 ñandú", "es", "d", 30), (12, "the same id, another text", "es", "d", 25),
        (13, "repeated row", "en", "a", 12), (13, "repeated row", "en", "a", 12), (13, "repeated row", "en", "a", 12),
        (14, "z" * 70_000, "en", "e", 70_000), (15, "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" 4785380592391139", "en", "a", 70),
        (18, "TARİHİ, ŞEHRİ. İ! aİb, İstanbul'İ ǅ; ŉ? ẞ, ǰ.", "tr", "e", 40), (19, "TARİHİ, ŞEHRİ. " * 4_600, "tr", "e", 69_000),
        (16, PROSE + " Released under the MIT License.", "en", "a", 0),
    ]
    return rows


def frame(spark, rows=None, clashing: bool = False):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(awkward() if rows is None else rows, DOCUMENT)
    return df.withColumns({c: F.lit(f"x-{c}") for c in CLASHING}) if clashing else df


def labels(spark, rows=((1, 1, 0), (3, 0, 1), (7, None, None), (None, 1, 1), (8, 1, 0), (9, 0, 1), (9, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


def benchmark(spark, rows=None):
    words = PROSE.split()
    rows = rows if rows is not None else [
        (1, " ".join(words[5:25])), (1, "One, TWO!"), (2, "never seen words in any of these documents at all here"),
        (3, None), (4, ""), (None, " ".join(words[:12])), (5, " ".join(words[20:32])), (5, " ".join(words[20:32]))]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- plain versions -------------------------------------------------------

def lower_az(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def simhash(text: str | None, width: int = 3) -> int:
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower_az(text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius: int = 2) -> list[tuple]:
    """(doc_id, fingerprint, component_id) by comparing every pair of fingerprints."""
    return [r[:3] for r in grouped(rows, radius)]


def grouped(rows, radius: int = 2) -> list[tuple]:
    """The same and a name of the group (two groups may have one smallest id)."""
    prints = [simhash(r[1]) for r in rows]
    distinct = sorted(set(prints))
    root = {f: f for f in distinct}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low: dict[int, int] = {}
    for r, f in zip(rows, prints, strict=True):
        if r[0] is not None:
            low[find(f)] = min(low.get(find(f), r[0]), r[0])
    return [(r[0], f"{f:016x}", low.get(find(f)), find(f)) for r, f in zip(rows, prints, strict=True)]


def word_list(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_az(text or ""))


def decontamination(rows, items) -> list[tuple]:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) by trying every window at every place."""
    windows = set()
    for name, text in items:
        w = word_list(text)
        windows |= {(name, tuple(w[i:i + 10])) for i in range(max(1, len(w) - 9)) if w}
    out = []
    for r in rows:
        w = word_list(r[1])
        hit, names = set(), set()
        for name, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i:i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    names |= {str(name)} if name is not None else set()
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((r[0], len(w), len(hit), len(names), digest, bool(hit)))
    return out


def size(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes: dict) -> dict:
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in done]
        share = (total - sum(done.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return done | {s: share * weight[s] for s in rest}
        done |= {s: 3 * sizes[s] for s in over}


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(VOCABULARY)


def token_files(rows) -> list[tuple]:
    """(doc_id, start, n_tokens, ids_crc32) by one loop over the ordered documents."""
    import numpy as np
    lib, start, out = library(), 0, []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxh(r[1] or ""), r[1] or "")):
        ids = [*lib.encode(r[1] or "", add_special_tokens=False).ids, 1]
        out.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def xxh(text: str) -> int:
    """Spark's xxhash64 of a string: signed, seed 42."""
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >= 1 << 63 else h
