"""Token-id files in Simple-8b coding.

A 64-bit word holds a selector (top 4 bits) and 60 bits of payload: selectors
1 to 14 pack 60, 30, 20, ... 1 ids of 1, 2, 3, ... 60 bits each, first id
lowest.  Selector 0 is the escape: the next word is one raw 64-bit value.  A
block is packed in strips of ``STRIP`` ids with an offset each, so that strips
are packed and unpacked side by side, and any place is found without reading
what stands before it.  A strip's last word may have room left; the counts tell.

A file set is a Parquet folder of blocks, written and committed by Spark:
``shard`` (files in ascending doc_id order), ``block`` (number in the shard),
``first`` (ids of the shard before the block), ``n_ids``, ``doc_ids`` and
``lengths`` (of the documents whose ids the block holds, whole documents in
order), ``offsets`` (of the strips, in words), ``words`` (little-endian).  A document's ids are
found from its block's directory; a block is decoded in whole-array steps, one
per selector.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.common import slices
from kestrel.llm.tokenizing import encoder
from kestrel.session import materialize

END_ID = 1
STRIP = 1024              # ids of a strip, whose words begin anew
BLOCK_IDS = 1 << 19       # a block is closed once it holds this many ids
DOCUMENTS_AT_ONCE = 2048  # documents whose ids a task holds
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])     # by selector; 0: the escape
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
PAYLOAD = np.uint64((1 << 60) - 1)

BLOCK_SCHEMA = ("shard int, block int, first bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, "
                "offsets array<bigint>, words binary")
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                    ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("words", pa.binary())])


def bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits needed by each unsigned value (0 for 0)."""
    out = np.frexp(v.astype(np.float64))[1].astype(np.uint8)
    large = np.flatnonzero(v >= np.uint64(1 << 52))       # beyond, a float may round up to the next power of two
    out[large] = [int(x).bit_length() for x in v[large].tolist()]
    return out


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): unsigned 64-bit values packed in strips of ``STRIP`` values, and where each strip's words begin.

    Each word takes as many of its strip's next values as any selector can
    hold; all strips are walked in step.
    """
    n = len(values)
    strips = -(-n // STRIP)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    pad = int(COUNTS.max())                            # zeros after each strip: a last word has room left
    v = np.zeros((strips, STRIP + pad), np.uint64)
    v[:, :STRIP].flat[:n] = values
    flat = v.ravel()
    m = len(flat)
    widest = {1: np.concatenate([bit_lengths(flat), np.zeros(pad, np.uint8)])}     # by window: the most bits in it
    for w in (2, 4, 8, 16, 32):
        half = widest[w // 2]
        widest[w] = np.maximum(half[:len(half) - w // 2], half[w // 2:])
    selector = np.zeros(m, np.uint8)
    for s in range(len(COUNTS) - 1, 0, -1):            # the largest count that fits wins
        c = int(COUNTS[s])
        p = 1 << (c.bit_length() - 1)
        most = np.maximum(widest[p][:m], widest[p][c - p:c - p + m])
        np.copyto(selector, np.uint8(s), where=most <= np.uint8(BITS[s]))
    begin = np.arange(strips) * (STRIP + pad)
    end = begin + np.minimum(STRIP, n - np.arange(strips) * STRIP)
    at, own, cur, live = [], [], begin, np.arange(strips)
    while len(live):
        at.append(cur)
        own.append(live)
        cur = cur + COUNTS[selector[cur]]
        on = cur < end[live]
        cur, live = cur[on], live[on]
    at, own = np.concatenate(at), np.concatenate(own)
    order = np.argsort(at, kind="stable")
    at, own = at[order], own[order]
    sel = selector[at].astype(np.int64)
    size = 1 + (sel == 0)                              # an escape takes two words
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    flat = np.concatenate([flat, np.zeros(pad, np.uint64)])
    for s in np.unique(sel):
        w = np.flatnonzero(sel == s)
        if s == 0:
            out[place[w] + 1] = flat[at[w]]
            continue
        shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        packed = np.bitwise_or.reduce(flat[at[w][:, None] + np.arange(COUNTS[s])] << shift, axis=1)
        out[place[w]] = packed | np.uint64(int(s) << 60)
    return out, place[np.searchsorted(own, np.arange(strips))]


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values that ``encode`` packed."""
    w = np.ascontiguousarray(words, np.uint64)
    sel = (w >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(w), bool)
    for i in np.flatnonzero(sel == 0).tolist():        # none in ordinary files
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    hs = sel[heads]
    strip = np.searchsorted(offsets, heads, "right") - 1
    before = np.cumsum(COUNTS[hs]) - COUNTS[hs]
    first = before[np.searchsorted(heads, offsets)] if len(heads) else before
    pad = int(COUNTS.max())
    begins = before - first[strip] + strip * (STRIP + pad)
    out = np.zeros((len(offsets), STRIP + pad), np.uint64)
    flat = out.reshape(-1)
    for s in np.unique(hs):
        own = hs == s
        if s == 0:
            flat[begins[own]] = w[heads[own] + 1]
            continue
        shift = (np.arange(COUNTS[s]) * BITS[s]).astype(np.uint64)
        mask = np.uint64((1 << int(BITS[s])) - 1)
        flat[begins[own][:, None] + np.arange(COUNTS[s])] = ((w[heads[own]] & PAYLOAD)[:, None] >> shift) & mask
    return out[:, :STRIP].reshape(-1)[:n]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode every text of ``docs`` (doc_id, text), append ``end_id``, and write the ids below ``path``.

    Documents go to the files in ascending doc_id order (NULL ids last; equal
    ids by content hash, then text).  Texts are dealt out once, by ranges of
    ids and content hash, so that neither a hot source nor a repeated id
    gathers in a task; a task encodes its range in order and holds one batch
    of texts and one open block.  NULL texts are empty: their ids are the end id alone.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("__h")]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")

    def blocks(batches):
        enc, shard = encoder(vocabulary), TaskContext.get().partitionId()
        number, first = 0, 0
        ids, doc_ids, lengths = np.zeros(0, np.uint32), [], np.zeros(0, np.int64)
        last = slices(batches, DOCUMENTS_AT_ONCE)
        while True:
            b = next(last, None)
            if b is not None:
                own, n = enc.batch(b.column("text"), overlaps=False)
                ends = np.cumsum(n + 1)                                     # each document's ids, then the end id
                whole = np.full(len(own) + len(n), end_id, np.uint32)
                inside = np.ones(len(whole), bool)
                inside[ends - 1] = False
                whole[inside] = own
                ids, doc_ids, lengths = np.concatenate([ids, whole]), doc_ids + b.column("doc_id").to_pylist(), np.concatenate([lengths, n + 1])
            ends, begin, at = np.cumsum(lengths), 0, 0
            while at < len(ends) and (b is None or ends[-1] - begin >= block_ids):
                # whole documents up to the one with which the block is full
                cut = min(int(np.searchsorted(ends, begin + block_ids)), len(ends) - 1) + 1
                v = ids[begin:ends[cut - 1]]
                words, offsets = encode(v)
                row = (shard, number, first, len(v), doc_ids[at:cut], lengths[at:cut], offsets, words.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _ARROW.types, strict=True)], schema=_ARROW)
                number, first, begin, at = number + 1, first + len(v), int(ends[cut - 1]), cut
            ids, doc_ids, lengths = ids[begin:], doc_ids[at:], lengths[at:]
            if b is None:
                return

    rows.mapInArrow(blocks, BLOCK_SCHEMA).write.parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of the files below ``path``: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32 (of its ids as little-endian unsigned 32-bit integers) and, if asked for, ids (array<bigint>)."""
    files = spark.read.schema(BLOCK_SCHEMA).parquet(path)

    def documents(batches):
        for b in batches:
            for r in b.to_pylist():
                v = decode(np.frombuffer(r["words"], "<u8"), np.array(r["offsets"], np.int64), r["n_ids"])
                ends = np.cumsum(np.array(r["lengths"], np.int64))
                begins = ends - np.array(r["lengths"], np.int64)
                own = [v[x:y] for x, y in zip(begins.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array([r["shard"]] * len(own), pa.int32()), pa.array(r["doc_ids"], pa.int64()),
                        pa.array(begins + r["first"]), pa.array(ends - begins),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in own], pa.int64())]
                if with_ids:
                    cols.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                names = ["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"][:len(cols)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = files.mapInArrow(documents, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
                            + (", ids array<bigint>" if with_ids else ""))
    sums = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)     # a row per shard
    starts = materialize(sums.select("shard", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("s")), "shards")
    out = rows.join(starts, "shard").withColumn("start", F.col("s") + F.col("at"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
