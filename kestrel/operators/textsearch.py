"""Similar texts: TF-IDF weights, packed blocks of texts, exact top n.

A text's vector has a weight (1 + ln count) * (ln((N + 1) / (df + 1)) + 1) for
each of its terms, scaled to length 1; N and df count the texts of the same
filter value.  The similarity of two texts is the dot product.

Texts are dealt out by filter value and id to cells of bounded size, and a cell's
posting lists (a term's texts and counts) are packed into one row, a block: some
bytes a posting, where a row for each text and term takes some tens in every
exchange.  Only a cell's distinct terms meet those of other cells, dealt out by
their hash, for document frequencies and for numbers that all cells share.
Queries are packed in the same way.

A search brings each block of texts to each block of queries of its filter values
by a product of two written tables: nothing is exchanged or written again for it.
A pair of blocks is multiplied as arrays, the terms of many of its texts as
single-precision matrices, the others by their posting lists.  Texts whose sum,
within the error of single precision, reaches a query's n-th best so far are
compared in full, and the n best of them go on.  The blocks of a few cells come
first, so that the n-th best is high for all others and what goes on does not grow
with their number.  Nothing that could be in the answer is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.functions.joins import checked_broadcast
from kestrel.session import materialize

BLOCK = 256             # queries whose sums with a block of texts are held at once
LIST = 8192             # texts of a cell, about
CELL_ENTRIES = 1 << 21  # words of a cell's texts, about
CELL_TERMS = 1 << 18    # words of a cell's queries, about
WORD_BYTES = 8          # of a text's word, about
SMALLEST = 1 / 32       # of a cell, where cells are smaller so that all tasks have some
BUCKET_CELLS = 8        # cells whose terms are numbered together
FIRST = 16              # one of so many cells is searched first
TOGETHER = 8            # blocks of queries that a task holds
DENSE = 0.05            # share of a block's texts from which a term's weights are a row of a matrix
DENSE_TERMS = 1024      # such terms, at most
POSTINGS = 1 << 17      # postings that are added up at once, about
COMPARED = 1 << 12      # pairs that are compared in full at once
SLACK = 1e-9            # more than the rounding of any sum here
DIGITS = 9              # of a similarity


LOW = np.arange(256, dtype=np.uint8)        # a byte in lower case, 0 if it is in no word
LOW[65:91] += 32
LOW[[b for b in range(128) if not chr(b).isalnum()]] = 0


class Index(NamedTuple):
    sizes: DataFrame        # fkey, texts, lane, cells, buckets
    terms: DataFrame        # lane, bucket, fkeys, terms, dfs: the terms of some filter values, by their numbers
    blocks: DataFrame       # lane, cell, cells, fkeys, ids and a cell's postings
    order: DataFrame        # id, fkey, newest: which of equally similar texts comes first


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after another, and how many each has: runs of letters, digits and characters beyond ASCII
    (in UTF-8, bytes from 128), A-Z in lower case.  A NULL text has none."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or ends[0] == ends[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    low = LOW[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]]]
    ends = ends - ends[0]
    inside = low > 0
    cut = np.zeros(len(low) + 1, bool)
    cut[ends] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])))
    sizes = np.flatnonzero(inside & (cut[1:] | ~np.append(inside[1:], False))) + 1 - starts
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets), pa.py_buffer(low[inside]))
    return found, np.diff(np.searchsorted(starts, ends))


def _shut(values: np.ndarray) -> bytes:
    """An array in few bytes; whole numbers from 0 in the narrowest type that holds them."""
    if values.dtype.kind in "iu" and values.size and values.min() >= 0:
        values = values.astype(np.min_scalar_type(values.max()))
    raw = values.tobytes()
    return values.dtype.str[1:].encode() + len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _opened(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[2:10], "little")
    return np.frombuffer(pa.decompress(data[10:], size, "zstd", asbytes=True), "<" + data[:2].decode()) if size else np.empty(0, "<" + data[:2].decode())


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    """The elements of a column of lists, one after another."""
    return pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], column.type.value_type)


def _tf(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts.astype(float))       # of narrow numbers NumPy would take narrow logarithms


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct ones (NULL is one of them), and these."""
    found = values.dictionary_encode(null_encoding="encode")
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``starts``, one run after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _pack(table: pa.Table) -> pa.Table:
    """A cell's texts as one row: terms in buckets by their hash, and the texts and counts of each term.

    Texts are numbered by ``place``; rows of the same filter value and id are one
    text.  A text without an id counts in ``dfs``, and is found by its empty id.
    """
    table = table.combine_chunks()
    column = {c: table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in table.column_names}
    order = np.argsort(column["place"].to_numpy(), kind="stable")
    f_rows, f_values = _coded(column["fkey"])
    i_rows, i_values = _coded(column["id"])
    own, _ = pd.factorize((f_rows * len(i_values) + i_rows)[order])
    first = order[np.unique(own, return_index=True)[1]]
    text_of = np.empty(len(order), np.int64)
    text_of[order] = own
    texts, fkeys, buckets = len(first), len(f_values), int(column["buckets"][0].as_py())

    found, per_row = words(column["text"])
    used, vocabulary = _coded(found)
    bucket = (pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False).astype(object), categorize=False) % buckets).astype(np.int64)
    by_bucket = np.argsort(bucket, kind="stable")
    number = np.empty(len(by_bucket), np.int64)
    number[by_bucket] = np.arange(len(by_bucket))
    rows = np.repeat(np.arange(len(order)), per_row)
    entries, counts = np.unique((number[used] * fkeys + f_rows[rows]) * texts + text_of[rows], return_counts=True)
    terms, posts = entries // texts, entries % texts
    starts = _starts(terms)
    distinct = terms[starts]
    word, f = by_bucket[distinct // fkeys], distinct % fkeys
    found, sizes = np.unique(bucket[word], return_counts=True)
    dfs = np.diff(np.append(starts, len(terms)))
    shares = pa.StructArray.from_arrays(
        [pa.array(found, pa.int32()), _lists(f_values.take(pa.array(f)), sizes), _lists(vocabulary.take(pa.array(word)), sizes),
         _lists(pa.array(dfs, pa.int32()), sizes)], names=["bucket", "fkeys", "terms", "dfs"])
    one = {c: column[c].slice(0, 1) for c in ("lane", "cell", "cells")}
    one["fkeys"], one["ids"], one["totals"] = (_lists(column[c].take(pa.array(first)), np.array([texts])) for c in ("fkey", "id", "texts"))
    one |= {"posts": pa.array([_shut(posts)]), "counts": pa.array([_shut(counts)]), "shares": _lists(shares, np.array([len(found)]))}
    return pa.table(one)


def _packed(texts: DataFrame, sizes: DataFrame, cells: str, name: str) -> DataFrame:
    """``texts`` (id, fkey, text, newest) in blocks: of a cell's texts, the one that comes first among equals is its first."""
    small, _ = checked_broadcast(sizes.select("fkey", "texts", "lane", F.col(cells).alias("cells"), "buckets"))
    dealt = texts.join(small, "fkey").withColumn("cell", F.pmod(F.xxhash64("id"), "cells").cast("int"))
    own = Window.partitionBy("lane", "cell")
    dealt = dealt.withColumn("place", F.row_number().over(own.orderBy(F.col("newest").desc(), "id")))
    dealt = dealt.select("lane", "cell", "cells", "buckets", "texts", "place", "fkey", "id", "text")
    f, i = texts.schema["fkey"].dataType, texts.schema["id"].dataType
    share = T.StructType().add("bucket", "integer").add("fkeys", T.ArrayType(f)).add("terms", T.ArrayType(T.StringType())).add("dfs", T.ArrayType(T.IntegerType()))
    schema = (T.StructType().add("lane", "long").add("cell", "integer").add("cells", "integer").add("fkeys", T.ArrayType(f)).add("ids", T.ArrayType(i))
              .add("totals", T.ArrayType(T.LongType())).add("posts", "binary").add("counts", "binary").add("shares", T.ArrayType(share)))
    return materialize(dealt.groupBy("lane", "cell").applyInArrow(_pack, schema), name)


def _numbered(table: pa.Table) -> pa.Table:
    """Of a bucket's terms (``base``: the rows that count, which come first): numbers and document frequencies for each
    cell's, and where cells are the base the terms themselves, as the row of no cell."""
    table = table.sort_by([("base", "descending"), ("cell", "ascending")])
    terms, words = _coded(_flat(table["terms"]))
    fkeys, values = _coded(_flat(table["fkeys"]))
    sizes = pc.list_value_length(table["terms"]).to_numpy().astype(np.int64)
    base = np.repeat(table["base"].to_numpy().astype(bool), sizes)
    codes, distinct = pd.factorize(terms * max(1, len(values)) + fkeys)
    dfs = np.bincount(codes, np.where(base, _flat(table["dfs"]).to_numpy(), 0), len(distinct)).astype(np.int64)
    known = int(codes[base].max()) + 1 if base.any() else 0
    cells = table["cell"].to_numpy()
    building = bool((cells[table["base"].to_numpy().astype(bool)] >= 0).any())
    out = cells >= 0
    keep = np.repeat(out, sizes)
    # The distinct terms are written once, after the cells.
    place = np.arange(len(distinct)) if building else np.empty(0, np.int64)
    codes = np.append(codes[keep], place)
    sizes = np.append(sizes[out], [len(place)] if building else []).astype(np.int64)
    cells = np.append(cells[out], [-1] if building else [])
    none = np.append(np.zeros(int(out.sum()), np.int64), [len(place)] if building else []).astype(np.int64)
    return pa.table({
        "lane": pa.array([table["lane"][0].as_py()] * len(cells), pa.int64()), "bucket": pa.array([table["bucket"][0].as_py()] * len(cells), pa.int32()),
        "cell": pa.array(cells, pa.int32()), "codes": _lists(pa.array(np.where(codes < known, codes, -1), pa.int32()), sizes),
        "dfs": _lists(pa.array(dfs[codes], pa.int32()), sizes),
        "fkeys": _lists(values.take(pa.array(distinct[place] % max(1, len(values)))), none),
        "terms": _lists(words.take(pa.array(distinct[place] // max(1, len(values)))), none)})


def _number(shares: DataFrame, name: str) -> DataFrame:
    f = shares.schema["fkeys"].dataType
    schema = (T.StructType().add("lane", "long").add("bucket", "integer").add("cell", "integer").add("codes", T.ArrayType(T.IntegerType())).add("dfs", T.ArrayType(T.IntegerType()))
              .add("fkeys", f).add("terms", T.ArrayType(T.StringType())))
    return materialize(shares.groupBy("lane", "bucket").applyInArrow(_numbered, schema), name)


def _shares(packed: DataFrame, base: bool) -> DataFrame:
    return packed.select("lane", "cell", F.explode("shares").alias("s")).select(
        "lane", "cell", F.lit(base).alias("base"), "s.bucket", "s.fkeys", "s.terms", "s.dfs")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the numbers and weights of their terms in the order of the numbers, and the length of each text."""
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i] for c in b.schema.names}
            known, codes, dfs = row["known"].values, np.empty(0, np.int64), np.empty(0, np.int64)
            if known is not None and len(known):
                known = known.take(pc.sort_indices(known.field("bucket")))
                first = np.repeat(known.field("bucket").to_numpy().astype(np.int64) << 32, known.field("codes").value_lengths().to_numpy())
                codes, dfs = (known.field(c).flatten().to_numpy() for c in ("codes", "dfs"))
                codes = np.where(codes < 0, -1, first + codes)
            sizes = row["sizes"].values.flatten().to_numpy().astype(np.int64)
            posts, counts, totals = _opened(row["posts"].as_py()), _opened(row["counts"].as_py()), row["totals"].values.to_numpy()
            starts = np.cumsum(sizes) - sizes
            idf = np.log((totals[posts[starts]] + 1.0) / (dfs + 1.0)) + 1.0 if len(sizes) else np.empty(0)
            lengths = np.sqrt(np.bincount(posts, (np.repeat(idf, sizes) * _tf(counts)) ** 2, len(totals)))
            lengths[row["ids"].values.is_null().to_numpy(zero_copy_only=False)] = np.inf
            order = np.argsort(codes, kind="stable")
            order = order[codes[order] >= 0]
            at = _spread(starts[order], sizes[order])
            data = {"codes": codes[order], "idf": idf[order], "sizes": sizes[order], "posts": posts[at], "counts": counts[at], "lengths": lengths}
            out = [b.column(c).slice(i, 1) for c in ("lane", "cell", "cells", "fkeys", "ids")]
            yield pa.RecordBatch.from_arrays([*out, *[pa.array([_shut(v)], pa.binary()) for v in data.values()]],
                                             names=["lane", "cell", "cells", "fkeys", "ids", *data])


DATA = ("codes", "idf", "sizes", "posts", "counts", "lengths")


def _blocks(packed: DataFrame, numbered: DataFrame, name: str) -> DataFrame:
    known = numbered.where("cell >= 0").groupBy("lane", "cell").agg(F.collect_list(F.struct("bucket", "codes", "dfs")).alias("known"))
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = packed.withColumn("sizes", F.col("shares.dfs")).drop("shares").repartition(n, "lane", "cell").join(known, ["lane", "cell"], "left")
    schema = T.StructType([packed.schema[c] for c in ("lane", "cell", "cells", "fkeys", "ids")])
    for c in DATA:
        schema = schema.add(c, "binary")
    return materialize(both.mapInArrow(_finished, schema), name)


def _sizes(texts: DataFrame) -> DataFrame:
    """How many texts a filter value has, the lane that it shares with others (a large one has its own), how many cells and
    buckets of terms that has."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    load = F.greatest(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / (CELL_ENTRIES * WORD_BYTES), F.count(F.lit(1)) / LIST)
    sizes = materialize(texts.groupBy("fkey").agg(F.count(F.lit(1)).alias("texts"), load.alias("load")), "text-loads")
    total = sizes.agg(F.sum("load")).first()[0] or 0.0
    unit = min(1.0, max(total / n, SMALLEST))
    lanes = max(1, int(total / unit))
    hashed = F.xxhash64("fkey")
    sizes = sizes.withColumn("lane", F.when(F.col("load") >= unit / 2, hashed).otherwise(F.pmod(hashed, F.lit(lanes))))
    sizes = sizes.withColumn("cells", F.ceil(F.sum("load").over(Window.partitionBy("lane")) / unit).cast("int"))
    sizes = sizes.withColumn("cells", F.greatest("cells", F.lit(1))).withColumn("buckets", F.ceil(F.col("cells") / BUCKET_CELLS).cast("int"))
    return materialize(sizes.drop("load"), "text-sizes")


def build(texts: DataFrame) -> Index:
    """The index of ``texts`` (id, fkey, text, newest): ids are unique within a filter value; of texts that are equally
    similar the one with the larger ``newest`` comes first, then the smaller id.

    A NULL text has no terms; a NULL filter value is found by no query; texts
    without terms are similar to nothing.
    """
    texts = texts.where(F.col("fkey").isNotNull())
    sizes = _sizes(texts)
    packed = _packed(texts.select("id", "fkey", "text", "newest"), sizes, "cells", "packed-texts")
    numbered = _number(_shares(packed, True), "text-terms")
    terms = numbered.where("cell < 0").select("lane", "bucket", "fkeys", "terms", "dfs")
    order = materialize(texts.select("id", "fkey", "newest"), "text-order")
    return Index(sizes, terms, _blocks(packed, numbered, "text-blocks"), order)


def _query_blocks(index: Index, queries: DataFrame) -> DataFrame:
    """The queries in blocks as the texts are, with the index's numbers of their terms; terms that it doesn't know count in
    the queries' lengths."""
    asked = queries.where(F.col("query_id").isNotNull()).select(F.col("query_id").alias("id"), "fkey", "text")
    small, _ = checked_broadcast(index.sizes)
    load = F.greatest(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) / (CELL_TERMS * WORD_BYTES), F.count(F.lit(1)) / LIST)
    groups = asked.join(small.select("fkey", "lane"), "fkey").groupBy("lane").agg(F.greatest(F.ceil(load), F.lit(1)).cast("int").alias("groups"))
    sizes = materialize(index.sizes.join(groups, "lane"), "query-sizes")
    packed = _packed(asked.withColumn("newest", F.lit(None).cast("int")), sizes, "groups", "packed-queries")
    base = index.terms.select("lane", F.lit(-1).alias("cell"), F.lit(True).alias("base"), "bucket", "fkeys", "terms", "dfs")
    return _blocks(packed, _number(base.unionByName(_shares(packed, False)), "query-terms"), "query-blocks")


class _Texts:
    """A block of texts: posting lists by number of the term, the terms of many texts as a matrix."""

    def __init__(self, row: dict):
        self.fkeys, self.ids = row["fkeys"].values, row["ids"].values
        self.codes, idf, self.sizes, self.posts, counts, lengths = (_opened(row[c].as_py()) for c in DATA)
        self.sizes, self.count = self.sizes.astype(np.int64), len(self.ids)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.weights = _tf(counts) * np.repeat(idf, self.sizes) / lengths[self.posts]
        often = np.flatnonzero(self.sizes > DENSE * self.count)
        often = often[np.argsort(-self.sizes[often], kind="stable")][:DENSE_TERMS]
        self.row = np.full(len(self.codes), -1)
        self.row[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.count))
        at = _spread(self.starts[often], self.sizes[often])
        self.matrix[np.repeat(np.arange(len(often)), self.sizes[often]), self.posts[at]] = self.weights[at]
        self.single = self.matrix.astype(np.float32)
        self.error = SLACK + (len(often) + 8) * 1.2e-7      # of a sum of single precision products, none above 1 in all


class _Queries:
    """A block of queries: (query, term's number, weight), by query."""

    def __init__(self, row: dict):
        self.fkeys, self.ids = row["fkeys"].values, row["ids"].values
        self.codes, idf, sizes, posts, counts, lengths = (_opened(row[c].as_py()) for c in DATA)
        by_query = np.argsort(posts, kind="stable")
        self.query = posts[by_query].astype(np.int64)
        self.term = np.repeat(np.arange(len(sizes)), sizes)[by_query]
        self.weight = (_tf(counts) * np.repeat(idf, sizes) / lengths[posts])[by_query]


def _same(texts: _Texts, queries: _Queries) -> np.ndarray:
    """Per query the text that has its filter value and id, or -1."""
    f, fkeys = _coded(texts.fkeys)
    i, ids = _coded(texts.ids)
    asked_f = pc.index_in(queries.fkeys, fkeys).fill_null(-1).to_numpy().astype(np.int64)
    asked_i = pc.index_in(queries.ids.cast(ids.type), ids).fill_null(-1).to_numpy().astype(np.int64)
    asked = np.where((asked_f >= 0) & (asked_i >= 0), asked_f * len(ids) + asked_i, -1)
    return pd.Index(f * len(ids) + i).get_indexer(asked)


def _best(texts: _Texts, queries: _Queries, floors: np.ndarray, n: int, exclude_self: bool, block: int):
    """(query, text, score) of the pairs that can be among a query's ``n`` best, a chunk of queries at a time; ``floors``, the
    n-th best scores so far, rise."""
    at = np.minimum(np.searchsorted(texts.codes, queries.codes), max(0, len(texts.codes) - 1))
    known = texts.codes[at] == queries.codes if len(texts.codes) else np.zeros(len(queries.codes), bool)
    keep = known[queries.term]
    query, term, weight = queries.query[keep], at[queries.term[keep]], queries.weight[keep]
    row = texts.row[term]
    dense = row >= 0
    work = np.bincount(query, np.where(dense, 0, texts.sizes[term]), len(floors))
    self_at = _same(texts, queries) if exclude_self else None
    for first in range(0, len(floors), block):
        last = min(first + block, len(floors))
        lo, hi = np.searchsorted(query, [first, last])
        q, t, w, d, r = query[lo:hi] - first, term[lo:hi], weight[lo:hi], dense[lo:hi], row[lo:hi]
        count = last - first
        sums = np.empty((count, texts.count))
        done = 0
        while done < count:         # as many queries as have so many postings
            to = done + max(1, int(np.searchsorted(np.cumsum(work[first + done:last]), POSTINGS, "right")))
            lo, hi = np.searchsorted(q, [done, to])
            some = lo + np.flatnonzero(~d[lo:hi])
            sizes = texts.sizes[t[some]]
            places = _spread(texts.starts[t[some]], sizes)
            at_sum = np.repeat((q[some] - done) * texts.count, sizes)
            at_sum += texts.posts[places]
            shares = texts.weights[places]
            shares *= np.repeat(w[some], sizes)
            sums[done:to] = np.bincount(at_sum, shares, (to - done) * texts.count).reshape(to - done, texts.count)
            done = to
        asked = np.zeros((count, len(texts.matrix)))
        asked[q[d], r[d]] = w[d]
        total = sums + asked.astype(np.float32) @ texts.single
        if self_at is not None:
            own = np.flatnonzero(self_at[first:last] >= 0)
            total[own, self_at[first:last][own]] = 0.0
        floor = floors[first:last]
        least = floor.copy()
        new = np.flatnonzero(floor <= 0)
        if texts.count > n and len(new):
            least[new] = np.partition(total[new], -n, axis=1)[:, -n] - texts.error
        found, text = np.nonzero((total > 0) & (total >= (least - texts.error)[:, None]))
        score = sums[found, text]
        for i in range(0, len(found), COMPARED):
            part = slice(i, i + COMPARED)
            score[part] += np.einsum("ij,ji->i", asked[found[part]], texts.matrix[:, text[part]])
        score = np.round(score, DIGITS)
        reached = score >= floor[found]
        found, text, score = found[reached], text[reached], score[reached]
        order = np.lexsort((text, -score, found))           # the texts' numbers are their order among equals
        found, text, score = found[order], text[order], score[order]
        begin = _starts(found)
        place = np.arange(len(found)) - np.repeat(begin, np.diff(np.append(begin, len(found))))
        nth = place == n - 1
        floors[first + found[nth]] = np.maximum(floor[found[nth]], score[nth])
        kept = place < n
        yield found[kept] + first, text[kept], score[kept]


def _meet(n: int, exclude_self: bool, block: int, kept: int, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, at, held, floors = None, None, {}, {}
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                lane, cell, asked = (row[c].as_py() for c in ("lane", "cell", "q_cell"))
                if at != (lane, cell):
                    texts, at = _Texts(row), (lane, cell)
                key = lane, asked
                if key not in held:
                    if len(held) >= kept:
                        held.clear()
                    held[key] = _Queries({c.removeprefix("q_"): v for c, v in row.items() if c.startswith("q_")})
                queries = held[key]
                if key not in floors:
                    floors[key] = np.zeros(len(queries.ids))
                    for f in row["q_floors"].as_py() or []:
                        floors[key][f["q"]] = f["floor"]
                for q, t, score in _best(texts, queries, floors[key], n, exclude_self, block):
                    if len(q):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lane] * len(q), pa.int64()), pa.array([asked] * len(q), pa.int32()), pa.array(q, pa.int32()),
                             queries.ids.take(pa.array(q)), queries.fkeys.take(pa.array(q)), texts.ids.take(pa.array(t)), pa.array(score)], names=names)
    return run


def _found(blocks: DataFrame, asked: DataFrame, n: int, exclude_self: bool) -> DataFrame:
    """(lane, cell, q, query_id, fkey, id, score) of pairs of ``blocks`` of texts and of queries (``asked``, with the
    ``floors`` known of some) that can be among a query's ``n`` best."""
    q = asked.select(*[F.col(c).alias(f"q_{c}") for c in ("lane", "cell", "fkeys", "ids", *DATA, "floors")])
    # No equality, which would bring all blocks of a lane into one task.
    both = blocks.hint("shuffle_replicate_nl").join(q, (F.col("lane") <= F.col("q_lane")) & (F.col("lane") >= F.col("q_lane")))
    of = {c: f.dataType.elementType for f in q.schema for c in [f.name] if c in ("q_ids", "q_fkeys")}
    schema = (T.StructType().add("lane", "long").add("cell", "integer").add("q", "integer").add("query_id", of["q_ids"]).add("fkey", of["q_fkeys"])
              .add("id", blocks.schema["ids"].dataType.elementType).add("score", "double"))
    return both.drop("q_lane").mapInArrow(_meet(n, exclude_self, BLOCK, 2 * TOGETHER, schema.names), schema)


def search(index: Index, queries: DataFrame, n: int = 5, exclude_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(the ``n`` most similar texts of each query, pairs compared in full that were among the best).

    ``queries``: (query_id, fkey, text), ids unique.  Returns query_id, fkey, rank, id,
    score (rounded to ``DIGITS``); texts that share no term with the query are
    not similar.  With ``exclude_self`` the text whose id is the query's is left out.
    """
    asked = _query_blocks(index, queries)
    parts = max(1, -(-asked.count() // TOGETHER))
    early = F.col("cell") < F.ceil(F.col("cells") / FIRST)
    none = asked.withColumn("floors", F.lit(None).cast("array<struct<q:int,floor:double>>"))
    seeds = materialize(_found(index.blocks.where(early), none.coalesce(parts), n, exclude_self), "text-seeds")
    nth = Window.partitionBy("lane", "cell", "q").orderBy(F.col("score").desc(), "id")
    floors = seeds.withColumn("_r", F.row_number().over(nth)).where(F.col("_r") == n).groupBy("lane", "cell").agg(
        F.collect_list(F.struct("q", F.col("score").alias("floor"))).alias("floors"))
    raised = materialize(asked.join(floors, ["lane", "cell"], "left"), "query-floors")
    found = seeds.unionByName(_found(index.blocks.where(~early), raised.coalesce(parts), n, exclude_self))
    # Equal ones stay until the order of all is known.
    by_score = Window.partitionBy("query_id", "fkey").orderBy(F.col("score").desc())
    pairs = found.withColumn("_r", F.rank().over(by_score)).where(F.col("_r") <= n).select("query_id", "fkey", "id", "score")
    pairs = materialize(pairs, "text-pairs")
    scored = pairs.join(index.order, ["fkey", "id"])
    best = Window.partitionBy("query_id", "fkey").orderBy(F.col("score").desc(), F.col("newest").desc(), "id")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select("query_id", "fkey", "rank", "id", "score"), pairs


def similar_texts(texts: DataFrame, queries: DataFrame, n: int = 5, exclude_self: bool = True) -> DataFrame:
    """The ``n`` texts most similar to each query, through an index built for them (``build``, ``search``)."""
    return search(build(texts), queries, n, exclude_self)[0]
