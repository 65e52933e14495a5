"""SimHash near-duplicate groups by tiled exact comparison.

``fingerprints`` turns every text into 64 bits.  ``components`` compares the
distinct fingerprints exactly:

* Two fingerprints within ``radius`` bits agree on at least one of
  ``radius + 1`` bit bands (the differing bits touch at most ``radius`` of
  them), so a pair is found in a tile: the fingerprints that share a band.
* A tile of more than ``TILE_ROWS`` rows is divided by population count (and,
  where one count alone is too large, by hash) into sub-tiles, and only pairs
  of sub-tiles whose population counts differ by at most ``radius`` meet; each
  such pair is a group of its own, so one huge tile spreads over tasks.
* In a task, rows of a group are compared with numpy exclusive-or and bit
  counts, again by blocks whose ranges of population counts are close enough.
  Links found are merged at once; a group hands on at most one link per row.

Links are then contracted to components by repeated grouped minima over
written tables, without a cap on rounds.  Copies of a text share a
fingerprint and enter the comparison once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import MARKS, add_columns, distinct_rows, row_marks, text_bytes
from kestrel.session import materialize

SHINGLE_WORDS = 3
RADIUS = 2
SEED = 42
TILE_ROWS = 2048        # rows of a tile that are compared as one group
BLOCK_ROWS = 256        # rows of a numpy comparison block
HASHES_AT_ONCE = 1 << 16  # shingle hashes of a long text whose bits are summed at a time


def simhash64(text: bytes, width: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bit majority of the XXH64 of all word shingles (repeats count), as an unsigned integer.

    A text of fewer than ``width`` words is one shingle; one without words is 0.
    """
    words = text.lower().split()        # bytes: A-Z only; splits on \\x20, \\x09-\\x0D only
    n = len(words)
    if n <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), seed) if n else 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    total, ones = n - width + 1, np.zeros(64, np.int64)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, total)
    for i in range(0, total, HASHES_AT_ONCE):
        part = hashes[i:i + HASHES_AT_ONCE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, seed: int = SEED,
                 keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) plus ``fp`` long: the fingerprint's 64 bits as a signed integer.

    NULL and empty texts have fingerprint 0.
    """
    def make():
        return lambda b: [np.array([simhash64(t, width, seed) for t in text_bytes(b)], np.uint64).view(np.int64)]
    return add_columns(docs, {"fp": "bigint"}, make, keep)


def merge_links(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each row's root, the smallest row of its group) after linking rows a[i] and b[i]."""
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while (label[label] != label).any():
            label = label[label]


def close_pairs(x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) with at most ``radius`` bits between x[i] and y[j]."""
    return np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)


def tile_roots(x: np.ndarray, side: np.ndarray, radius: int) -> np.ndarray:
    """Each row's root after linking the close rows of one group.

    ``side``: 0 or 1 for the two sub-tiles of a pair (only rows of different
    sides are compared), or 2 for a tile compared with itself.
    """
    pop = np.bitwise_count(x).astype(np.int64)
    order = np.argsort(pop, kind="stable")
    xs, ps, ss = x[order], pop[order], side[order]
    label = np.arange(len(x))
    for i in range(0, len(x), BLOCK_ROWS):
        bi = slice(i, i + BLOCK_ROWS)
        top = ps[bi][-1]
        for j in range(i, len(x), BLOCK_ROWS):
            if ps[j] - top > radius:        # sorted: every later block is farther still
                break
            bj = slice(j, j + BLOCK_ROWS)
            a, b = close_pairs(xs[bi], xs[bj], radius)
            a, b = a + i, b + j
            use = (a < b) & ((ss[a] == 2) | (ss[a] != ss[b]))
            if use.any():
                label = merge_links(label, a[use], b[use])
    roots = np.empty_like(label)
    roots[order] = order[label]
    return roots


def small_tile_links(x: np.ndarray, tile: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small tiles at once: rows of a tile are adjacent; shift by 1, 2, ... and compare."""
    out_a, out_b, d = [], [], 1
    rows = np.arange(len(x))
    while True:
        rows = rows[rows + d < len(x)]
        rows = rows[tile[rows] == tile[rows + d]]
        if not len(rows):
            break
        hit = rows[np.bitwise_count(x[rows] ^ x[rows + d]) <= radius]
        out_a.append(hit)
        out_b.append(hit + d)
        d += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


SMALL_TILE = 48


def _group_links(radius: int):
    """Arrow function: rows sorted by group key (k) -> links (a, b) with a's root b."""
    def links_of(key, fp, side):
        x = fp.view(np.uint64)
        new = np.concatenate(([True], key[1:] != key[:-1]))
        tile = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, len(x)))
        out = []
        few = np.flatnonzero((size <= SMALL_TILE)[tile])
        a, b = small_tile_links(x[few], tile[few], radius)
        a, b = few[a], few[b]
        use = (side[a] == 2) | (side[a] != side[b])
        out.append((fp[a[use]], fp[b[use]]))
        for t in np.flatnonzero(size > SMALL_TILE):
            s = slice(starts[t], starts[t] + size[t])
            roots = tile_roots(x[s], side[s], radius)
            moved = np.flatnonzero(roots != np.arange(size[t]))
            out.append((fp[s][moved], fp[s][roots[moved]]))
        return out

    def run(batches):
        held = None
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def emit(cols):
            for a, b in links_of(*cols):
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            cols = [np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("k", "fp", "side")]
            if held is not None:
                cols = [np.concatenate(p) for p in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            before = np.flatnonzero(cols[0] != cols[0][-1])
            last = int(before[-1]) + 1 if len(before) else 0      # the last group may go on in the next batch
            if last:
                yield from emit([c[:last] for c in cols])
            held = [c[last:] for c in cols]
        if held is not None:
            yield from emit(held)
    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that span every pair within ``radius`` bits.

    ``distinct``: one row per fingerprint, column ``fp``.
    """
    bands = radius + 1
    cuts = [round(64 * i / bands) for i in range(bands + 1)]
    band = F.array(*[F.struct(F.lit(i).alias("band"),
                              F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value"))
                     for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))])
    rows = distinct.select("fp", F.bit_count("fp").alias("pop"), F.inline(band))
    sizes = rows.groupBy("band", "value", "pop").agg(F.count("*").alias("n"))
    tiles = (sizes.groupBy("band", "value")
             .agg(F.sum("n").alias("n"),
                  F.map_from_entries(F.collect_list(F.struct(       # at most 65 entries
                      F.col("pop"), F.ceil(F.col("n") / tile_rows).cast("int")))).alias("parts"))
             .where("n > 1")                                          # a lone row has no partner in its tile
             .withColumn("parts", F.when(F.col("n") > tile_rows, F.col("parts"))))
    rows = rows.join(tiles, ["band", "value"])
    # A row of a divided tile: its own sub-tile (pop, part) meets every sub-tile whose count is near.
    mine = F.struct(F.col("pop").alias("pop"),
                    F.pmod(F.xxhash64("fp"), F.element_at("parts", F.col("pop"))).cast("int").alias("part"))
    near = F.filter(F.map_keys("parts"), lambda p: F.abs(p - F.col("pop")) <= radius)
    met = F.flatten(F.transform(near, lambda p: F.transform(
        F.sequence(F.lit(0), F.element_at("parts", p) - 1),
        lambda i: F.struct(p.alias("pop"), i.alias("part")))))
    rows = rows.withColumn("mine", F.when(F.col("parts").isNotNull(), mine))
    pairs = F.transform(met, lambda o: F.struct(
        F.least(F.col("mine"), o).alias("x"), F.greatest(F.col("mine"), o).alias("y"),
        F.when(o == F.col("mine"), 2).when(F.col("mine") < o, 0).otherwise(1).alias("side")))
    whole = F.array(F.struct(F.lit(None).cast("struct<pop:int,part:int>").alias("x"),
                             F.lit(None).cast("struct<pop:int,part:int>").alias("y"), F.lit(2).alias("side")))
    rows = rows.select("fp", "band", "value", F.inline(F.when(F.col("parts").isNull(), whole).otherwise(pairs)))
    # Groups carry a 64-bit key; should two groups share one, the comparison stays exact (more pairs are tried).
    rows = rows.select(F.xxhash64("band", "value", "x", "y").alias("k"), "fp", "side")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "k").sortWithinPartitions("k")
    return rows.mapInArrow(_group_links(radius), "a bigint, b bigint")


def contract(edges: DataFrame) -> DataFrame | None:
    """(node, root): every node of ``edges`` (a, b) and one common node of its component.

    Each round joins every node to its smallest neighbour and rewrites the
    edges between the joined nodes, until no edge is left; None if there is
    no edge at all.  Rounds are written tables, so a lost executor repeats a
    round at most.
    """
    edges = materialize(edges.where("a <> b").distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least("a", F.min("b")).alias("r"))
        # One jump: a node's parent may itself join a smaller one.
        up = materialize(up.select(F.col("a").alias("node"), F.col("r").alias("root")), "parents")
        hop = up.select(F.col("node").alias("root"), F.col("root").alias("root2"))
        step = materialize(up.join(hop, "root").select("node", F.col("root2").alias("root")), "roots")
        if roots is None:
            roots = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("root2"))
            roots = materialize(roots.join(nxt, "root", "left")
                                .select("node", F.coalesce("root2", "root").alias("root")), "roots")
        ra = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        rb = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        edges = materialize(edges.join(ra, "a").join(rb, "b").where("ra <> rb")
                            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                            .distinct(), "links")
    return roots


def components(docs: DataFrame, width: int = SHINGLE_WORDS, radius: int = RADIUS, seed: int = SEED,
               tile_rows: int = TILE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """Near-duplicate groups of all ``docs``: one row per input row.

    Columns: doc_id, the ``keep`` columns, ``fp`` (64 bits, signed), ``root``
    (a fingerprint that names the group), and ``component_id``: the smallest doc_id whose document can be reached over
    links of at most ``radius`` differing bits, itself included (NULL ids
    are ignored; a group of only NULL ids has component_id NULL).  Rows
    repeated in the input are repeated in the output; an empty table gives
    an empty result; texts without words all have fingerprint 0 and so form
    one group.
    """
    kept = ["doc_id", *[c for c in keep or [] if c != "doc_id"]]
    sig = materialize(fingerprints(docs.select(*dict.fromkeys([*kept, "text"])), width, seed, kept), "simhash")
    reps = materialize(sig.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = contract(links(reps.select("fp"), radius, tile_rows))
    if roots is None:
        ids = reps.select("fp", F.col("fp").alias("root"), F.col("rep").alias("component_id"))
    else:
        named = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "rep", F.coalesce("root", "fp").alias("root"))
        low = named.groupBy("root").agg(F.min("rep").alias("component_id"))
        ids = named.join(low, "root").select("fp", "root", "component_id")
    return sig.join(ids, "fp").select(*kept, "fp", "root", "component_id")


def representatives(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest doc_id.

    Equal ids in one group: the row with the smallest content hash; wholly
    equal rows: one of them.  A group whose ids are all NULL keeps one row.
    All input columns are returned unchanged.  Only ids and row hashes take
    part in the choice; texts are shuffled once, by their row hash.
    """
    columns = docs.columns
    marked = row_marks(docs)
    groups = components(marked, keep=list(MARKS), **how)
    first = (groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", *MARKS)).alias("k"))
             .select(*[F.col(f"k.{m}").alias(m) for m in MARKS]))
    return distinct_rows(marked).join(first, list(MARKS)).select(*columns)
