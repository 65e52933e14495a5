"""Products of two large sets: blocks of one held in memory, the other streamed past them.

Rows of a corpus and queries meet where their group is the same.  A group's
rows are dealt out to parts of at most ``block_rows`` rows by a hash of their
id, so a hot group is many parts; its queries are sent to every part (and,
where there are many, dealt out to query groups, for each of which the parts
are there once more).  One exchange brings both together, sorted so that a
part's rows come before its queries: a task holds one part and one Arrow batch
of queries, whatever the number of queries.  Each side is read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.session import materialize

BLOCK_BYTES = 32 << 20        # of a held part, as doubles
QUERY_GROUP = 1 << 16         # queries that meet one copy of a part


def block_product(corpus: DataFrame, queries: DataFrame, make: Callable, schema: str, block_rows: int,
                  query_group: int = QUERY_GROUP) -> DataFrame:
    """What ``make`` says of each part and the queries of its group.

    ``corpus``: (grp, id, ...) and ``queries``: (grp, query_id, ...) with no
    other name in common; a NULL group meets nothing.  ``make()`` runs once per
    task and returns (hold, meet): ``hold`` turns a part's rows (one Arrow
    table) into a state, ``meet`` a state and a batch of queries into record
    batches of ``schema``.
    """
    corpus, queries = corpus.where(F.col("grp").isNotNull()), queries.where(F.col("grp").isNotNull())
    parts = corpus.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("_parts"))
    parts = materialize(parts, "block-parts")                                    # a row per group
    copies = max(1, -(-queries.count() // query_group))
    rows = corpus.join(parts, "grp").withColumn("_part", F.pmod(F.xxhash64("id"), "_parts")).drop("_parts")
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    asks = queries.join(parts, "grp").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    asks = asks.drop("_parts").withColumn("_copy", F.pmod(F.xxhash64("query_id"), F.lit(copies)).cast("int"))
    keys = ["grp", "_part", "_copy"]
    both = rows.withColumn("_side", F.lit(0)).unionByName(
        asks.withColumn("_part", F.col("_part").cast("long")).withColumn("_side", F.lit(1)), allowMissingColumns=True)
    own, other = [c for c in rows.columns if c not in keys], [c for c in asks.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold, meet = make()
        key, held, state = None, [], None
        for b in batches:
            for piece in _runs(b, [*keys, "_side"]):
                at = tuple(piece.column(c)[0].as_py() for c in keys)
                if at != key:
                    key, held, state = at, [], None
                if piece.column("_side")[0].as_py() == 0:
                    held.append(piece.select(own))
                elif held or state is not None:
                    if state is None:
                        state, held = hold(pa.Table.from_batches(held)), []
                    yield from meet(state, piece.select(other))

    n = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return both.repartition(n, *keys).sortWithinPartitions(*keys, "_side").mapInArrow(run, schema)


def _runs(b: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch, cut where one of the columns changes."""
    if not b.num_rows:
        return
    change = np.zeros(b.num_rows, bool)
    for c in columns:
        v = b.column(c).dictionary_encode().indices.to_numpy()
        change[1:] |= v[1:] != v[:-1]
    cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield b.slice(i, j - i)


def matrix(column, dim: int) -> np.ndarray:
    """A column of arrays of ``dim`` numbers as a matrix of doubles."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    parts = [c.flatten().to_numpy(zero_copy_only=False).astype(np.float64) for c in chunks]
    return np.concatenate([np.zeros(0), *parts]).reshape(-1, dim)


def row_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products row by row, summed from the first element to the last: the same double that Spark's ``aggregate``
    gives, wherever the row stands in a matrix."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def first_of_equals(query: np.ndarray, equal: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Which pairs are among the ``n`` smallest ids of their query and value ``equal``."""
    order = np.lexsort((ids, equal, query))
    q, e = query[order], equal[order]
    new = np.ones(len(order), bool)
    new[1:] = (q[1:] != q[:-1]) | (e[1:] != e[:-1])
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    keep = np.zeros(len(order), bool)
    keep[order[place < n]] = True
    return keep
