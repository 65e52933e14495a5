"""Shared helpers of the text operators.

Conventions that every operator of this subpackage follows:

* A NULL text is the empty text; a NULL id is a value like any other (NULLs
  match NULLs, and sort after every id where an order is needed).
* Only the columns an operator names are read.  An operator that hands its
  input columns on replaces an input column whose name equals one of its
  result columns.
* Text work runs in Arrow batches: one pass over the batches of a task,
  memory bounded by a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
         "boolean": pa.bool_(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()),
         "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()),
         "array<double>": pa.list_(pa.float64())}


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 (NULL: empty)."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch (NULL: empty)."""
    return [t or "" for t in batch.column(name).to_pylist()]


ROWS_AT_ONCE = 1024     # texts that are held as Python objects at a time


def slices(batches: Iterator[pa.RecordBatch], rows: int | None = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows (no copies)."""
    for b in batches:
        step = rows or max(1, b.num_rows)
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def add_columns(df: DataFrame, added: dict[str, str], make: Callable[[], Callable],
                keep: list[str] | None = None, rows: int | None = ROWS_AT_ONCE) -> DataFrame:
    """``df`` (its ``keep`` columns; default all) plus columns computed per Arrow batch.

    ``make`` runs once per task and returns a function from a batch to the
    lists or arrays of the added columns, in the order of ``added`` (name to
    SQL type).  Batches are handled ``rows`` rows at a time (None: whole).
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    schema = T.StructType([df.schema[c] for c in keep]
                          + [T.StructField(c, T._parse_datatype_string(t)) for c, t in added.items()])
    kinds = [ARROW[t] for t in added.values()]
    names = [*keep, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = make()
        for b in slices(batches, rows):
            new = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(columns(b), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + new, names=names)

    return df.mapInArrow(run, schema)


def smallest_hashes(rows: DataFrame, limit: int, *order) -> DataFrame:
    """The ``limit`` first rows by ``order``, which begins with a 64-bit hash of distinct values.

    Rows whose hash can't be among them are left out beforehand, by a threshold
    from the count: else each partition would send ``limit`` rows to one task.
    """
    share = (1.5 * limit + 1000) / max(1, rows.count())
    if share < 0.5:
        few = rows.where(order[0] < -(1 << 63) + int(share * (1 << 64)))
        if few.count() >= limit:
            rows = few
    return rows.orderBy(*order).limit(limit)


MARKS = ("__m1", "__m2")


def row_marks(df: DataFrame) -> DataFrame:
    """``df`` plus two 64-bit hashes of the whole row (``MARKS``), equal for equal rows only, for joins by row.

    Maps can't be hashed; they count as their JSON, entries in their order.
    """
    def hashed(c, t):
        return F.to_json(F.struct(c), {"ignoreNullFields": "false"}) if "map<" in t else F.col(c)
    parts = [x for c, t in df.dtypes for x in (hashed(c, t), F.col(c).isNull())]
    return df.select("*", *[F.xxhash64(F.lit(m), *parts).alias(m) for m in MARKS])


def distinct_rows(marked: DataFrame) -> DataFrame:
    """One row for each pair of marks, dealt out by the marks; equal rows meet on the map side first."""
    return marked.dropDuplicates(list(MARKS))
