"""Join helpers: broadcast only what is proven small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows and bytes above which a side is not broadcast.
BROADCAST_MAX_ROWS = 100_000
BROADCAST_MAX_BYTES = 64 << 20


def row_bytes(df: DataFrame):
    """About how many bytes a row takes: 8 a value, texts and binaries by their length, arrays by their elements."""
    size = None
    for c, t in df.dtypes:
        wide = F.octet_length(c) if t in ("string", "binary") else F.size(c) * 8 if t.startswith("array<") else F.lit(0)
        one = F.greatest(wide, F.lit(0)) + 8
        size = one if size is None else size + one
    return size


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                   max_bytes: int = BROADCAST_MAX_BYTES) -> tuple[bool, int]:
    """(whether ``df`` is small in rows and in bytes, its rows).  One job over a small derived side."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return n <= max_rows and size <= max_bytes, n


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, int]:
    """Broadcast ``df`` only if it is shown to be small in rows and bytes.

    Returns (frame, rows).  Measuring a small derived side costs one job; it
    is the size check that makes the broadcast safe at any data size.
    """
    small, n = fits_broadcast(df, max_rows)
    return (F.broadcast(df) if small else df), n
