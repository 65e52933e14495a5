"""Texts to vectors by an encoder of the user's.

``load`` makes the encoder; a Python worker calls it once and keeps what it
returns for all its tasks, so a model is read from disk once per worker.  The
encoder gets lists of exactly ``batch_size`` texts (the last one of a task may
be shorter), whatever the sizes of Arrow's batches, and returns a matrix of one
row per text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

BATCH_SIZE = 64
_ENCODERS: dict[str, Callable] = {}


def loaded(name: str, load: Callable) -> Callable:
    """The worker's encoder of that name, made at its first use.  (A function of the module: what Spark sends along of a
    function defined inside another is a copy for each task.)"""
    if name not in _ENCODERS:
        _ENCODERS[name] = load()
    return _ENCODERS[name]


def encode_texts(docs: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], dim: int, name: str,
                 text: str = "text", keep: list[str] | None = None, batch_size: int = BATCH_SIZE, out: str = "embedding") -> DataFrame:
    """``docs`` (its ``keep`` columns; default all) plus ``out``: array<float> of ``dim`` elements.

    ``name`` tells encoders apart in a worker: the same name is the same
    encoder.  A NULL text is encoded as the empty text.  An encoder that
    returns another shape, or a value that is no number, ends the job.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != out]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.FloatType()))])

    def encoded(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        texts = [t or "" for t in batch.column(text).to_pylist()]
        made = np.asarray(loaded(name, load)(texts), np.float32)
        if made.shape != (len(texts), dim) or not np.isfinite(made).all():
            raise ValueError(f"encoder {name}: {made.shape} for {len(texts)} texts of {dim} numbers, or not all numbers")
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim), pa.array(made.reshape(-1)))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], flat], names=[*keep, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                piece = b.slice(at, batch_size - n)
                held.append(piece)
                n, at = n + piece.num_rows, at + piece.num_rows
                if n == batch_size:
                    yield encoded(held)
                    held, n = [], 0
        if held:
            yield encoded(held)

    return docs.mapInArrow(run, schema)


class HashedWords:
    """An encoder without a model: each word adds 1 or -1 at a place of its own (both from its MD5); unit length."""

    def __init__(self, dim: int):
        self.dim, self.places = dim, {}

    def place(self, word: str) -> tuple[int, int]:
        if word not in self.places:
            if len(self.places) >= 100_000:
                self.places.clear()
            digest = hashlib.md5(word.encode()).hexdigest()
            self.places[word] = int(digest[:8], 16) % self.dim, 1 if int(digest[8], 16) % 2 == 0 else -1
        return self.places[word]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for word in re.findall(r"[0-9a-z\x80-\U0010FFFF]+", t.translate({c: c + 32 for c in range(65, 91)})):
                at, sign = self.place(word)
                out[i, at] += sign
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)
