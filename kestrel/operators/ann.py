"""Neighbour search through an inverted file with residual codes.

Fitting takes a bounded sample: unit vectors are clustered by direction into
lists, and what is left of each after its list's centre is coded in one byte a
dimension.  The index holds every row, by list: its code, how far the coded
vector is from its own (``err``), and the vector.

A search reads the lists whose centres are nearest to the query, ranks by the
codes and compares the exact vectors of those alone that can be among the n
nearest: a row's similarity is within ``err`` of what its code says, and a
list's rows are no nearer than its centre and radius allow.  So the answer is
that of the exact search.  ``probes`` limits the lists to the nearest ones
instead, which is approximate.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.blocks import BLOCK_BYTES, block_product, first_of_equals, matrix
from kestrel.functions.exprs import cosine_similarity
from kestrel.session import materialize, scratch_path

SAMPLE_ROWS = 20_000     # rows that lists and codes are fitted on, at most twice as many
MAX_LISTS = 4096
LEVELS = 255             # of a coded dimension
FIRST_SHARE = 0.1        # of the lists are read first, for a bound on the others
SLACK = 1e-9             # more than the rounding of any sum here


class Model(NamedTuple):
    centres: np.ndarray      # lists x dim, unit vectors
    low: np.ndarray          # of the residuals, by dimension
    step: np.ndarray


class Index(NamedTuple):
    """The fitted model, the written table (fkey, list, id, code, err, same, vec), the lists' radii, and whether queries
    look only at rows of their filter value."""
    model: Model
    table: DataFrame
    radius: np.ndarray
    filtered: bool


def defined(vec, dim: int):
    """Whether a vector has ``dim`` elements, none of them NULL."""
    return vec.isNotNull() & (F.size(vec) == dim) & (F.size(F.array_compact(vec)) == dim)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows as unit vectors, which of them have a direction)."""
    norm = np.sqrt((v * v).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return v / np.where(good, norm, 1)[:, None], good


def fit(corpus: DataFrame, vec: str, id_col: str, dim: int, lists: int | None = None,
        sample_rows: int = SAMPLE_ROWS, rounds: int = 12, seed: int = 7) -> Model:
    """Lists and codes from a sample of at most ``2 * sample_rows`` rows, by a hash of the id; ``lists`` defaults to the
    square root of the rows, at most ``MAX_LISTS``."""
    rows = corpus.where(defined(F.col(vec), dim))
    total = rows.count()
    share = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample_rows / max(1, total)))
    taken = rows.where(share).select(id_col, vec).limit(2 * sample_rows).toArrow().sort_by(id_col)
    x, good = unit(matrix(taken.column(vec), dim))
    x = x[good]
    lists = max(1, min(lists or int(np.sqrt(total)), MAX_LISTS, len(x)))
    if not len(x):
        return Model(np.eye(1, dim), np.zeros(dim), np.ones(dim))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        sums[empty] = x[rng.choice(len(x), len(empty))]
        centres, good = unit(sums)
        centres[~good] = x[rng.choice(len(x), int((~good).sum()))]
    rest = x - centres[(x @ centres.T).argmax(1)]
    low, high = rest.min(0), rest.max(0)
    return Model(centres, low, np.maximum(high - low, 1e-12) / LEVELS)


def build(corpus: DataFrame, filter_col: str | None = "label", vec: str = "embedding", id_col: str = "vec_id",
          dim: int | None = None, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, path: str | None = None) -> Index:
    """The index of ``corpus``, written below ``path`` (default: a scratch table), a folder per list.

    Rows whose vector has another length than ``dim`` (default: the longest),
    a NULL in it or no direction have no similarity to anything and are not in
    it, nor are those whose ``filter_col`` is NULL.
    """
    spark = corpus.sparkSession
    dim = dim or corpus.agg(F.max(F.size(vec))).first()[0] or 1
    model = fit(corpus, vec, id_col, max(1, dim), lists, sample_rows)
    fkey = F.col(filter_col).cast("string") if filter_col else F.lit("")
    rows = corpus.select(fkey.alias("fkey"), F.col(id_col).alias("id"), F.col(vec).alias("vec"),
                         F.xxhash64(vec).alias("same")).where(F.col("fkey").isNotNull() & defined(F.col("vec"), dim))
    kind = corpus.schema[vec].dataType.simpleString()

    def assign(batches):
        for b in batches:
            x, good = unit(matrix(b.column("vec"), dim))
            x, b = x[good], b.filter(pa.array(good))
            own = (x @ model.centres.T).argmax(1)
            base = model.centres[own] + model.low
            code = np.clip(np.rint((x - base) / model.step), 0, LEVELS)
            err = np.sqrt(((x - base - code * model.step) ** 2).sum(1))
            far = np.sqrt(((x - model.centres[own]) ** 2).sum(1))
            codes = code.astype(np.uint8)
            new = [pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(far)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "list", "code", "err", "far"])

    schema = f"fkey string, id long, vec {kind}, same long, list int, code binary, err double, far double"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or scratch_path(spark, "ivf")
    # By ranges of list and a hash of the id: a list's files are few, and a hot list is several tasks'.
    coded = rows.mapInArrow(assign, schema).repartitionByRange(n, "list", F.xxhash64("id"))
    coded.write.partitionBy("list").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    radius = np.zeros(len(model.centres))
    for r in table.groupBy("list").agg(F.max("far").alias("far")).collect():      # at most MAX_LISTS rows
        radius[r["list"]] = r["far"]
    return Index(model, table.select("fkey", "list", "id", "code", "err", "same", "vec"), radius, bool(filter_col))


def _by_codes(model: Model, n: int, exclude_self: bool):
    """(hold, meet) of a part of a list: the rows that may be among the ``n`` nearest, by their codes."""
    dim = model.centres.shape[1]

    def hold(t: pa.Table):
        codes = np.frombuffer(b"".join(t.column("code").to_pylist()), np.uint8).reshape(-1, dim)
        order = np.argsort(t.column("id").to_numpy())
        return [codes[order].astype(np.float64), *(t.column(c).to_numpy()[order] for c in ("id", "err", "same")), t.column("list")[0].as_py()]

    def meet(state, b: pa.RecordBatch):
        codes, ids, err, same, which = state
        step = max(1, (BLOCK_BYTES // 8) // max(1, len(ids)))
        for at in range(0, b.num_rows, step):
            piece = b.slice(at, step)
            q, floor = matrix(piece.column("q"), dim), piece.column("floor").to_numpy()
            names = piece.column("query_id").to_numpy()
            est = (q @ (model.centres[which] + model.low))[:, None] + (q * model.step) @ codes.T
            lower = est - err
            if exclude_self:
                lo, hi = np.searchsorted(ids, names, "left"), np.searchsorted(ids, names, "right")
                for i in np.flatnonzero(hi > lo):
                    est[i, lo[i]:hi[i]] = lower[i, lo[i]:hi[i]] = -np.inf
            if len(ids) >= n:
                floor = np.maximum(floor, np.partition(lower, len(ids) - n, axis=1)[:, len(ids) - n])
            qi, ri = np.nonzero((est + err >= floor[:, None] - SLACK) & np.isfinite(est))
            keep = first_of_equals(qi, same[ri], ids[ri], n)       # of equal vectors, the smallest ids come first
            qi, ri = qi[keep], ri[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[qi]), pa.array(np.full(len(qi), which, np.int32)), pa.array(ids[ri]),
                 pa.array(lower[qi, ri]), pa.array(est[qi, ri] + err[ri])], names=["query_id", "list", "id", "lower", "upper"])
    return hold, meet


_FOUND = "query_id long, list int, id long, lower double, upper double"


def _floors(found: DataFrame, n: int) -> DataFrame:
    """(query_id, floor): the n-th largest lower bound among what was found; queries with fewer rows are not in it."""
    w = Window.partitionBy("query_id").orderBy(F.col("lower").desc(), "list", "id")
    return (found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == n)
            .select("query_id", F.col("lower").alias("floor")))


def search(index: Index, queries: DataFrame, n: int = 5, exclude_self: bool = True, probes: int | None = None,
           first_share: float = FIRST_SHARE) -> tuple[DataFrame, DataFrame]:
    """(neighbours, compared pairs) of ``queries`` (query_id, query_vec, query_filter).

    Neighbours as ``knn`` gives them: query_id, rank, vec_id, similarity.  The
    second frame (query_id, list, id) has the pairs whose vectors were
    compared.  Queries without a direction find nothing.
    """
    model, radius, dim = index.model, index.radius, index.model.centres.shape[1]
    lists = len(model.centres)
    first = probes or max(1, int(np.ceil(first_share * lists)))
    fkey = F.col("query_filter").cast("string") if index.filtered else F.lit("")
    asked = queries.select("query_id", fkey.alias("fkey"), "query_vec").where(
        F.col("fkey").isNotNull() & defined(F.col("query_vec"), dim))
    asked = materialize(asked, "ivf-queries")

    def near(later: bool):
        """Each query with its first lists, or with the later ones that can hold something above its floor."""
        def run(batches):
            for b in batches:
                q, good = unit(matrix(b.column("query_vec"), dim))
                q, b = q[good], b.filter(pa.array(good))
                dots = q @ model.centres.T
                order = np.argsort(-dots, axis=1, kind="stable")
                floor = b.column("floor").to_numpy(zero_copy_only=False)
                for i in range(len(q)):
                    own = order[i, first:] if later else order[i, :first]
                    if later:
                        own = own[dots[i, own] + radius[own] >= floor[i] - SLACK]
                    if len(own):
                        k = len(own)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([b.column("fkey")[i].as_py()] * k), pa.array([b.column("query_id")[i].as_py()] * k),
                             pa.array(own.astype(np.int32)), pa.array([q[i]] * k, pa.list_(pa.float64())), pa.array([floor[i]] * k)],
                            names=["fkey", "query_id", "to_list", "q", "floor"])
        return run

    grp = lambda c: F.concat(F.col(c).cast("string"), F.lit(":"), F.col("fkey"))        # noqa: E731
    probe_schema = "fkey string, query_id long, to_list int, q array<double>, floor double"
    block_rows = max(1, BLOCK_BYTES // (8 * dim))

    def visit(floors: DataFrame, later: bool) -> DataFrame:
        to = materialize(floors.mapInArrow(near(later), probe_schema), "probes")
        # Only the probed lists' folders are read; a row per list is sent to the scan.
        reached = F.broadcast(to.select(F.col("to_list").alias("list")).distinct())
        rows = index.table.join(reached, "list").select(grp("list").alias("grp"), "id", "list", "code", "err", "same")
        asks = to.select(grp("to_list").alias("grp"), "query_id", "q", "floor")
        found = block_product(rows, asks, lambda: _by_codes(model, n, exclude_self), _FOUND, block_rows)
        return materialize(found, "ivf-found")

    found = visit(asked.withColumn("floor", F.lit(float("-inf"))), False)
    if probes is None and first < lists:
        floors = asked.join(_floors(found, n), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = found.unionByName(visit(floors, True))
    best = _floors(found, n).withColumnRenamed("floor", "best")
    pairs = found.join(best, "query_id", "left").where(F.col("best").isNull() | (F.col("upper") >= F.col("best") - SLACK))
    pairs = materialize(pairs.select("query_id", "list", "id").distinct(), "ivf-pairs")
    exact = pairs.join(index.table.select("list", "id", "vec", "fkey"), ["list", "id"]).join(
        asked.select("query_id", "fkey", "query_vec"), ["query_id", "fkey"])
    exact = exact.select("query_id", F.col("id").alias("vec_id"), cosine_similarity(F.col("vec"), F.col("query_vec")).alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "vec_id")
    out = exact.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank"), pairs


def knn_ivf(corpus: DataFrame, queries: DataFrame, n: int = 5, filter_col: str | None = "label", exclude_self: bool = True,
            vec: str = "embedding", id_col: str = "vec_id", lists: int | None = None, probes: int | None = None) -> DataFrame:
    """The n nearest rows of every query, through an index built for it; exact unless ``probes`` is given."""
    return search(build(corpus, filter_col, vec, id_col, lists=lists), queries, n, exclude_self, probes)[0]
