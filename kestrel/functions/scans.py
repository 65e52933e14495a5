"""Ordered scans that stay balanced when one key holds a large share of rows.

Windows partitioned by a key alone put a hot key in one task.  The helpers
here split every ordered computation into cells whose size has a bound
that does not grow with the data:

* ``prefix_before``: exclusive running sum over a position column, in two
  levels (within a block of ``span`` positions, then over blocks), so each
  window partition holds at most ``span`` rows or one row per block.
* ``count_at_or_before``: for time points and lookups x, the number of
  rows of the same key at time <= x.  Rows are first collapsed to one point per
  distinct (key, microsecond) (a partial + final aggregate, so repeated
  timestamps combine map-side); lookups and points meet in cells of
  ``cell_us`` microseconds, which hold at most ``cell_us`` distinct
  timestamps plus the lookups that fall in them.
* ``ranks_in_order``: the same lookups over one range exchange: points and
  lookups sorted together by (key, time), running sums per partition, and a
  row per partition that carries a key's sum over the borders.
* ``previous_in_order``: each row's predecessor in a total order within a
  key, over range partitions of that order (a hot key is split across
  balanced partitions; partition boundaries carry the predecessor).

Each has one plan, whatever the size of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

US = 1_000_000
CELL_US = US                 # one second of distinct microsecond timestamps per cell
BLOCK_CELLS = 86_400         # cells per block of the two-level prefix (one day of seconds)


def join_on(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``cols`` where NULL matches NULL; the key columns appear once.

    The right side's keys are renamed first, so a frame may be joined with
    one derived from it (no ambiguous self-join references).
    """
    r = right
    for c in cols:
        r = r.withColumnRenamed(c, f"__r_{c}")
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__r_{c}" for c in cols])


def prefix_before(tot: DataFrame, keys: list[str], pos: str, val: str,
                  span: int = BLOCK_CELLS) -> DataFrame:
    """(keys, pos, _before): sum of ``val`` over rows of the key with a smaller ``pos``.

    ``tot`` has one row per (keys, pos).  Two levels: a window per
    (keys, block of ``span`` positions), plus the exclusive running total
    of earlier blocks from a one-row-per-block aggregate.
    """
    t = tot.select(*keys, pos, val, F.floor(F.col(pos) / span).alias("_blk"))
    w_in = (Window.partitionBy(*keys, "_blk").orderBy(pos)
            .rowsBetween(Window.unboundedPreceding, -1))
    t = t.withColumn("_in", F.coalesce(F.sum(val).over(w_in), F.lit(0)))
    blocks = t.groupBy(*keys, "_blk").agg(F.sum(val).alias("_bt"))
    w_b = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*keys, "_blk", F.coalesce(F.sum("_bt").over(w_b), F.lit(0)).alias("_bb"))
    j = join_on(t, blocks, [*keys, "_blk"])
    return j.select(*keys, pos, (F.col("_in") + F.col("_bb")).alias("_before"))


def count_at_or_before(points: DataFrame, lookups: DataFrame, keys: list[str],
                       cell_us: int = CELL_US) -> DataFrame:
    """Rank lookups over time points of each key.

    ``points``: (keys, _t, _c), one row per distinct (keys, _t) with its row
    count.  ``lookups``: (keys, _x, payload...), at most one per (keys, _x).
    Returns points and lookups together as (keys, _x, _c, _probe, payload...,
    _r): _probe 0 for a point (_x = its time), 1 for a lookup, and _r the
    number of rows of the key at time <= _x.  Exact: R(x) = rows in earlier
    cells (``prefix_before`` over per-cell totals) + rows in x's cell up to
    x (a running sum in which a point sorts before a lookup at equal time).
    """
    data = points.select(*keys, F.col("_t").alias("_x"), F.col("_c").cast("long").alias("_c"),
                         F.lit(0).alias("_probe"))
    look = lookups.withColumn("_c", F.lit(0).cast("long")).withColumn("_probe", F.lit(1))
    p = data.unionByName(look, allowMissingColumns=True).withColumn("_cell", F.floor(F.col("_x") / cell_us))
    w = (Window.partitionBy(*keys, "_cell").orderBy("_x", "_probe")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    p = p.withColumn("_cum", F.sum("_c").over(w))
    # Cells holding only lookups total 0; they are kept so every lookup's cell has a prefix.
    tot = p.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_tot"))
    before = prefix_before(tot, keys, "_cell", "_tot")
    j = join_on(p, before, [*keys, "_cell"])
    return j.select(*[c for c in p.columns if c not in ("_cell", "_cum")],
                    (F.col("_before") + F.col("_cum")).alias("_r"))


def previous_in_order(df: DataFrame, key: str, order: list[str], value: str, out: str) -> DataFrame:
    """``df`` with ``out`` = ``value`` of the previous row of the same ``key``
    in the total order ``order`` (NULL for a key's first row).

    Equal to ``lag(value) OVER (PARTITION BY key ORDER BY order)``; NULL keys
    are one key, NULLs in the order come first.  One plan at every size: rows
    are range-partitioned and sorted on (key, order), which spreads a hot key,
    hour or timestamp over balanced partitions, and shifted by one row in
    Arrow batches (no further exchange).  The result is written once to the
    shared checkpoint folder, so that rows and partition boundaries agree on
    the partition numbers (a recomputed range exchange would sample anew);
    the first row of a partition then takes the last row of the nearest
    earlier non-empty partition, if that has the same key.
    """
    from kestrel.session import materialize

    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = list(df.columns)
    schema = T.StructType([*df.schema, T.StructField(out, df.schema[value].dataType),
                           T.StructField("_p", T.IntegerType()), T.StructField("_first", T.BooleanType())])

    def shift(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            keys, values = b.column(key), b.column(value)
            before = [pa.concat_arrays([h if h is not None else pa.nulls(1, c.type), c[:-1]])
                      for h, c in zip(held or (None, None), (keys, values), strict=True)]
            same = pc.or_(pc.fill_null(pc.equal(before[0], keys), False),
                          pc.and_(pc.is_null(before[0]), pc.is_null(keys)))
            first = pa.array([held is None] + [False] * (b.num_rows - 1))
            same = pc.and_not(same, first)
            prev = pc.if_else(same, before[1], pa.nulls(b.num_rows, values.type))
            held = (keys[-1:], values[-1:])
            yield pa.RecordBatch.from_arrays(
                [*b.columns, prev, pa.array([part] * b.num_rows, pa.int32()), first], names=[*columns, out, "_p", "_first"])

    r = materialize(df.repartitionByRange(n, key, *order).sortWithinPartitions(key, *order).mapInArrow(shift, schema), "ranged")
    last = r.groupBy("_p").agg(F.max_by(F.struct(F.col(key).alias("_lk"), F.col(value).alias("_lv")),
                                        F.struct(F.col(key), *order)).alias("_last"))
    carry = last.select("_p", F.lag("_last").over(Window.orderBy("_p")).alias("_prev"))     # a row per partition
    r = r.join(F.broadcast(carry), "_p", "left")
    same = F.col("_prev").isNotNull() & F.col("_prev._lk").eqNullSafe(F.col(key))
    return r.select(*columns, F.when(F.col("_first") & same, F.col("_prev._lv")).otherwise(F.col(out)).alias(out))


def key_codes(batch, keys: list[str]):
    """A number per row that changes where the keys do (NULL is a key of its own)."""
    import numpy as np

    out = np.zeros(batch.num_rows, np.int64)
    for c in keys:
        codes = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy()
        out[1:] += (codes[1:] != codes[:-1])
    return np.cumsum(out > 0)


def ranks_in_order(points: DataFrame, lookups: DataFrame, keys: list[str]) -> DataFrame:
    """``count_at_or_before`` over one range exchange: (keys, _x, _c, _probe, _o, _r).

    ``points``: (keys, _t, _c), one row per distinct (keys, _t); ``lookups``:
    (keys, _x, _o).  A row's rank is its running sum in its partition, plus,
    for the partition's first key, what earlier partitions hold of that key.
    The sorted rows are written once, so that they and the partitions' borders
    agree; a hot key, cell or window is as many partitions as it needs.
    """
    from kestrel.session import materialize

    data = points.select(*keys, F.col("_t").alias("_x"), F.col("_c").cast("long").alias("_c"), F.lit(0).alias("_probe"),
                         F.lit(None).cast("long").alias("_o"))
    data = data.unionByName(lookups.select(*keys, "_x", F.lit(0).cast("long").alias("_c"), F.lit(1).alias("_probe"), "_o"))
    order = [*keys, "_x", "_probe"]
    schema = T.StructType([*data.schema, T.StructField("_sum", T.LongType()), T.StructField("_edge", T.BooleanType()),
                           T.StructField("_part", T.IntegerType())])

    def running(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, key, held, edge = TaskContext.get().partitionId(), None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            run = key_codes(b, keys)
            first = tuple(b.column(c)[0].as_py() for c in keys)
            if key is not None and first != key:
                held, edge = 0, False
            c = b.column("_c").to_numpy()
            total = np.cumsum(c)
            starts = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            before = (total - c)[starts]
            out = total - before[run] + np.where(run == 0, held, 0)
            key = tuple(b.column(c)[-1].as_py() for c in keys)
            held = int(out[-1])
            edges = (run == 0) & edge
            edge = bool(edges[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out), pa.array(edges), pa.array(np.full(b.num_rows, part, np.int32))],
                                             names=[*b.schema.names, "_sum", "_edge", "_part"])

    # As many ranges as shuffles have, neighbouring small ones put together by AQE.
    ranged = data.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(running, schema)
    ranged = materialize(ranged, "ranks")
    key = F.struct(*keys)
    place = F.struct(*order)
    ends = ranged.groupBy("_part").agg(F.min_by(key, place).alias("_first"), F.max_by(F.struct(key.alias("k"), "_sum"), place).alias("_last"))
    ends = materialize(ends, "range-ends")                      # a row per partition
    # What a partition's first key has before it: the sums of earlier partitions that end in that key.
    events = (ends.select("_part", F.col("_first").alias("_k"), F.lit(0).alias("_e"), F.lit(0).cast("long").alias("_s"))
              .unionByName(ends.select("_part", F.col("_last.k").alias("_k"), F.lit(1).alias("_e"), F.col("_last._sum").alias("_s"))))
    w = Window.partitionBy("_k").orderBy("_part", "_e").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = events.withColumn("_carry", F.sum("_s").over(w)).where("_e = 0 and _carry > 0").select("_part", "_carry")
    out = ranged.join(F.broadcast(carry), "_part", "left")      # a row per partition at most
    rank = F.col("_sum") + F.when(F.col("_edge"), F.coalesce("_carry", F.lit(0))).otherwise(F.lit(0))
    return out.select(*keys, "_x", "_c", "_probe", "_o", rank.alias("_r"))
