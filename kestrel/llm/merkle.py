"""A Merkle manifest of a dataset: a tree per group of rows, a tree over the groups, proofs, and rows checked against them.

Leaves of a group (``by``, e.g. a language) stand in ascending order of their
id; every 8 consecutive nodes (the last run may be shorter, even one) hash to
one until one is left, the group's subroot; subroots, in the order of their
groups, hash to the root in the same way.

The tree is worked through in superblocks of 8^3 consecutive nodes.

* Upwards: the leaves' superblocks, then those of the nodes these leave, and so
  on, each reduced by itself, three levels a round, until one node is left.
* Downwards: the nodes of a superblock and what is needed of the tree outside
  it (the siblings on its own node's way to the root) are cogrouped by
  superblock.  One call reduces the superblock again, joins each node's
  siblings in it to the outer ones, and hands these proofs to the superblocks
  below; at the leaves, each row's leaf as it is found now is folded along its
  proof and compared with the root.

Texts are hashed by Spark where they are read and never shuffled; a task holds
one superblock.  Places in a group come from ranges of (group, id), counted per
range.  Equal rows are told apart by where they were read, so that they spread
over ranges (they are equal leaves: which of them comes first changes nothing).

NULL groups come first, NULL ids last; NULL values hash as ``-``; rows with one
id are ordered by their leaves; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.session import materialize

FAN = 8
LEVELS = 3                      # of a superblock
BLOCK = FAN ** LEVELS           # its nodes
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def value(column: Column) -> Column:
    """A value as it is hashed: ``-`` for NULL, else its UTF-8 byte count, a colon, and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    """Hex SHA-256 over the values."""
    return F.sha2(F.concat(*map(value, columns)).cast("binary"), 256)


def lower_az(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the ``levels`` levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i:i + FAN])) for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def proof_of(tree: list[list[str]], i: int) -> list[str]:
    """Node i's siblings, level by level; a dot marks its own place among them."""
    out = []
    for nodes in tree[:-1]:
        first = i - i % FAN
        out.append("".join(nodes[first:i]) + "." + "".join(nodes[i + 1:first + FAN]))
        i //= FAN
    return out


def fold(node: str, proof: str) -> str:
    """The root that a node and its proof give."""
    for level in proof.split("/") if proof else ():
        node = digest(level.replace(".", node))
    return node


def places(rows: DataFrame, keys: list[Column], group: str) -> DataFrame:
    """``rows`` (written, so that reading them twice is cheap) plus ``at``: the place of each in its group, from 0.

    Ranges of ``keys``, which begin with the group, are dealt out and sorted; a
    range's rows are numbered as they are written, and what a group has in
    earlier ranges is added.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*keys, F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    dealt = dealt.drop("_tie").withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    dealt = materialize(dealt, "places")
    ranges = dealt.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)     # a row per range
    shift = F.coalesce(F.sum("_n").over(w), F.lit(0)) - F.col("_first")
    ranges = materialize(ranges.select(group, "_part", shift.alias("_shift")), "ranges")
    return dealt.join(ranges, [group, "_part"]).withColumn("at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")


def with_heights(nodes: DataFrame) -> DataFrame:
    """``nodes`` plus ``height`` (levels above them until their group has one node) and ``block`` (their superblock)."""
    n = nodes.groupBy("grp").agg(F.max("at").alias("_last"))
    height = F.lit(0)
    for i in range(21):                                   # whole-number comparisons: 8^21 is beyond any count
        height = height + (F.col("_last") >= FAN ** i).cast("int")
    return nodes.join(n, "grp").withColumn("height", height).drop("_last").withColumn("block", F.expr(f"at div {BLOCK}"))


NODES = "grp string, at bigint, node string, height int, block bigint"


def _reduce(nodes: pd.DataFrame) -> pd.DataFrame:
    """The one node that a superblock leaves, as a node of the superblocks above."""
    nodes = nodes.sort_values("at")
    height, block = int(nodes["height"].iloc[0]), int(nodes["block"].iloc[0])
    take = min(LEVELS, height)
    top = reduced(nodes["node"].tolist(), take)[-1][0]
    return pd.DataFrame({"grp": [nodes["grp"].iloc[0]], "at": [block], "node": [top], "height": [height - take],
                         "block": [block // BLOCK]})


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each round (NODES): ``nodes``, what their superblocks leave, ..., one node per group."""
    rounds = [nodes]
    height = nodes.agg(F.max("height")).first()[0] or 0
    for _ in range(0, height, LEVELS):
        up = rounds[-1].groupBy("grp", "block").applyInPandas(_reduce, NODES)
        rounds.append(materialize(up, "nodes"))
    return rounds


OUTER = "o_grp string, o_block bigint, subroot string, root string, outer string"


def _proofs(nodes: pd.DataFrame) -> list[list[str]]:
    """The siblings of each node of a superblock (sorted by place), level by level."""
    tree = reduced(nodes["node"].tolist(), min(LEVELS, int(nodes["height"].iloc[0])))
    return [proof_of(tree, i) for i in range(len(nodes))]


def _hand_down(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The proofs of a superblock's nodes, for the superblocks below."""
    nodes = nodes.sort_values("at")
    tail = [outer["outer"].iloc[0]] if outer["outer"].iloc[0] else []
    return pd.DataFrame({"o_grp": nodes["grp"], "o_block": nodes["at"], "subroot": outer["subroot"].iloc[0],
                         "root": outer["root"].iloc[0], "outer": ["/".join(p + tail) for p in _proofs(nodes)]})


def descend(rounds: list[DataFrame], outer: DataFrame) -> DataFrame:
    """The outer proofs (OUTER) of the first round's superblocks, from those of the last round's nodes."""
    for nodes in reversed(rounds[1:]):
        below = nodes.groupBy("grp", "block").cogroup(outer.groupBy("o_grp", "o_block")).applyInPandas(_hand_down, OUTER)
        outer = materialize(below, "outer-nodes")
    return outer


def manifest(docs: DataFrame, found: dict[str, Column] | None = None, by: str = "lang", order: str = "doc_id",
             fields: tuple[str, ...] = FIELDS, with_proofs: bool = False) -> DataFrame:
    """The manifest of ``docs``, a row each: ``order``, leaf, subroot (of its group ``by``), root, proof_sha256, folded_root, verified.

    ``found`` gives the fields that the rows are found with now (default: as
    they are); folded_root is what the leaf over these and the row's proof give, and
    verified whether that is the root.  proof_sha256 is the digest of all
    siblings, level by level, left to right; ``with_proofs`` adds ``proof``
    itself: levels joined by ``/``, a dot where the row's own node stands.
    """
    recorded, now = [F.col(c) for c in fields], [(found or {}).get(c, F.col(c)) for c in fields]
    same = F.lit(True)
    for a, b in zip(recorded, now, strict=True):
        same = same & a.eqNullSafe(b)
    grp = F.coalesce(F.concat(F.lit("="), F.col(by).cast("string")), F.lit(""))        # NULL first, never NULL
    rows = docs.select(F.col(order).alias("_id"), grp.alias("grp"), leaf(recorded).alias("node"),
                       F.when(~same, leaf(now)).alias("now"))
    rows = materialize(rows, "leaves")
    leaves = places(rows, [F.col("grp"), F.col("_id").asc_nulls_last(), F.col("node")], "grp")
    leaves = materialize(with_heights(leaves), "placed-leaves")
    rounds = climb(leaves.select("grp", "at", "node", "height", "block"))

    # The tree over the groups: its leaves are the subroots.
    subroots = materialize(rounds[-1].select(F.col("grp").alias("name"), "node"), "subroots")
    tops = places(subroots.withColumn("grp", F.lit("")), [F.col("grp"), F.col("name")], "grp")
    tops = materialize(with_heights(tops), "placed-subroots")
    top_rounds = climb(tops.select("grp", "at", "node", "height", "block"))
    last = top_rounds[-1].select("node").first()
    root = last[0] if last else None
    start = top_rounds[-1].select(F.col("grp").alias("o_grp"), F.col("at").alias("o_block"), F.lit("").alias("subroot"),
                                  F.lit(root).cast("string").alias("root"), F.lit("").alias("outer"))
    own = tops.select("grp", "at", "node", "height", "block").groupBy("grp", "block").cogroup(
        descend(top_rounds, start).groupBy("o_grp", "o_block")).applyInPandas(_hand_down, OUTER)
    outer = tops.select(F.col("name").alias("o_grp"), F.col("node").alias("subroot"), "at").join(
        own.select(F.col("o_block").alias("at"), "root", "outer"), "at")
    outer = outer.select("o_grp", F.lit(0).cast("bigint").alias("o_block"), "subroot", "root", "outer")
    outer = descend(rounds, materialize(outer, "outer-nodes"))

    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("at")
        tail = [outer["outer"].iloc[0]] if outer["outer"].iloc[0] else []
        proofs = ["/".join(p + tail) for p in _proofs(nodes)]
        root = outer["root"].iloc[0]
        now = nodes["now"].where(nodes["now"].notna(), nodes["node"])
        folded = [fold(n, p) for n, p in zip(now, proofs, strict=True)]
        out = pd.DataFrame({"_id": nodes["_id"], "leaf": nodes["node"], "subroot": outer["subroot"].iloc[0], "root": root,
                            "proof_sha256": [digest(p.replace(".", "").replace("/", "")) for p in proofs],
                            "folded_root": folded, "verified": [f == root for f in folded]})
        if with_proofs:
            out["proof"] = proofs
        return out

    kind = docs.schema[order].dataType.simpleString()
    schema = (f"_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
              + (", proof string" if with_proofs else ""))
    out = leaves.groupBy("grp", "block").cogroup(outer.groupBy("o_grp", "o_block")).applyInPandas(finish, schema)
    return out.withColumnRenamed("_id", order)
