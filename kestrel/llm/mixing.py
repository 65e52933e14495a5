"""Mixing sources to target weights with a low-discrepancy source schedule.

The mix is a sequence of slots of ``block_words`` words each:

* Targets.  Sources in code-point order weigh 1, 2, 3, 1, 2, 3, ... and share
  the total by weight; a target stops at ``MAX_COPIES`` times its source's
  size and the excess goes to the others by weight.  The level at which this
  settles is found in closed form from running sums over the sources, sorted
  by where they stop.
* Schedule.  Source s needs ceil(target / block) slots, N in all.  The van der
  Corput points of base 2 (bit reversal), read as integers below N, visit every
  integer once; cumulative slot counts map point v, step rev(v), to its source, so each
  source gets its exact number of slots, spread evenly over the sequence.
* Blocks.  A source's documents, shuffled by hash, form one cyclic stream of
  words; the r-th slot of a source takes block r of it: words
  [r * block, (r + 1) * block), cut off where the target is reached.

Everything is DataFrame operations.  No window holds a whole source: positions
in a source are sums over hash buckets and groups of buckets plus a window in
one bucket; slot ranks are counts per chunk of the sequence plus a window in a
chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.scans import join_on, prefix_before
from kestrel.llm.common import MARKS, distinct_rows, row_marks
from kestrel.session import materialize

MAX_COPIES = 3
BLOCK_WORDS = 65_536      # words of a slot in the production schedule
BUCKET_DIGITS = 5          # hex digits of the shuffle hash that make a bucket (2^20 per source)
BUCKET_GROUP = 1024        # buckets whose running sum is one window
CHUNK_SLOTS = 1024         # slots ranked in one window
_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text (NULL: 0).

    Each word with the blanks around it shrinks to one character; a text of
    blanks only has no word.
    """
    blank = F.trim(F.translate(text, "\t\n\x0b\f\r", "     ")) == ""
    return F.when(text.isNull() | blank, 0).otherwise(F.length(F.regexp_replace(text, _WORD, "x"))).cast("long")


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, weight, target) from one row per source (source, source_size).

    With the sources sorted by cap / weight, the first k stop at their caps
    and the others share the rest at one level (words per weight); k is the
    smallest number for which no other source would pass its cap.
    """
    one = Window.partitionBy(F.lit(1))        # one row per source
    s = sizes.withColumn("weight", (F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    s = s.withColumn("cap", F.col("source_size") * max_copies)
    # cap_a / w_a < cap_b / w_b in whole numbers: weights are 1, 2 or 3, so cap * 6 / w is exact.
    w = one.orderBy(F.expr("cap * 6 div weight"), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("rest_weight", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("total", F.sum("source_size").over(one)))
    level = (F.col("total") - F.col("capped")).cast("double") / F.col("rest_weight")
    s = s.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    # The first source that needn't stop sets the level; it holds for all after it, those before are at their caps.
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.select("source", "source_size", "weight", F.coalesce(
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.col("cap").cast("double")).alias("target"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """The sequence of slots: (step, source, rank, first_word, last_word).

    ``rank`` counts a source's slots from 0 in the order of ``step``; a slot
    takes words [first_word, last_word) of its source's cyclic stream.  Steps
    have gaps (points at or above N are skipped), their order is the mix.
    """
    t = targets.withColumn("quota", F.round("target").cast("long"))
    t = t.withColumn("slots", F.ceil(F.col("quota") / F.lit(block_words)).cast("long"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    t = t.withColumn("hi", F.sum("slots").over(order)).withColumn("lo", F.col("hi") - F.col("slots"))
    t = materialize(t.select("source", "quota", "lo", "hi"), "quotas")       # one row per source
    n = t.agg(F.max("hi")).first()[0] or 0
    bits = max(1, (max(1, n) - 1).bit_length())
    # Bit reversal is its own inverse: a source's points [lo, hi) name their steps directly.  The ranges are cut
    # into pieces first, so that a large source's slots are made by many tasks.
    piece = F.explode(F.sequence(F.expr(f"lo div {CHUNK_SLOTS}"), F.expr(f"(hi - 1) div {CHUNK_SLOTS}")))
    pieces = t.where("hi > lo").withColumn("piece", piece).repartition("source", "piece")
    point = F.sequence(F.greatest("lo", F.col("piece") * CHUNK_SLOTS),
                       F.least("hi", (F.col("piece") + 1) * CHUNK_SLOTS) - 1)
    step = F.conv(F.reverse(F.lpad(F.bin("v"), bits, "0")), 2, 10).cast("long")
    slots = pieces.withColumn("v", F.explode(point)).select(step.alias("step"), "source", "quota")
    slots = slots.withColumn("chunk", F.floor(F.col("step") / CHUNK_SLOTS))
    slots = materialize(slots, "slots")
    counts = slots.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    slots = join_on(slots, prefix_before(counts, ["source"], "chunk", "n"), ["source", "chunk"])
    w = Window.partitionBy("source", "chunk").orderBy("step")
    rank = F.col("_before") + F.row_number().over(w) - 1
    return (slots.withColumn("rank", rank)
            .select("step", "source", "rank", (F.col("rank") * block_words).alias("first_word"),
                    F.least((F.col("rank") + 1) * block_words, F.col("quota")).alias("last_word")))


def shuffled(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, size, ...) plus ``begin``: the document's place in its source's shuffled stream.

    Order: md5 of the doc_id (as text; NULL as ''), then doc_id, then size;
    wholly equal rows may swap places, which changes no result.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    d = docs.withColumn("_key", key)
    d = d.withColumn("_b", F.conv(F.substring("_key", 1, BUCKET_DIGITS), 16, 10).cast("long"))
    w = (Window.partitionBy("source", "_b").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size")
         .rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(w), F.lit(0)))
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("_s"))
    d = join_on(d, prefix_before(sums, ["source"], "_b", "_s", BUCKET_GROUP), ["source", "_b"])
    return d.withColumn("begin", F.col("_before") + F.col("_in")).drop("_key", "_b", "_in", "_before")


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, max_copies: int = MAX_COPIES,
        keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix of all ``docs`` (doc_id, text, source): (documents, schedule).

    ``documents`` has one row per input row: doc_id, source, the ``keep``
    columns, size, source_size, target (of its source), begin, taken (words
    that the slots' blocks hold of it, repeats counted; at most ``max_copies`` times its
    size).  ``schedule`` is described at that function; its slots add up to
    each source's target, to the nearest word.  NULL sources are one source,
    sorted last; texts without words are never taken; no rows give no slots.
    """
    d, slots, pieces = _mixed(docs, block_words, max_copies, keep)
    taken = pieces.groupBy("source", "begin").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    # Documents with words begin at different places of their source's stream.
    full = join_on(d.where("size > 0"), taken, ["source", "begin"], "left")
    columns = [c for c in d.columns if c != "begin"]
    out = full.select(*columns, "begin", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out.unionByName(d.where("size = 0").withColumn("taken", F.lit(0).cast("long"))), slots


def _mixed(docs: DataFrame, block_words: int, max_copies: int, keep: list[str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents in their sources' streams, schedule, pieces: the documents' parts slot by slot), each written."""
    extra = [c for c in keep or [] if c not in ("doc_id", "source")]
    sized = materialize(docs.select("doc_id", "source", *extra, word_count(F.col("text")).alias("size")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, max_copies), "targets")
    slots = materialize(schedule(targets, block_words), "schedule")
    d = join_on(shuffled(sized), targets.select("source", "source_size", "target"), ["source"])
    d = materialize(d.select("doc_id", "source", *extra, "size", "source_size", "target", "begin"), "streams")
    return d, slots, materialize(block_documents(d, slots), "pieces")


def block_documents(documents: DataFrame, slots: DataFrame) -> DataFrame:
    """The mix itself: (step, source, rank, lap, doc_id, begin, from_word, to_word), slot by slot.

    ``begin`` is the document's place in its source's stream, ``lap`` the pass over the stream.
    Slots and documents of a source meet in cells of its stream a block wide,
    pass by pass; a slot or document is listed in each cell it touches, so
    rows grow with slots and documents, not with their product.
    """
    block = slots.agg(F.max(F.col("last_word") - F.col("first_word"))).first()[0] or 1
    size = documents.select("source", "source_size").distinct()
    s = join_on(slots, size, ["source"])
    # A slot crosses the end of the stream at most once more than there are passes in it.
    laps = F.sequence(F.floor(F.col("first_word") / F.col("source_size")),
                      F.floor((F.col("last_word") - 1) / F.col("source_size")))
    s = s.select("*", F.explode(laps).alias("lap"))
    base = F.col("lap") * F.col("source_size")
    s = s.select("step", "source", "rank", (F.greatest(F.col("first_word"), base) - base).alias("x"),
                 (F.least(F.col("last_word"), base + F.col("source_size")) - base).alias("y"), "lap")

    def cells(df, lo, hi):
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block))))
    d = cells(documents.where("size > 0").withColumn("end", F.col("begin") + F.col("size")), "begin", "end")
    j = join_on(cells(s, "x", "y"), d.select("source", "cell", "doc_id", "begin", "end"), ["source", "cell"])
    lo, hi = F.greatest("x", "begin"), F.least("y", "end")
    # An overlap that touches several cells is listed in the first of them only.
    first = F.floor(lo / block) == F.col("cell")
    return j.where((lo < hi) & first).select("step", "source", "rank", "lap", "doc_id", "begin",
                                             (lo - F.col("begin")).alias("from_word"), (hi - F.col("begin")).alias("to_word"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to and including its n-th word."""
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++)"), 1)
    return F.concat_ws("", F.slice(words, F.lit(1), n.cast("int")))


def resample(docs: DataFrame, block_words: int = BLOCK_WORDS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` as the mix takes them, in its own columns: a row per pass over a document.

    A document whose words are all taken k times is there k times; the last
    pass may end inside a document, whose text is then cut after the words
    taken (n_chars follows).  Documents that the mix takes nothing of are
    left out; order is not part of the result (``schedule`` has it).  Wholly
    equal rows are taken together.
    """
    columns = docs.columns
    marked = row_marks(docs)
    d, _, pieces = _mixed(marked, block_words, max_copies, list(MARKS))
    passes = pieces.groupBy("source", "begin", "lap").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("words"))
    passes = join_on(passes, d.where("size > 0").select("source", "begin", "size", *MARKS), ["source", "begin"])
    # Equal rows lie side by side in the stream, so that the last pass ends inside one of them at most.
    cut = F.when(F.col("words") < F.col("size"), F.col("words"))
    plan = passes.groupBy(*MARKS).agg(F.count_if(F.col("words") == F.col("size")).cast("int").alias("__whole"),
                                      F.coalesce(F.max(cut), F.lit(0)).cast("int").alias("__cut"))
    j = distinct_rows(marked).join(plan, list(MARKS))
    cuts = F.when(F.col("__cut") > 0, F.array("__cut")).otherwise(F.array().cast("array<int>"))
    j = j.withColumn("__cut", F.explode(F.concat(F.array_repeat(F.lit(0), F.col("__whole")), cuts)))
    cut = F.when(F.col("__cut") > 0, first_words(F.col("text"), F.col("__cut")))
    out = {"text": F.coalesce(cut, F.col("text"))}
    if "n_chars" in columns:
        out["n_chars"] = (F.when(F.col("__cut") > 0, F.length(cut)).otherwise(F.col("n_chars"))
                          .cast(docs.schema["n_chars"].dataType))
    return j.select(*[out[c].alias(c) if c in out else F.col(c) for c in columns])
