"""Mix sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the golden-ratio point ``frac(i * phi)``. Mapped through
the cumulative numbers of slots that the sources need, it names a source, so every stretch of
the schedule holds the sources in proportion. Slots are ranked within their source, and
the r-th slot takes the r-th block of the source: its documents in a shuffled order, cut
into blocks of equally many words. Blocks have one size for all sources but those whose target
is less than ``LEAST_SLOTS`` of them: these have smaller blocks, so that rounding to
slots loses none of a small source. After its last block a source starts again, twice at most.

Defined results: a null text has no words; a null source is a source of its own, the
last one; a document without words is never taken; repeated rows are documents of
their own; an empty table gives an empty schedule. Extra columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm.common import prefix_sums, running_start, stored, without, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
GOLDEN = 0.6180339887498949
#: About so many slots, unless that made blocks outside these sizes.
SLOTS, BLOCK_MIN, BLOCK_MAX = 1 << 20, 16, 1024
#: Slots of a source at least, where its target has so many words.
LEAST_SLOTS = 64
#: Cells of the unit interval by which slots find their source.
CELLS = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash and a shuffling key of every document."""
    size = F.size(words(F.col("text"))).cast("long")
    return docs.select(
        "doc_id",
        "source",
        size.alias("size"),
        F.xxhash64("text").alias("text_hash"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("shuffle"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """source_no, source, source_size, weight, target: one row per source.

    Resharing the excess of capped sources by weight ends where every other
    source has ``level * weight``; ``level`` is found from sources in the order in
    which they reach their cap.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ratio_order = Window.orderBy("ratio", "source_no")
    before = ratio_order.rowsBetween(Window.unboundedPreceding, -1)
    onward = ratio_order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.get(weights, F.col("source_no") % len(WEIGHTS)))
    s = s.withColumn("cap", F.col("source_size") * PASSES)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    s = s.withColumn("share", F.sum("source_size").over(everything) * F.lit(SHARE))
    s = s.withColumn("spent", F.coalesce(F.sum("cap").over(before), F.lit(0)))
    s = s.withColumn("level", (F.col("share") - F.col("spent")) / F.sum("weight").over(onward))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level")))
    s = s.withColumn("level", first.over(everything)["level"])
    free = F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), free))
    return s.select("source_no", "source", "source_size", "weight", "target")


def block_words(total_target: float) -> int:
    return int(min(BLOCK_MAX, max(BLOCK_MIN, total_target // SLOTS)))


def with_blocks(sources: DataFrame, block: int) -> DataFrame:
    """Adds the size of a source's blocks, and how many of them its target has."""
    own = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("target") / LEAST_SLOTS)))
    sources = sources.withColumn("block_words", own.cast("long"))
    return sources.withColumn("n_slots", F.col("target") / F.col("block_words"))


def slots(sources: DataFrame) -> DataFrame:
    """slot, source_no and the rank of the slot within its source."""
    spark = sources.sparkSession
    n = math.ceil(sources.agg(F.sum("n_slots")).first()[0] or 0)
    by_no = Window.orderBy("source_no")
    cum = F.sum("n_slots").over(by_no) / F.sum("n_slots").over(Window.partitionBy())
    ranges = sources.where("target > 0").select("source_no", cum.alias("upper"))
    ranges = ranges.withColumn("lower", F.coalesce(F.lag("upper").over(by_no), F.lit(0.0)))
    # The last bound is 1 whatever the rounding.
    last = F.lead("upper").over(by_no).isNull()
    ranges = ranges.withColumn("upper", F.when(last, F.lit(2.0)).otherwise(F.col("upper")))
    cells = F.sequence(
        F.floor(F.col("lower") * CELLS), F.least(F.floor(F.col("upper") * CELLS), F.lit(CELLS - 1))
    )
    ranges = ranges.withColumn("cell", F.explode(cells))
    shift = max(12, n.bit_length() - 16)
    x = F.col("slot") * F.lit(GOLDEN)
    points = (
        spark.range(n)
        .withColumnRenamed("id", "slot")
        .withColumn("u", x - F.floor(x))
        .withColumn("cell", F.floor(F.col("u") * CELLS))
        .withColumn("chunk", F.shiftright("slot", shift))
    )
    found = (
        points.join(ranges, "cell")
        .where("u >= lower AND u < upper")
        .select("slot", "chunk", "source_no")
    )
    totals = found.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    totals = prefix_sums(totals, ["source_no"], "chunk", "n", "before").drop("n")
    own = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    return (
        found.withColumn("own", own)
        .join(totals, ["source_no", "chunk"])
        .select("slot", "source_no", (F.col("own") + F.col("before")).alias("block"))
    )


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Every document with the place of its first word in the shuffled source."""
    numbered = sizes.join(
        sources.withColumnRenamed("source", "__name"), F.col("source").eqNullSafe(F.col("__name"))
    ).drop("__name")
    numbered = numbered.withColumn("bucket", F.substring("shuffle", 1, 3))
    order = ["shuffle", "doc_id", "text_hash"]
    return running_start(numbered, ["source_no"], "bucket", order, F.col("size"), "place").drop(
        "bucket", "shuffle"
    )


def schedule(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mix and the documents it was taken from.

    ``mix``: slot, source_no, place, pass, first_word, n_words; a row for every
    run of words of one document in one slot. ``documents``: doc_id, text_hash,
    source, source_no, source_size, target, size, place. A document with words is known
    by (source_no, place).
    """
    sizes = stored(sized(without(docs)), "sized")
    targets = stored(source_targets(sizes).coalesce(1), "targets")
    total = targets.agg(F.sum("target")).first()[0] or 0.0
    sources = stored(with_blocks(targets, block_words(total)).coalesce(1), "sources")
    documents = stored(placed(sizes, sources), "placed")
    begin = F.col("place") + F.col("pass") * F.col("source_size")
    runs = (
        documents.where("size > 0")
        .withColumn("pass", F.explode(F.array(*[F.lit(p) for p in range(PASSES)])))
        .withColumn("begin", begin)
        .withColumn("end", F.col("begin") + F.col("size"))
        .withColumn(
            "block",
            F.explode(F.expr("sequence(begin div block_words, (end - 1) div block_words)")),
        )
        .withColumn("from", F.greatest(F.col("begin"), F.col("block") * F.col("block_words")))
        .withColumn("to", F.least(F.col("end"), (F.col("block") + 1) * F.col("block_words")))
        .select(
            "source_no",
            "block",
            "place",
            "pass",
            (F.col("from") - F.col("begin")).alias("first_word"),
            (F.col("to") - F.col("from")).alias("n_words"),
        )
    )
    # Runs are many more than the documents by whose size the planner would judge them.
    taken = slots(sources)
    mix = runs.hint("merge").join(taken, ["source_no", "block"]).drop("block")
    return mix, documents


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    mix, documents = schedule(docs)
    taken = mix.groupBy("source_no", "place").agg(F.sum("n_words").alias("taken"))
    return (
        documents.withColumn("known", F.when(F.col("size") > 0, F.col("place")))
        .join(
            taken.withColumnRenamed("place", "known"),
            ["source_no", "known"],
            "left",
        )
        .select(
            "doc_id",
            "size",
            "source",
            "source_size",
            "target",
            F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Whole documents, each as often as the schedule reaches its first word."""
    mix, documents = schedule(docs)
    copies = mix.where("first_word = 0").groupBy("source_no", "place").agg(F.count("*").alias("n"))
    same = Window.partitionBy("doc_id", "text_hash", "source").orderBy("place")
    chosen = (
        documents.where("size > 0")
        .withColumn("ordinal", F.row_number().over(same))
        .join(copies, ["source_no", "place"])
        .select(
            F.col("doc_id").alias("__doc_id"),
            F.col("text_hash").alias("__text_hash"),
            F.col("source").alias("__source"),
            F.col("ordinal").alias("__ordinal"),
            F.col("n").alias("__n"),
        )
    )
    again = Window.partitionBy("doc_id", "__hash", "source").orderBy("__hash")
    rows = docs.withColumn("__hash", F.xxhash64("text"))
    rows = rows.withColumn("__nth", F.row_number().over(again))
    joined = rows.join(
        chosen,
        F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & (F.col("__hash") == F.col("__text_hash"))
        & F.col("source").eqNullSafe(F.col("__source"))
        & (F.col("__nth") == F.col("__ordinal")),
    )
    joined = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int"))))
    return joined.select(*[joined[f"`{c}`"] for c in docs.columns])
