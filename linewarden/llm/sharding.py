"""Shards of near equal bytes by histogram sort.

Rows have a key: the hash of the text, then the hash of the id, then a number among equal
rows, so equal texts lie side by side. Probes are laid over the key space, the exact bytes
below each probe are counted over all partitions, and the interval round each wanted
boundary is probed again until the bytes below a probe are within the tolerance of the wanted
share. A boundary that falls inside equal rows is a count of them, as they are of one
size. Then all rows are exchanged once, and slots follow the key.

Defined results: a null text has no bytes and size 1, and sorts as a text of its own;
a null id is allowed; equal rows fill shards like others, and which of them is where makes no
difference; an empty table gives no rows. Columns named like an added one are replaced,
other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linewarden.llm.common import running_start, stored, text_or_empty, without

SHARDS = 16
#: Of a shard's share; a splitter that meets it is not refined any more.
TOLERANCE = 1e-4
#: Probes inside each open interval and round.
PROBES = 1024
LOW, HIGH = -(2**63), 2**63
ADDED = ("size", "law", "shard", "slot")
#: Slots are given out by ranges of the key, of so many lower bits.
RANGE_BITS = 48
#: Rows of one text beyond this number get their slots by ranges of the second key, of so many
#: lower bits, and equal rows among them are counted off and get theirs in runs.
HEAVY = 1 << 10
TIE_BITS = 52
RUN_BITS = 16


def keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty(F.col("text"))
    return docs.withColumns(
        {
            "size": F.octet_length(text).cast("long") + 1,
            "__key": F.xxhash64("text"),
            "__tie": F.xxhash64("doc_id"),
        }
    )


def _refine(rows: DataFrame, key: str, wanted: dict[int, float], slack: float, below: int) -> dict:
    """Splitters on one key column: {i: (probe, bytes below it, exact or not)}.

    Keeps an open interval (lo, bytes below lo, hi) for each wanted boundary and probes
    them all in one pass over the rows. ``below`` counts bytes before all rows.
    """
    open_ = {i: (LOW, below, HIGH) for i in wanted}
    done: dict[int, tuple[int, int, bool]] = {}
    while open_:
        spans = sorted({(lo, b, hi) for lo, b, hi in open_.values()})
        step = {s: max(1, -(-(s[2] - s[0]) // PROBES)) for s in spans}
        part: Column = F.lit(None)
        for n, s in enumerate(spans):
            lo, _, hi = s
            inside = (F.col(key) >= F.lit(lo)) & (F.col(key) <= F.lit(hi - 1))
            # Both halves stay inside a long.
            half = F.col(key).cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")
            cell = F.floor(half / F.lit(step[s]).cast("decimal(20,0)")).cast("int")
            part = F.when(inside, F.struct(F.lit(n).alias("n"), cell.alias("cell"))).otherwise(part)
        counts = (
            rows.select(part.alias("at"), "size")
            .where("at IS NOT NULL")
            .groupBy("at")
            .agg(F.sum("size").alias("bytes"))
            .collect()
        )
        got: dict[int, dict[int, int]] = {}
        for r in counts:
            got.setdefault(r["at"]["n"], {})[r["at"]["cell"]] = r["bytes"]
        for i, (lo, b, hi) in list(open_.items()):
            n = spans.index((lo, b, hi))
            w, at, cells = step[spans[n]], b, got.get(n, {})
            best = (lo, b)
            last = (lo, b, hi)
            for c in sorted(cells):
                after = at + cells[c]
                if after >= wanted[i]:
                    last = (lo + c * w, at, min(hi, lo + (c + 1) * w))
                    best = min(
                        ((lo + c * w, at), (min(hi, lo + (c + 1) * w), after)),
                        key=lambda x: abs(x[1] - wanted[i]),
                    )
                    break
                at = after
                best = (min(hi, lo + (c + 1) * w), at)
                last = (best[0], at, hi)
            if abs(best[1] - wanted[i]) <= slack:
                done[i] = (*best, True)
                del open_[i]
            elif last[2] - last[0] <= 1:
                done[i] = (last[0], last[1], False)
                del open_[i]
            else:
                open_[i] = last
    return done


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE):
    """Boundaries (key, tie, nth): a row is beyond one if its (key, tie, nth) is not smaller.

    A boundary that falls inside rows of one key is refined among these rows by the
    second key, and inside rows equal in both by their number. Sizes on the driver: a
    count for each probe.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    wanted = {i: total * i / shards for i in range(1, shards)}
    if not total:
        return [(HIGH - 1, HIGH - 1, 0)] * (shards - 1)
    cuts: dict[int, tuple[int, int, int]] = {}
    first = _refine(rows, "__key", wanted, slack, 0)
    within: dict[int, list[int]] = {}
    for i, (key, _, exact) in first.items():
        cuts[i] = (key, LOW, 0)
        if not exact:
            within.setdefault(key, []).append(i)
    for key, some in within.items():
        below = first[some[0]][1]
        found = _refine(
            rows.where(F.col("__key") == F.lit(key)),
            "__tie",
            {i: wanted[i] for i in some},
            slack,
            below,
        )
        for i, (tie, under, exact) in found.items():
            nth = 0
            if not exact:
                equal = rows.where((F.col("__key") == F.lit(key)) & (F.col("__tie") == F.lit(tie)))
                each = equal.agg(F.max("size")).first()[0]
                nth = round((wanted[i] - under) / each) if each else 0
            cuts[i] = (key, tie, nth)
    return [cuts[i] for i in range(1, shards)]


def _beyond(cut: tuple[int, int, int]) -> Column:
    key, tie, nth = cut
    if key >= HIGH:
        return F.lit(False)
    more = F.col("__key") > F.lit(key)
    if tie >= HIGH:
        return more
    same = F.col("__key") == F.lit(key)
    inside = same & (F.col("__tie") == F.lit(tie)) & (F.col("__nth") >= F.lit(nth))
    return more | (same & (F.col("__tie") > F.lit(tie))) | inside


def counted(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Adds ``__nth``, the number of a row among its equals, for texts in ``heavy``, else 0.

    Rows are counted off within the tasks that read them, so equals meet in no task.
    """
    marked = rows.withColumn("__row", F.monotonically_increasing_id())
    marked = marked.withColumn("__part", F.shiftright("__row", 33))
    many = heavy.select("__key", F.lit(True).alias("__many"))
    marked = marked.join(many, "__key", "left")
    few = marked.where("__many IS NULL").withColumn("__nth", F.lit(0).cast("long"))
    # Written, as the number of a task must be the same for the rows and for their counts.
    many_rows = stored(marked.where("__many"), "heavy-rows")
    off = running_start(many_rows, ["__key", "__tie"], "__part", ["__row"], F.lit(1), "__nth")
    return few.unionByName(off).drop("__row", "__part")


def shard_by_bytes(
    docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE
) -> DataFrame:
    """All rows with size, law, shard and slot (0, 1, ... within the shard, in order of the key)."""
    rows = keyed(without(docs, *ADDED))
    keys = stored(rows.select("__key", "__tie", "size"), "keys")
    cuts = splitters(keys, shards, tolerance)
    groups = keys.groupBy("__key").agg(F.count("*").alias("n"))
    inside = F.lit(False)
    for key, _, nth in cuts:
        if nth:
            inside = inside | (F.col("__key") == F.lit(key))
    heavy = stored(groups.where((F.col("n") > HEAVY) | inside), "heavy")
    rows = counted(rows, heavy)
    shard = sum((_beyond(c).cast("int") for c in cuts), F.lit(0))
    # In the order of this bucket: a range of keys without its heavy ones, then these in parts.
    bucket = F.struct(
        F.shiftright("__key", RANGE_BITS).alias("range"),
        F.when(F.col("__many"), F.col("__key")).alias("key"),
        F.when(F.col("__many"), F.shiftright("__tie", TIE_BITS)).alias("tie"),
        F.shiftright("__nth", RUN_BITS).alias("run"),
    )
    placed = rows.withColumn("shard", shard).withColumn("__bucket", bucket)
    order = ["__key", "__tie", "__nth"]
    return (
        running_start(placed, ["shard"], "__bucket", order, F.lit(1), "slot")
        .withColumn("law", F.lit("bytes"))
        .drop("__key", "__tie", "__nth", "__many", "__bucket")
    )
