"""Running values and as-of lookups over long ordered keys.

A window function over one key puts the whole key into one task. Here a key
may hold a third of all rows, so its order is cut into blocks of
``order >> shift``: every block is aggregated on its own, the block totals (one
row per block) are scanned, and each block then starts from a carried row. A
task sees one block of one key and no more. Where ``order`` is unique, as an
arrival number is, a block cannot exceed ``2 ** shift`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 2^20 arrival numbers. 2^24 microseconds, about 17 seconds: no more than 17
# million distinct instants per block, and 1.9 million blocks per key and year.
SEQ_SHIFT = 20
TIME_SHIFT = 24

_BLOCK = "_block"
_IS_ROW = "_is_row"


@dataclass(frozen=True)
class Running:
    """A value over all earlier rows of the key, without the row itself.

    ``how`` is ``last`` (the nearest value that is not null), ``min``, ``max``
    or ``sum``. Wrap a value in a struct to let a null replace an older value.
    """

    name: str
    value: Column
    how: str = "last"


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    wanted: Sequence[Running],
    *,
    tie: Sequence[str] = (),
    reverse: bool = False,
    shift: int = SEQ_SHIFT,
) -> DataFrame:
    """Add the ``wanted`` columns; ``reverse`` looks at later rows instead."""
    keys, tie = list(keys), list(tie)
    inputs = {f"_in_{w.name}": w.value for w in wanted}
    rows = df.withColumns({**inputs, _BLOCK: F.shiftright(F.col(order), shift)})

    # A plain number keeps the totals in a hash aggregate.
    place = F.struct(order, *tie) if tie else F.col(order)
    totals = []
    for w in wanted:
        value = F.col(f"_in_{w.name}")
        totals.append(_block_total(value, w.how, place, reverse).alias(f"_in_{w.name}"))
    blocks = rows.groupBy(*keys, _BLOCK).agg(*totals)

    def before(partition: list[str], by: list[str]) -> Window:
        columns = [F.desc(c) if reverse else F.asc(c) for c in by]
        return (
            Window.partitionBy(*partition)
            .orderBy(*columns)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    earlier_blocks = before(keys, [_BLOCK])
    carried = blocks.select(
        *keys,
        _BLOCK,
        *[
            _fold(w.how)(F.col(f"_in_{w.name}")).over(earlier_blocks).alias(f"_in_{w.name}")
            for w in wanted
        ],
        F.lit(False).alias(_IS_ROW),
    )
    # The carried row sorts first in its block in either direction.
    joined = rows.withColumn(_IS_ROW, F.lit(True)).unionByName(
        carried, allowMissingColumns=True
    )
    direction = F.desc if reverse else F.asc
    earlier_rows = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(F.asc(_IS_ROW), *[direction(c) for c in [order, *tie]])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    for w in wanted:
        joined = joined.withColumn(
            w.name, _fold(w.how)(F.col(f"_in_{w.name}")).over(earlier_rows)
        )
    return joined.filter(_IS_ROW).drop(_IS_ROW, _BLOCK, *inputs)


def _fold(how: str):
    if how == "last":
        return lambda value: F.last(value, ignorenulls=True)
    return {"min": F.min, "max": F.max, "sum": F.sum}[how]


def as_of(
    probes: DataFrame,
    events: DataFrame,
    order: str,
    values: Sequence[str],
    *,
    how: str = "last",
    reverse: bool = False,
    shift: int = SEQ_SHIFT,
) -> DataFrame:
    """Add to each probe the ``values`` of the nearest event strictly before it.

    With ``reverse`` it is the nearest event strictly after. ``how`` may also
    ask for the ``min`` or ``max`` over all those events. There is no range
    join: all events are reduced to one row per block, and only the blocks that
    hold a probe are looked at row by row.
    """
    probes = probes.withColumn(_BLOCK, F.shiftright(F.col(order), shift))
    events = events.select(order, *values).withColumn(
        _BLOCK, F.shiftright(F.col(order), shift)
    )
    asked = probes.select(_BLOCK).distinct()
    totals = events.groupBy(_BLOCK).agg(
        *[_block_total(F.col(v), how, F.col(order), reverse).alias(v) for v in values]
    )
    none = [F.lit(None).cast(events.schema[v].dataType).alias(v) for v in values]
    rank, kind = F.col("_rank"), "_kind"

    def nearest(partition: list[str], by: Sequence[str]) -> Window:
        return (
            Window.partitionBy(*partition)
            .orderBy(*[F.desc(c) if reverse else F.asc(c) for c in by], rank)
            .rowsBetween(Window.unboundedPreceding, -1)
        )

    # A probe's block sorts before the total of that same block.
    blocks = totals.withColumn("_rank", F.lit(1)).unionByName(
        asked.select(_BLOCK, *none, F.lit(0).alias("_rank"))
    )
    over_blocks = nearest([], [_BLOCK])
    carried = blocks.select(
        _BLOCK,
        "_rank",
        *[_fold(how)(F.col(v)).over(over_blocks).alias(v) for v in values],
    ).filter(rank == 0)

    near = events.join(asked, _BLOCK, "left_semi")
    if how != "last":
        # Copies of one place collapse before a task sees the whole block.
        near = near.groupBy(_BLOCK, order).agg(*[_fold(how)(F.col(v)).alias(v) for v in values])

    # Within a block: the carried row, then probes before events of one place.
    rows = (
        probes.drop(*values)
        .withColumns({kind: F.lit("probe"), "_rank": F.lit(0)})
        .unionByName(
            near.withColumns({kind: F.lit("event"), "_rank": F.lit(1)}),
            allowMissingColumns=True,
        )
        .unionByName(
            carried.withColumns({kind: F.lit("carried"), "_rank": F.lit(0)}),
            allowMissingColumns=True,
        )
        .withColumn("_first", F.when(F.col(kind) == "carried", 0).otherwise(1))
    )
    direction = F.desc if reverse else F.asc
    in_block = (
        Window.partitionBy(_BLOCK)
        .orderBy(F.asc("_first"), direction(order), rank)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = rows.select(
        *probes.drop(*values, _BLOCK).columns,
        kind,
        *[_fold(how)(F.col(v)).over(in_block).alias(v) for v in values],
    )
    return found.filter(F.col(kind) == "probe").drop(kind)


def _block_total(value: Column, how: str, place: Column, reverse: bool) -> Column:
    if how != "last":
        return _fold(how)(value)
    seen = F.when(value.isNotNull(), place)
    return F.min_by(value, seen) if reverse else F.max_by(value, seen)
