"""Which moments of a key a minimal distance lets through, for keys of any size.

A moment is taken when at least one distance lies between it and the moment taken
before it, so the taken ones of a key form a chain. A moment with no other one within
a distance before it is taken whatever happened earlier; it starts a session, and a
chain never needs to look past its session.

Every moment links to the first one a distance later in its session. Links are then
doubled: a link leads out of its chunk of the session, and where it ends in the other
half of a chunk twice as wide, it is followed once more. A wider chunk is entered only
within a distance of its start, so the moments that still matter halve from round to
round, and the rounds are the logarithm of the longest session. On the way back each
round adds the moments that its links reach from those already taken. All of it is
joins on a key and a moment, which no hot key can pile up in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.operators.ordered import TIME_SHIFT, Running, running
from linewarden.session import settle

_PLACE = ["_key", "_start", "_at"]


def spaced(
    moments: DataFrame,
    keys: Sequence[str],
    order: str,
    distance: int,
    *,
    shift: int = TIME_SHIFT,
) -> DataFrame:
    """The taken moments as ``keys`` and ``order``; ``moments`` must be distinct.

    A key may be null or hold nulls. An empty table gives none.
    """
    if distance <= 0:
        raise ValueError("the distance must be positive")
    # A struct equals another one of the same nulls, so plain joins match null keys.
    spots = moments.select(F.struct(*keys).alias("_key"), F.col(order).alias("_at"))
    linked = settle(_links(spots, distance, shift), "links")
    taken = linked.filter(F.col("_at") == F.col("_start")).select(*_PLACE)
    longest = linked.agg(F.max(F.col("_at") - F.col("_start")).alias("us")).first().us
    # No link leaves a chunk that holds the longest session.
    rounds, width = [], distance
    links = linked.filter(F.col("_next").isNotNull())
    while longest is not None and width <= longest:
        if rounds:
            links = settle(_doubled(links, width), "links")
        width *= 2
        rounds.append((links, width))
    for links, width in reversed(rounds):
        taken = _reached(taken, links, width)
    return taken.select(*[F.col("_key")[k].alias(k) for k in keys], F.col("_at").alias(order))


def _links(spots: DataFrame, distance: int, shift: int) -> DataFrame:
    """Start of the session, and the moment to take next if this one is taken."""
    at = F.col("_at")
    gaps = running(spots, ["_key"], "_at", [Running("_prior", at, "max")], shift=shift)
    starts = F.col("_prior").isNull() | (at - F.col("_prior") >= distance)
    opened = gaps.select("_key", "_at", F.when(starts, at).alias("_opens"))
    earlier = Running("_opened", F.col("_opens"), "max")
    started = running(opened, ["_key"], "_at", [earlier], shift=shift).select(
        "_key", "_at", F.coalesce("_opens", "_opened").alias("_start")
    )
    # Read by both scans of the next order, twice each.
    spots = settle(started, "sessions")
    # Read backwards, a moment comes before the one that asks for its very place.
    rows = spots.select(
        "_key",
        "_start",
        F.inline(
            F.array(
                F.struct(at.alias("_spot"), at.alias("_place"), F.lit(1).alias("_rank")),
                F.struct(
                    at.alias("_spot"), (at + distance).alias("_place"), F.lit(0).alias("_rank")
                ),
            )
        ),
    )
    is_spot = F.col("_rank") == 1
    # Sessions follow one another, so the nearest moment ahead has the least start as well.
    ahead = [
        Running("_following", F.when(is_spot, F.col("_spot")), "min"),
        Running("_session", F.when(is_spot, F.col("_start")), "min"),
    ]
    found = running(rows, ["_key"], "_place", ahead, tie=["_rank"], reverse=True, shift=shift)
    same = F.col("_session") == F.col("_start")
    return found.filter(~is_spot).select(
        "_key",
        "_start",
        F.col("_spot").alias("_at"),
        F.when(same, F.col("_following")).alias("_next"),
    )


def _same_chunk(width: int) -> Column:
    """Whether a link stays in its chunk; chunks are counted from the session's start."""

    def chunk(place: Column) -> Column:
        return F.call_function("div", place - F.col("_start"), F.lit(width).cast("bigint"))

    return chunk(F.col("_at")) == chunk(F.col("_next"))


def _doubled(links: DataFrame, width: int) -> DataFrame:
    """Links out of chunks of ``width``, from the moments by which these are entered."""
    further = links.select(
        "_key", F.col("_at").alias("_next"), F.col("_next").alias("_further")
    )
    hop = F.when(_same_chunk(width), F.col("_further")).otherwise(F.col("_next"))
    hopped = links.join(further, ["_key", "_next"], "left").select(*_PLACE, hop.alias("_next"))
    sides = F.array(
        F.struct("_at", "_next", (F.col("_at") == F.col("_start")).alias("_entered")),
        F.struct(
            F.col("_next").alias("_at"),
            F.lit(None).cast("bigint").alias("_next"),
            F.lit(True).alias("_entered"),
        ),
    )
    return (
        hopped.filter(F.col("_next").isNotNull())
        .select("_key", "_start", F.inline(sides))
        .groupBy(*_PLACE)
        .agg(F.max("_next").alias("_next"), F.max("_entered").alias("_entered"))
        .filter(F.col("_entered") & F.col("_next").isNotNull())
        .drop("_entered")
    )


def _reached(taken: DataFrame, links: DataFrame, width: int) -> DataFrame:
    """The taken moments and those that one link reaches in the same chunk."""
    inside = links.filter(_same_chunk(width)).select("_key", "_at", "_next")
    places = F.filter(F.array("_at", "_next"), lambda place: place.isNotNull())
    return taken.join(inside, ["_key", "_at"], "left").select(
        "_key", "_start", F.explode(places).alias("_at")
    )
