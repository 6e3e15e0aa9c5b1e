"""Tumbling event-time windows with lateness, where late rows are kept.

Spark's own watermark moves per micro-batch and drops late rows. Here lateness
is decided per arrival and a late row goes to the oldest window still open. All
of it follows from two small tables, each one row per window:

* ``firsts``: the first arrival number of every window;
* ``closers``: the first arrival number that allows windows up to an index to
  close.

Both merge by ``min``, so the same code serves a whole table and a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.clocks import (
    aligned_origin,
    closable_index,
    lag_ms,
    micros,
    window_index,
)
from linewarden.operators.ordered import SEQ_SHIFT, Running, as_of, running
from linewarden.schema import StreamConfig
from linewarden.session import settle

WINDOW_SHIFT = 16


def first_event_us(readings: DataFrame) -> DataFrame:
    """One row: the event time of the first arrival."""
    return readings.agg(F.min_by(micros(F.col("event_time")), "seq").alias("first_us"))


def origin_of(readings: DataFrame, width_us: int) -> Column:
    """The aligned origin as a scalar subquery."""
    first = first_event_us(readings)
    return first.select(aligned_origin(F.col("first_us"), width_us).alias("origin_us")).scalar()


def find_origin(readings: DataFrame, width_us: int) -> Column:
    """The aligned origin as a literal, for jobs that use it more than once."""
    first = first_event_us(readings)
    found = first.select(aligned_origin(F.col("first_us"), width_us).alias("o")).first()
    return F.lit(found.o).cast("bigint")


def place(readings: DataFrame, config: StreamConfig, origin_us: Column | None = None) -> DataFrame:
    """Add both clocks in microseconds, the lag and the two window indexes."""
    origin = origin_of(readings, config.width_us) if origin_us is None else origin_us
    clocks = readings.withColumns(
        {"event_us": micros(F.col("event_time")), "ingest_us": micros(F.col("ingest_time"))}
    )
    event = F.col("event_us")
    return clocks.withColumns(
        {
            "lag_ms": lag_ms(event, F.col("ingest_us")),
            "window_index": window_index(event, origin, config.width_us),
            "closable": closable_index(event, origin, config.width_us, config.lateness_us),
        }
    )


def marks(placed: DataFrame) -> DataFrame:
    """``firsts`` and ``closers`` in one pass, one row per index."""
    sides = F.array(
        F.struct(
            F.col("window_index"),
            F.col("seq").alias("first_seq"),
            F.lit(None).cast("bigint").alias("closer_seq"),
        ),
        F.struct(
            F.col("closable").alias("window_index"),
            F.lit(None).cast("bigint").alias("first_seq"),
            F.col("seq").alias("closer_seq"),
        ),
    )
    return merge_marks(placed.select(F.inline(sides)))


def merge_marks(parts: DataFrame) -> DataFrame:
    return parts.groupBy("window_index").agg(
        F.min("first_seq").alias("first_seq"), F.min("closer_seq").alias("closer_seq")
    )


def registry(marked: DataFrame) -> DataFrame:
    """When each window opens and closes, in arrival numbers.

    ``close_seq`` is null for a window that no arrival closes. A reading of the
    window is late once a window at or above it has closed, from
    ``closed_by`` on. A window whose first reading is already late never opens.
    """
    later = running(
        marked,
        [],
        "window_index",
        [Running("_later", F.col("closer_seq"), "min")],
        reverse=True,
        shift=WINDOW_SHIFT,
    )
    closer = F.least("closer_seq", "_later")
    windows = later.filter(F.col("first_seq").isNotNull()).select(
        "window_index",
        "first_seq",
        F.when(closer.isNotNull(), F.greatest(closer, F.col("first_seq"))).alias("close_seq"),
    )
    above = running(
        windows,
        [],
        "window_index",
        [Running("_above", F.col("close_seq"), "min")],
        reverse=True,
        shift=WINDOW_SHIFT,
    )
    closed_by = F.least("close_seq", "_above")
    opened = F.coalesce(closed_by >= F.col("first_seq"), F.lit(True))
    return above.select(
        "window_index",
        "first_seq",
        F.when(opened, F.col("close_seq")).alias("close_seq"),
        closed_by.alias("closed_by"),
        opened.alias("opened"),
    )


def assign(placed: DataFrame, marked: DataFrame, windows: DataFrame, config: StreamConfig) -> DataFrame:
    """Add ``late`` and ``assigned_window`` to every reading.

    ``marked`` and ``windows`` should be settled tables: they are joined by
    window index, and Spark broadcasts them only while they are small.
    """
    judged = placed.join(
        windows.select("window_index", "closed_by"), "window_index", "left"
    ).withColumn("late", F.coalesce(F.col("closed_by") < F.col("seq"), F.lit(False)))
    on_time = judged.filter(~F.col("late")).withColumn("assigned_window", F.col("window_index"))
    late = settle(judged.filter("late").drop("closed_by"), "late")
    return on_time.drop("closed_by").unionByName(_oldest_open(late, marked, windows, config))


def _oldest_open(
    late: DataFrame, marked: DataFrame, windows: DataFrame, config: StreamConfig
) -> DataFrame:
    """Give each late reading the oldest window open when it arrived.

    Windows at or below the highest closable index are closed, and none lies
    more than ``open_span`` above it. So each late reading has a few candidate
    windows and finds them by an equality join.
    """
    closers = marked.filter(F.col("closer_seq").isNotNull()).select(
        F.col("closer_seq").alias("seq"), F.col("window_index").alias("closed_through")
    )
    known = as_of(
        late.select("seq"), closers, "seq", ["closed_through"], how="max", shift=SEQ_SHIFT
    )
    tries = known.select(
        "seq",
        F.explode(
            F.sequence(F.col("closed_through") + 1, F.col("closed_through") + config.open_span)
        ).alias("_candidate"),
    )
    opened = windows.filter("opened").select(
        F.col("window_index").alias("_candidate"), F.col("first_seq").alias("_opened_at")
    )
    targets = (
        tries.join(opened, "_candidate")
        .filter(F.col("_opened_at") < F.col("seq"))
        .groupBy("seq")
        .agg(F.min("_candidate").alias("assigned_window"))
    )
    return late.join(targets, "seq", "left")


def assigned(readings: DataFrame, config: StreamConfig, origin_us: Column | None = None) -> DataFrame:
    """Readings of a whole table with their windows, late ones included."""
    if origin_us is None:
        origin_us = find_origin(readings, config.width_us)
    placed = place(readings, config, origin_us)
    marked = settle(marks(placed), "marks")
    windows = settle(registry(marked), "windows")
    return assign(placed, marked, windows, config)


def window_contents(filed: DataFrame) -> DataFrame:
    """Rows, late rows and lines of each window; late rows count in both."""
    return (
        filed.filter(F.col("assigned_window").isNotNull())
        .groupBy(F.col("assigned_window").alias("window_index"))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.col("late")).alias("late_rows"),
            F.array_sort(F.collect_set("line_id")).alias("lines"),
            F.min("ingest_us").alias("first_us"),
            F.max("ingest_us").alias("last_us"),
        )
    )


def window_closes(windows: DataFrame) -> DataFrame:
    """Opened windows; those without a closing arrival are drained at the end."""
    return windows.filter("opened").select(
        "window_index", "first_seq", "close_seq", F.col("close_seq").isNull().alias("drained")
    )


def watermark_trace(placed: DataFrame, config: StreamConfig, shift: int = SEQ_SHIFT) -> DataFrame:
    """The watermark after each arrival: the newest event less the lateness."""
    seen = running(
        placed, [], "seq", [Running("_newest", F.col("event_us"), "max")], shift=shift
    )
    newest = F.greatest("_newest", "event_us")
    return seen.select("seq", "event_us", (newest - config.lateness_us).alias("watermark_us"))


def rows_histogram(contents: DataFrame, bounds: list[int]) -> DataFrame:
    """How many windows fall below each bound of rows, cumulatively."""
    size = F.col("n_rows")
    return contents.agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.sum("n_rows").alias("sum_rows"),
        *[F.count_if(size <= b).alias(f"le_{b}") for b in bounds],
    )
