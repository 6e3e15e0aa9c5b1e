"""Triggers on arrival, silence from absence, and the cooldown between alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.numbers import fixed_text, is_blank, strip
from linewarden.functions.validity import threshold_breach
from linewarden.operators.ordered import SEQ_SHIFT, TIME_SHIFT, Running, as_of, running
from linewarden.operators.spacing import spaced
from linewarden.schema import (
    ALERT_MALFORMED,
    ALERT_SILENCE,
    ALERT_THRESHOLD,
    StreamConfig,
)
from linewarden.session import settle

# The order of the triggers within one arrival.
RANK = {"resumed": 0, "breach": 1, "malformed": 2, "silent": 3}

# Fixed value: the text of a recovery.
RESUMED_TEXT = "line resumed reporting"

EVENT_COLUMNS = ["seq", "at_us", "trigger_rank", "kind", "phase", "line_id", "detail", "value"]


def reading_triggers(
    judged: DataFrame, config: StreamConfig, clock: str = "arrival_us"
) -> DataFrame:
    """Hot and malformed readings, one row each, from judged readings."""
    temperature = F.col("temperature")
    breach_text = F.concat(
        F.lit("temperature "),
        fixed_text(temperature, 1),
        F.lit(" > "),
        fixed_text(F.lit(float(config.temp_max)), 1),
    )
    batch = F.when(is_blank(F.col("batch_id")), "<blank batch_id>").otherwise(
        strip(F.col("batch_id"))
    )
    malformed_text = F.concat(
        F.lit("malformed reading "), batch, F.lit(" rejected at ingest")
    )

    def trigger(test, phase, kind, detail, value):
        return F.when(
            test,
            F.struct(
                F.lit(RANK[phase]).alias("trigger_rank"),
                F.lit(kind).alias("kind"),
                F.lit(phase).alias("phase"),
                detail.alias("detail"),
                value.alias("value"),
            ),
        )

    hits = F.array_compact(
        F.array(
            trigger(
                threshold_breach(config.temp_max),
                "breach",
                ALERT_THRESHOLD,
                breach_text,
                temperature,
            ),
            trigger(
                F.col("malformed"),
                "malformed",
                ALERT_MALFORMED,
                malformed_text,
                F.lit(None).cast("double"),
            ),
        )
    )
    return judged.select(
        "seq", F.col(clock).alias("at_us"), "line_id", F.inline(hits)
    ).select(*EVENT_COLUMNS)


def line_gaps(arrivals: DataFrame, shift: int = SEQ_SHIFT) -> DataFrame:
    """Every arrival with the next arrival of its own line."""
    return running(
        arrivals.select("seq", "line_id", "ingest_us"),
        ["line_id"],
        "seq",
        [Running("next_seq", F.col("seq")), Running("next_us", F.col("ingest_us"))],
        reverse=True,
        shift=shift,
    )


def silence_spells(arrivals: DataFrame, threshold_s: float, shift: int = SEQ_SHIFT) -> DataFrame:
    """Gaps of a line that are longer than the threshold, open ends included."""
    limit = F.col("ingest_us") + F.lit(int(round(threshold_s * 1_000_000)))
    return (
        line_gaps(arrivals, shift)
        .withColumn("limit_us", limit)
        .filter(F.col("next_us").isNull() | (F.col("next_us") > F.col("limit_us")))
    )


def _silent_text(quiet_s: Column, threshold_s: float) -> Column:
    # The text of a silence.
    return F.concat(
        F.lit("no reading for "),
        fixed_text(quiet_s, 1),
        F.lit("s (> "),
        fixed_text(F.lit(float(threshold_s)), 1),
        F.lit("s threshold)"),
    )


def silence_events(watched: DataFrame, threshold_s: float) -> DataFrame:
    """Rows of the silence watchdog as events, for one cooldown and feed with all others."""
    silent = F.col("phase") == "silent"
    rank = F.when(silent, RANK["silent"]).otherwise(RANK["resumed"])
    text = F.when(silent, _silent_text(F.col("quiet_s"), threshold_s)).otherwise(RESUMED_TEXT)
    return watched.select(
        F.lit(None).cast("bigint").alias("seq"),
        (F.col("at_ms") * 1000).alias("at_us"),
        rank.alias("trigger_rank"),
        F.lit(ALERT_SILENCE).alias("kind"),
        "phase",
        "line_id",
        text.alias("detail"),
        F.col("quiet_s").alias("value"),
    )


def silence_triggers(
    arrivals: DataFrame,
    threshold_s: float,
    *,
    seq_shift: int = SEQ_SHIFT,
    time_shift: int = TIME_SHIFT,
) -> DataFrame:
    """Silence at the first arrival of any line past the limit, then recovery.

    ``arrivals`` has ``seq``, ``line_id`` and ``ingest_us``, which must not
    fall as ``seq`` grows. A line is checked only when something arrives; a
    gap that ends with the line's own return stays unnoticed.
    """
    spells = settle(silence_spells(arrivals, threshold_s, seq_shift), "spells")
    seen = arrivals.select(
        F.col("ingest_us").alias("limit_us"),
        F.col("seq").alias("seen_seq"),
        F.col("ingest_us").alias("seen_us"),
    )
    # Time does not fall as seq grows, so both minima belong to one arrival.
    noticed = as_of(
        spells,
        seen,
        "limit_us",
        ["seen_seq", "seen_us"],
        how="min",
        reverse=True,
        shift=time_shift,
    ).filter(
        F.col("seen_seq").isNotNull()
        & (F.col("next_seq").isNull() | (F.col("seen_seq") < F.col("next_seq")))
    )
    quiet = (F.col("seen_us") - F.col("ingest_us")) / F.lit(1_000_000.0)
    silent_text = _silent_text(quiet, threshold_s)

    def event(phase, seq, at, detail, value):
        return F.struct(
            seq.alias("seq"),
            at.alias("at_us"),
            F.lit(RANK[phase]).alias("trigger_rank"),
            F.lit(ALERT_SILENCE).alias("kind"),
            F.lit(phase).alias("phase"),
            F.col("line_id"),
            detail.alias("detail"),
            value.alias("value"),
        )

    return noticed.select(
        F.inline(
            F.array(
                event("silent", F.col("seen_seq"), F.col("seen_us"), silent_text, quiet),
                event(
                    "resumed",
                    F.col("next_seq"),
                    F.col("next_us"),
                    F.lit(RESUMED_TEXT),
                    F.lit(None).cast("double"),
                ),
            )
        )
    ).filter(F.col("seq").isNotNull())


def triggers(
    judged: DataFrame, config: StreamConfig, threshold_s: float, clock: str = "arrival_us"
) -> DataFrame:
    """All triggers of a run before any cooldown, timed by a column of microseconds."""
    arrivals = judged.select("seq", "line_id", F.col(clock).alias("ingest_us"))
    return reading_triggers(judged, config, clock).unionByName(
        silence_triggers(arrivals, threshold_s)
    )


# --- cooldown ------------------------------------------------------------------

_KEY = ["kind", "line_id"]


def cooldown(events: DataFrame, cooldown_us: int, *, shift: int = TIME_SHIFT) -> DataFrame:
    """Distinct times per kind and line, with ``n`` occurrences.

    ``fire`` numbers the fires up to a time and ``fired`` tells whether it is one. Only
    the first occurrence of a moment can fire, so copies collapse into a count first.
    Tables that later steps read more than once are written.
    """
    first = F.struct("seq", "trigger_rank", "phase", "detail", "value")
    moments = settle(
        events.groupBy(*_KEY, "at_us").agg(
            F.min_by(first, F.struct("seq", "trigger_rank")).alias("_first"),
            F.count(F.lit(1)).alias("n"),
        ),
        "moments",
    )
    fires = settle(spaced(moments, _KEY, "at_us", cooldown_us, shift=shift), "fires")
    # A fire comes before the moment of its own time.
    rows = moments.withColumn("_rank", F.lit(1)).unionByName(
        fires.withColumn("_rank", F.lit(0)), allowMissingColumns=True
    )
    is_fire = F.col("_rank") == 0
    wanted = [
        Running("fire", is_fire.cast("bigint"), "sum"),
        Running("_fired_us", F.when(is_fire, F.col("at_us")), "max"),
    ]
    return (
        running(rows, _KEY, "at_us", wanted, tie=["_rank"], shift=shift)
        .filter(~is_fire)
        .withColumn("fired", F.col("_fired_us") == F.col("at_us"))
        .select(*_KEY, "at_us", "n", "_first.*", "fire", "fired")
    )


def alert_feed(events: DataFrame, cooldown_us: int, *, shift: int = TIME_SHIFT) -> DataFrame:
    """The alerts of a run: those that fired, then what was held back.

    Every fire carries the count suppressed since the fire before it. What the
    cooldown still held at the end becomes a row of phase ``pending``.
    """
    fire_columns = ["seq", "at_us", "trigger_rank", "phase", "detail", "value"]
    if cooldown_us <= 0:
        return events.select(
            *_KEY, *fire_columns, F.lit(0).cast("bigint").alias("suppressed")
        ).withColumnRenamed("at_us", "fired_us")
    fired = F.col("fired").cast("bigint")
    numbered = cooldown(events, cooldown_us, shift=shift)
    # Between two fires: the first one, and all that was held back after it.
    spans = numbered.groupBy(*_KEY, F.col("fire").alias("_fire")).agg(
        F.max(F.when(F.col("fired"), F.struct(*fire_columns))).alias("_fired"),
        F.sum(F.col("n") - fired).alias("_held"),
        F.max("at_us").alias("_last_us"),
    )
    nothing = F.lit(None).cast(spans.schema["_fired"].dataType)
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("_fire"), F.col("_fired"), zero.alias("suppressed"), F.col("_last_us")
        ),
        F.struct(
            (F.col("_fire") + 1).alias("_fire"),
            nothing.alias("_fired"),
            F.col("_held").alias("suppressed"),
            F.col("_last_us"),
        ),
    )
    alerts = (
        spans.select(*_KEY, F.inline(sides))
        .groupBy(*_KEY, "_fire")
        .agg(
            F.max("_fired").alias("_fired"),
            F.sum("suppressed").alias("suppressed"),
            F.max("_last_us").alias("_last_us"),
        )
        .filter(F.col("_fired").isNotNull() | (F.col("suppressed") > 0))
    )
    left = pending_text(F.col("suppressed"))
    is_fire = F.col("_fired").isNotNull()
    return alerts.select(
        F.col("_fired.seq").alias("seq"),
        F.coalesce(F.col("_fired.at_us"), F.col("_last_us")).alias("fired_us"),
        F.col("_fired.trigger_rank").alias("trigger_rank"),
        "kind",
        F.when(is_fire, F.col("_fired.phase")).otherwise("pending").alias("phase"),
        "line_id",
        F.when(is_fire, F.col("_fired.detail")).otherwise(left).alias("detail"),
        F.col("_fired.value").alias("value"),
        "suppressed",
    )


def pending_text(suppressed: Column) -> Column:
    # The text of what a cooldown held at the end.
    return F.concat(
        suppressed.cast("string"), F.lit(" further occurrence(s) suppressed by cooldown")
    )


def alert_counts(feed: DataFrame) -> DataFrame:
    return feed.groupBy("line_id", "kind").agg(F.count(F.lit(1)).alias("n_alerts"))
