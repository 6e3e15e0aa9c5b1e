"""Column names, fixed values and the parameters of a run."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# The nine columns of a raw batch record, in order.
RECORD_COLUMNS = [
    "ts",
    "line_id",
    "batch_id",
    "planned_min",
    "downtime_min",
    "ideal_cycle_s",
    "total_count",
    "good_count",
    "temperature",
]

# The fields that must be finite numbers.
NUMERIC_COLUMNS = ["planned_min", "downtime_min", "ideal_cycle_s", "total_count", "good_count"]

# Columns whose nulls count as missing readings.
NULLABLE_QUALITY_COLUMNS = ["temperature"]

# The four stages of a run, and the alert kinds.
STAGES = ["ingest", "clean", "transform", "aggregate"]
ALERT_THRESHOLD = "threshold_breach"
ALERT_MALFORMED = "malformed_reading"
ALERT_SILENCE = "line_silent"

STALE_GAP_FACTOR = 5.0
OEE_FLOOR = 0.65
OEE_GOOD = 0.75

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000

# Counts stay text until they are coerced: a broken feed sends "ERR".
RECORD_SCHEMA = T.StructType(
    [
        T.StructField("ts", T.StringType()),
        T.StructField("line_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("planned_min", T.StringType()),
        T.StructField("downtime_min", T.StringType()),
        T.StructField("ideal_cycle_s", T.StringType()),
        T.StructField("total_count", T.StringType()),
        T.StructField("good_count", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
    ]
)

# A reading is a record with two clocks and its place in the arrival order.
READING_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("event_time", T.TimestampType()),
        T.StructField("ingest_time", T.TimestampType()),
        T.StructField("line_id", T.StringType()),
        T.StructField("batch_id", T.StringType()),
        T.StructField("planned_min", T.DoubleType()),
        T.StructField("downtime_min", T.DoubleType()),
        T.StructField("ideal_cycle_s", T.DoubleType()),
        T.StructField("total_count", T.StringType()),
        T.StructField("good_count", T.StringType()),
        T.StructField("temperature", T.DoubleType()),
    ]
)


@dataclass(frozen=True)
class StreamConfig:
    """Windows, triggers and cooldown of a stream run."""

    # The defaults.
    window_min: float = 480.0
    allowed_lateness_min: float = 60.0
    temp_max: float = 85.0
    silence_factor: float = STALE_GAP_FACTOR
    min_silence_s: float = 1.0
    alert_cooldown_s: float = 2.0

    def __post_init__(self) -> None:
        if self.window_min <= 0:
            raise ValueError("a window needs a width above zero")

    @property
    def width_us(self) -> int:
        return int(round(self.window_min * MINUTE_US))

    @property
    def lateness_us(self) -> int:
        return int(round(self.allowed_lateness_min * MINUTE_US))

    @property
    def cooldown_us(self) -> int:
        return int(round(self.alert_cooldown_s * 1_000_000))

    @property
    def open_span(self) -> int:
        """The most windows that can be open at one time.

        The newest event lies at most this many windows above the highest
        closable one, so the bound follows from the two widths alone.
        """
        return math.ceil(self.lateness_us / self.width_us) + 1
