"""Event time, arrival time and the window grid.

All arithmetic is on whole microseconds, so no result depends on the session
time zone or on the rounding of a double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewarden.schema import DAY_US, MINUTE_US


def micros(timestamp: Column) -> Column:
    return F.unix_micros(timestamp.cast("timestamp"))


def floor_div(value: Column, width: int) -> Column:
    """Whole quotient, rounded down for negative values as well."""
    step = F.lit(width).cast("bigint")
    return F.call_function("div", value - F.pmod(value, step), step)


def lag_ms(event_us: Column, ingest_us: Column) -> Column:
    return (ingest_us - event_us) / F.lit(1000.0)


def aligned_origin(first_event_us: Column, width_us: int) -> Column:
    """Start of the window of the first event, counted from its midnight."""
    day = first_event_us - F.pmod(first_event_us, F.lit(DAY_US))
    elapsed = first_event_us - day
    return day + elapsed - F.pmod(elapsed, F.lit(width_us).cast("bigint"))


def window_index(event_us: Column, origin_us: Column, width_us: int) -> Column:
    return floor_div(event_us - origin_us, width_us)


def closable_index(event_us: Column, origin_us: Column, width_us: int, lateness_us: int) -> Column:
    """The highest window that an event closes, if it is the newest so far."""
    return floor_div(event_us - F.lit(lateness_us) - origin_us, width_us) - 1


def step_start(time_us: Column, step_us: int = MINUTE_US) -> Column:
    return time_us - F.pmod(time_us, F.lit(step_us).cast("bigint"))


def iso_text(timestamp: Column) -> Column:
    """ISO-8601 text; the fraction appears only where there is one."""
    us = micros(timestamp)
    return F.concat(
        F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.pmod(us, F.lit(1_000_000)) == 0, "").otherwise(
            F.date_format(timestamp, ".SSSSSS")
        ),
    )


def parse_us(text: Column) -> Column:
    """Microseconds of an ISO text; null where it is none.

    A text without an offset is taken as UTC, whatever the session zone is.
    """
    zoned = F.when(
        text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$") & text.contains(":"), text
    ).otherwise(F.concat(text, F.lit("Z")))
    stamped = F.when(text.contains(":"), zoned).otherwise(F.concat(text, F.lit("T00:00:00Z")))
    return F.unix_micros(F.try_to_timestamp(stamped))


def device_us(millis: Column, text: Column) -> Column:
    """Device time in microseconds: a number is epoch millis, a text is ISO."""
    return F.coalesce(F.floor(millis * 1000).cast("bigint"), parse_us(text))
