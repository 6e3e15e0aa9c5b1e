"""Threshold rules over a stream: a series of steps, then evaluations over it, under one watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.functions.effectiveness import oee_factors, oee_sums
from linewarden.schema import OEE_FLOOR, StreamConfig
from linewarden.sources.records import judge


def oee_rule(
    readings: DataFrame,
    config: StreamConfig,
    *,
    floor: float = OEE_FLOOR,
    step_min: int = 1,
    eval_min: int = 5,
    every_min: int = 1,
) -> DataFrame:
    """Evaluations in which the OEE of a line is below the floor in at least one step.

    As ``operators.panels.firing_rule``, on a stream of readings: the first stateful
    operator closes steps, the second the evaluations that hold a breaching one. Both go
    by the watermark, so an evaluation appears once, when it is final. A reading that is later
    than the allowed lateness takes no part.
    """
    rows = judge(readings).filter(F.col("line_id").isNotNull())
    watched = rows.withWatermark("event_time", f"{config.lateness_us} microseconds")
    step = F.window("event_time", f"{step_min} minutes")
    steps = oee_factors(
        watched.groupBy(step.alias("step"), "line_id").agg(*oee_sums(~F.col("malformed")))
    )
    low = steps.filter(F.col("oee") < floor).select(F.window_time("step").alias("at"), "line_id")
    evaluation = F.window("at", f"{eval_min} minutes", f"{every_min} minutes")
    fired = low.groupBy(evaluation.alias("eval"), "line_id").agg(
        F.count(F.lit(1)).alias("breaching_steps")
    )
    return fired.select(
        F.unix_micros("eval.start").alias("eval_start_us"),
        F.unix_micros("eval.end").alias("eval_end_us"),
        "line_id",
        "breaching_steps",
    )
