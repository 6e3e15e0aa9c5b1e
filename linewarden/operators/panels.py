"""Dashboard panels and threshold rules over the ledger and similar tables.

A panel reads rows with ``start_ns``: filter, cut time into steps, aggregate
per step and series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.clocks import step_start
from linewarden.operators.quantiles import exact_quantile
from linewarden.schema import DAY_US, MINUTE_US

STEP_US = MINUTE_US


def _stepped(rows: DataFrame, where: Column | None, step_us: int) -> DataFrame:
    chosen = rows if where is None else rows.filter(where)
    start = F.call_function("div", F.col("start_ns"), F.lit(1000).cast("bigint"))
    return chosen.withColumn("step_us", step_start(start, step_us))


def panel(
    rows: DataFrame,
    value: Column,
    keys: Sequence[str],
    *,
    where: Column | None = None,
    legend: Column | None = None,
    step_us: int = STEP_US,
) -> DataFrame:
    """One value per step and series; ``value`` is an aggregate."""
    out = _stepped(rows, where, step_us).groupBy("step_us", *keys).agg(value.alias("value"))
    return out if legend is None else out.withColumn("legend", legend)


def quantile_panel(
    rows: DataFrame,
    column: str,
    q: float,
    keys: Sequence[str],
    *,
    where: Column | None = None,
    step_us: int = STEP_US,
) -> DataFrame:
    """Like ``panel``, with an exact quantile of a bigint column."""
    stepped = _stepped(rows, where, step_us)
    return exact_quantile(stepped, ["step_us", *keys], column, q, name="value")


def zero_fill(series: DataFrame, keys: Sequence[str], step_us: int = STEP_US) -> DataFrame:
    """Every step between the first and the last of a series, 0 where empty.

    Steps unfold day by day out of the values of that day, behind the last exchange: no row
    holds more than a day, and no task has to keep the steps that it makes.
    """
    day, last = F.lit(DAY_US).cast("bigint"), F.col("_last")
    value = F.col("value").cast("double")
    steps = series.groupBy(*keys, "step_us").agg(F.coalesce(F.max(value), F.lit(0.0)).alias("value"))
    ends = steps.groupBy(*keys).agg(
        F.min("step_us").alias("_first"), F.max("step_us").alias("_last")
    )
    days = ends.select(*keys, "_last", F.explode(F.sequence("_first", last, day)).alias("_day"))
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    number = F.call_function("div", F.col("step_us") - F.col("_first"), day)
    held = (
        steps.alias("s")
        .join(ends.alias("e"), same)
        .select(
            *[F.col(f"s.{k}").alias(k) for k in keys],
            "_last",
            (F.col("_first") + number * day).alias("_day"),
            F.struct("step_us", "value").alias("_held"),
        )
    )
    # A fixed number of partitions, or Spark would put the few days into one task.
    tasks = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = (
        days.unionByName(held, allowMissingColumns=True)
        .repartition(tasks, *keys, "_day")
        .groupBy(*keys, "_day")
        .agg(F.max(last).alias("_last"), F.array_sort(F.collect_list("_held")).alias("_held"))
    )
    # Each value is followed by empty steps up to the next; the first place has no value.
    none = F.array(F.lit(None).cast("struct<step_us:bigint,value:double>"))
    following = F.concat(
        F.transform("_held", lambda x: x["step_us"]), F.array(F.lit(None).cast("bigint"))
    )
    places = F.arrays_zip(F.concat(none, F.col("_held")).alias("own"), following.alias("next"))
    unfolded = filled.select(*keys, "_day", "_last", F.posexplode(places).alias("_n", "_place"))
    step = F.lit(step_us).cast("bigint")
    own = F.col("_place.own")
    past = F.call_function("div", own["step_us"] - F.col("_day"), step) + 1
    start = F.when(F.col("_n") == 0, F.col("_day")).otherwise(F.col("_day") + past * step)
    end = F.least(F.col("_day") + DAY_US - step, last, F.col("_place.next") - 1)
    empty = F.transform(
        F.when(start <= end, F.sequence(start, end, step)).otherwise(F.array().cast("array<bigint>")),
        lambda at: F.struct(at.alias("step_us"), F.lit(0.0).alias("value")),
    )
    valued = F.when(F.col("_n") > 0, F.array(own)).otherwise(
        F.array().cast("array<struct<step_us:bigint,value:double>>")
    )
    return unfolded.select(*keys, F.inline(F.concat(valued, empty)))


def reduce_series(series: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """One value per series over its steps: ``avg`` or ``sum``."""
    fold = {"avg": F.avg, "sum": F.sum}[how]
    return series.groupBy(*keys).agg(
        fold("value").alias("value"), F.count(F.lit(1)).alias("n_steps")
    )


def firing_rule(
    series: DataFrame,
    keys: Sequence[str],
    breach: Column,
    *,
    eval_min: int = 5,
    every_min: int = 1,
) -> DataFrame:
    """Evaluations in which at least one step of the window breaches.

    Only breaching steps unfold into the sliding windows that hold them.
    """
    hit = series.filter(breach).withColumn("_at", F.timestamp_micros("step_us"))
    window = F.window("_at", f"{eval_min} minutes", f"{every_min} minutes")
    return (
        hit.groupBy(window, *keys)
        .agg(F.count(F.lit(1)).alias("breaching_steps"))
        .select(
            F.unix_micros(F.col("window.start")).alias("eval_start_us"),
            F.unix_micros(F.col("window.end")).alias("eval_end_us"),
            *keys,
            "breaching_steps",
        )
    )
