"""OEE tables per line, per window and per run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.effectiveness import oee_band, oee_factors, oee_sums
from linewarden.functions.numbers import fixed_text, once

OEE_COLUMNS = [
    "availability",
    "performance",
    "quality",
    "oee",
    "planned_min",
    "run_min",
    "total_count",
    "good_count",
]


def oee_by(
    judged: DataFrame,
    keys: Sequence[str] = ("line_id",),
    ideal_cycle_s: Column | None = None,
    cycles: DataFrame | None = None,
) -> DataFrame:
    """OEE of the clean rows of each key, with zeros where there are none.

    Rows without a line belong to no line. Sums are partial before the
    shuffle, so a hot line costs one row per task. ``cycles`` has line_id and
    ideal_cycle_s, once per line: a line that it names takes its cycle from there.
    """
    sums = (
        judged.filter(F.col("line_id").isNotNull())
        .groupBy(*keys)
        .agg(*oee_sums(~F.col("malformed")))
    )
    if cycles is not None:
        given = cycles.select("line_id", F.col("ideal_cycle_s").alias("_given"))
        sums = sums.join(given, "line_id", "left")
        other = F.col("cycle_s") if ideal_cycle_s is None else ideal_cycle_s
        ideal_cycle_s = F.coalesce("_given", other)
    return oee_factors(sums, ideal_cycle_s).select(*keys, *OEE_COLUMNS)


def oee_table(results: DataFrame) -> DataFrame:
    """The table as printed: two decimals and a colour band."""
    shown = {name: once(F.col(name), lambda x: fixed_text(x, 2)) for name in OEE_COLUMNS[:4]}
    return results.withColumn("band", oee_band(F.col("oee"))).select(
        "line_id", *[text.alias(name) for name, text in shown.items()], "band"
    )


def latest(results: DataFrame, by: str) -> DataFrame:
    """Rows of the highest ``by``; the maximum is one value, found first."""
    top = results.agg(F.max(by).alias("top")).scalar()
    return results.filter(F.col(by) == top)


def drift(results: DataFrame, run: str) -> DataFrame:
    """First against last run of each line."""
    return (
        results.groupBy("line_id")
        .agg(
            F.min(run).alias("first_run"),
            F.max(run).alias("last_run"),
            F.min_by("oee", run).alias("first_oee"),
            F.max_by("oee", run).alias("last_oee"),
        )
        .withColumn("oee_drift", F.col("last_oee") - F.col("first_oee"))
    )
