"""OEE = availability x performance x quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.schema import OEE_FLOOR, OEE_GOOD


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def whole(count: Column) -> Column:
    """A double without its fraction; from 2^53 on it has none."""
    exact = F.abs(count) < float(1 << 53)
    return F.when(exact, count.try_cast("bigint").cast("double")).otherwise(count)


def shown_count(count: Column) -> Column:
    """A count as a long; null where it is beyond one."""
    return count.try_cast("bigint")


def oee_sums(clean: Column) -> list[Column]:
    """Partial sums over the clean rows only.

    The condition sits inside the aggregates, so a line without one clean row
    still has its row of zeros. Counts stay doubles here, cut to whole numbers while
    doubles are exact: a feed may send any finite number.
    """

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(clean, F.col(name))), F.lit(0.0))

    return [
        total("planned_min").alias("planned_min"),
        total("downtime_min").alias("downtime_min"),
        whole(total("total_count")).alias("total_count"),
        whole(total("good_count")).alias("good_count"),
        F.coalesce(F.avg(F.when(clean, F.col("ideal_cycle_s"))), F.lit(0.0)).alias("cycle_s"),
    ]


def oee_factors(sums: DataFrame, ideal_cycle_s: Column | None = None) -> DataFrame:
    """Add the three factors and their product to a table of ``oee_sums``."""
    planned = F.col("planned_min")
    run = planned - F.col("downtime_min")
    cycle = F.col("cycle_s") if ideal_cycle_s is None else ideal_cycle_s
    total = F.col("total_count")
    factors = sums.withColumns(
        {
            "availability": F.when(planned > 0, clamp01(run / planned)).otherwise(0.0),
            "performance": F.when(
                run > 0, clamp01(total * cycle / F.lit(60.0) / run)
            ).otherwise(0.0),
            "quality": F.when(total > 0, clamp01(F.col("good_count") / total)).otherwise(0.0),
            "run_min": F.greatest(run, F.lit(0.0)),
        }
    )
    return factors.withColumns(
        {
            "oee": F.col("availability") * F.col("performance") * F.col("quality"),
            "total_count": shown_count(total),
            "good_count": shown_count(F.col("good_count")),
        }
    )


def oee_band(oee: Column) -> Column:
    return (
        F.when(oee >= OEE_GOOD, "green").when(oee >= OEE_FLOOR, "yellow").otherwise("red")
    )


def run_minutes() -> Column:
    """Run time of one record, never below zero; OEE itself uses the sums."""
    return F.greatest(F.col("planned_min") - F.col("downtime_min"), F.lit(0.0))
