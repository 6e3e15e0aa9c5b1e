"""Totals of a stream run in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.operators.alerts import alert_counts
from linewarden.operators.metrics import peak_lag


def stream_summary(filed: DataFrame, windows: DataFrame, feed: DataFrame) -> DataFrame:
    """Readings, windows and late rows, with peak lag and alerts as text.

    The texts list lines and alert kinds, after both were aggregated.
    """
    lags = F.concat("line_id", F.lit("="), F.round("max_lag_s").cast("bigint").cast("string"), F.lit("s"))
    kinds = alert_counts(feed).groupBy("kind").agg(F.sum("n_alerts").alias("n"))
    return filed.agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.count_if("late").alias("n_late"),
    ).select(
        "n_readings",
        windows.filter("opened").agg(F.count(F.lit(1)).alias("n")).scalar().alias("n_windows"),
        "n_late",
        _listed(peak_lag(filed).filter(F.col("line_id").isNotNull()), lags).alias("peak_lag"),
        _listed(kinds, F.concat("kind", F.lit("="), F.col("n").cast("string"))).alias("alerts"),
    )


def _listed(rows: DataFrame, text: Column) -> Column:
    gathered = rows.agg(F.array_join(F.array_sort(F.collect_list(text)), "  ").alias("text"))
    return gathered.scalar()
