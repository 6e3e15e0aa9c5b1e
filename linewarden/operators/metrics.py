"""Counters, gauges and histograms over readings, as aggregate tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewarden.operators.quantiles import exact_quantile

# Upper bounds of the lag histogram, in milliseconds.
LAG_BOUNDS_MS = [0, 30_000, 60_000, 90_000, 300_000, 600_000, 900_000, 1_200_000, 1_800_000]


def readings_received(readings: DataFrame) -> DataFrame:
    return readings.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_readings"))


def lag_histogram(placed: DataFrame, bounds: Sequence[int] = LAG_BOUNDS_MS) -> DataFrame:
    """Count, sum and one row per bound: how many lags do not exceed it."""
    lag = F.col("lag_ms")
    counts = placed.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.sum("lag_ms").alias("sum_lag_ms"),
        *[F.count_if(lag <= b).alias(f"_le_{i}") for i, b in enumerate(bounds)],
    )
    cells = F.array(
        *[
            F.struct(F.lit(b).cast("bigint").alias("le_ms"), F.col(f"_le_{i}").alias("n_le"))
            for i, b in enumerate(bounds)
        ]
    )
    return counts.select("line_id", "n_readings", "sum_lag_ms", F.inline(cells))


def lag_quantile(placed: DataFrame, q: float = 0.95, keys: Sequence[str] = ("line_id",)) -> DataFrame:
    """Exact quantile of the lag in milliseconds."""
    lags = placed.withColumn("lag_us", F.col("ingest_us") - F.col("event_us"))
    found = exact_quantile(lags, keys, "lag_us", q, name="_us")
    return found.select(*keys, (F.col("_us") / 1000.0).alias("lag_ms"), "n_values")


def peak_lag(placed: DataFrame) -> DataFrame:
    """Largest lag in seconds, never below zero."""
    worst = F.greatest(F.lit(0.0), F.max("lag_ms") / 1000.0)
    return placed.groupBy("line_id").agg(worst.alias("max_lag_s"))


def latest_temperature(readings: DataFrame) -> DataFrame:
    """The last temperature present per line, in arrival order."""
    present = readings.filter(
        F.col("temperature").isNotNull() & ~F.isnan("temperature")
    )
    return present.groupBy("line_id").agg(F.max_by("temperature", "seq").alias("temperature"))
