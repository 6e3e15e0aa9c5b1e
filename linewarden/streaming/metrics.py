"""Counters and histograms that grow with a stream, one small row per line.

Every batch adds its own partial rows to the totals of the batch before and writes both
merged to a folder of its own number. So the totals can be read while the stream runs, a
batch that runs again counts once, and the state is as large as the number of lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.operators.metrics import LAG_BOUNDS_MS
from linewarden.sources.sinks import write_metric
from linewarden.streaming.budget import Gate, LimitedRun, RunBudget


def partial(readings: DataFrame, bounds: Sequence[int]) -> DataFrame:
    """The totals of some readings: whole numbers, so that any merge gives the same."""
    lag = F.unix_micros("ingest_time") - F.unix_micros("event_time")
    warm = F.col("temperature").isNotNull() & ~F.isnan("temperature")
    latest = F.when(warm, F.struct("seq", "temperature"))
    return readings.withColumn("_lag", lag).groupBy("line_id").agg(
        F.count(F.lit(1)).alias("n_readings"),
        F.sum("_lag").alias("sum_lag_us"),
        F.max("_lag").alias("max_lag_us"),
        F.array(*[F.count_if(F.col("_lag") <= 1000 * b) for b in bounds]).alias("n_le"),
        F.max(latest).alias("latest"),
    )


def merged(parts: DataFrame, n_bounds: int) -> DataFrame:
    """Totals out of totals."""
    return parts.groupBy("line_id").agg(
        F.sum("n_readings").alias("n_readings"),
        F.sum("sum_lag_us").alias("sum_lag_us"),
        F.max("max_lag_us").alias("max_lag_us"),
        F.array(*[F.sum(F.get("n_le", i)) for i in range(n_bounds)]).alias("n_le"),
        F.max("latest").alias("latest"),
    )


class MetricRun:
    """Metrics of one stream of readings, below ``path``."""

    def __init__(
        self, spark: SparkSession, path: str, bounds: Sequence[int] = LAG_BOUNDS_MS
    ) -> None:
        self.spark, self.path, self.bounds = spark, path.rstrip("/"), list(bounds)
        self.gate: Gate | None = None

    def start(
        self, readings: DataFrame, *, available_now: bool = False, every: str = "10 seconds"
    ) -> LimitedRun:
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        self.gate = Gate()
        writer = (
            readings.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**trigger)
        )
        return LimitedRun(writer.start, self.gate, RunBudget(), self.spark)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        with self.gate.admit(batch_id) if self.gate else nullcontext():
            totals = partial(batch, self.bounds)
            if batch_id > 0:
                totals = totals.unionByName(self._folder(batch_id - 1))
            totals = merged(totals, len(self.bounds))
            write_metric(totals, f"{self.path}/totals/batch={batch_id}")

    def totals(self) -> DataFrame:
        """One row per line, as of the newest batch."""
        batches = self.spark.read.parquet(f"{self.path}/totals").select("batch")
        return self._folder(batches.agg(F.max("batch").alias("batch")).first().batch)

    def received(self) -> DataFrame:
        return self.totals().select("line_id", "n_readings")

    def lag_histogram(self) -> DataFrame:
        """As ``operators.metrics.lag_histogram`` over all readings so far."""
        cells = F.arrays_zip(
            F.array(*[F.lit(b).cast("bigint") for b in self.bounds]).alias("le_ms"), "n_le"
        )
        return self.totals().select(
            "line_id",
            "n_readings",
            (F.col("sum_lag_us") / 1000.0).alias("sum_lag_ms"),
            F.inline(cells).alias("le_ms", "n_le"),
        )

    def latest_temperature(self) -> DataFrame:
        found = self.totals().filter("latest is not null")
        return found.select("line_id", F.col("latest.temperature").alias("temperature"))

    def peak_lag(self) -> DataFrame:
        worst = F.greatest(F.lit(0.0), F.col("max_lag_us") / 1e6)
        return self.totals().select("line_id", worst.alias("max_lag_s"))

    def _folder(self, batch_id: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/totals/batch={batch_id}")
