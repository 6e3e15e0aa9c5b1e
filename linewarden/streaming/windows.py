"""Windows over a live stream, with the same result as a replay of the table.

Every micro-batch files its readings, merges its window marks with those of the
batch before, and runs the batch job over the windows that it closed. All output
of a batch goes to a folder of its own number and replaces what is there, so a
batch that runs again after a failure leaves the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linewarden.operators.ledger import stage_ledger, window_spans
from linewarden.operators.windows import (
    assign,
    find_origin,
    marks,
    merge_marks,
    place,
    registry,
    window_contents,
)
from linewarden.schema import StreamConfig
from linewarden.session import prepare
from linewarden.sources.records import judge
from linewarden.streaming.budget import Gate, LimitedRun, RunBudget

OnWindows = Callable[[DataFrame, int], None]

_CLOSED = "opened and close_seq is not null"
MARKS_SCHEMA = "window_index bigint, first_seq bigint, closer_seq bigint"


class WindowRun:
    """One stream run and its tables below ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        config: StreamConfig | None = None,
        on_windows: OnWindows | None = None,
    ) -> None:
        self.spark = prepare(spark)
        self.path = path.rstrip("/")
        self.config = config or StreamConfig()
        self.on_windows = on_windows
        self.budget = RunBudget()
        self.gate: Gate | None = None

    def start(
        self,
        readings: DataFrame,
        *,
        available_now: bool = False,
        every: str = "10 seconds",
        max_readings: int | None = None,
        max_seconds: float | None = None,
    ) -> LimitedRun:
        """Start the run; ``available_now`` stops at the end of the source.

        With ``max_readings`` the run takes exactly so many, the first by ``seq`` of the batch
        in which the limit is met, and is over for good: what came behind belongs to no run.
        ``max_seconds`` ends it after the batch that is under way, and a later start goes on.
        """
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        self.budget = RunBudget(max_readings, max_seconds)
        self.gate = Gate()
        writer = (
            readings.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**trigger)
        )
        return LimitedRun(writer.start, self.gate, self.budget, self.spark)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """File the readings of a batch and run the windows that it closed."""
        with self.gate.admit(batch_id) if self.gate else nullcontext():
            before = self._taken(batch_id - 1)
            limit = self.budget.readings
            if limit is not None and before >= limit:
                self._write_taken(before, batch_id)
                return
            if limit is not None:
                batch = batch.orderBy("seq").limit(limit - before)
            seen = Observation()
            last = F.max("seq").alias("seq")
            self._process(batch.observe(seen, F.count(F.lit(1)).alias("n"), last), batch_id)
            taken = before + seen.get["n"]
            self._write_taken(taken, batch_id)
            self.budget.note(taken, seen.get["seq"])

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # The batch is read for its marks, its late rows and its filing.
        rows = judge(batch).persist()
        try:
            origin = self._origin(rows if batch_id == 0 else None)
            rows = place(rows, self.config, origin)
            before = self._open_marks(spark, batch_id - 1)
            self._write(merge_marks(marks(rows).unionByName(before)), "marks", batch_id)
            marked = self._marks(spark, batch_id)
            self._write(self._registry(marked, batch_id), "windows", batch_id)
            windows = self._windows(spark, batch_id)
            filed = assign(rows, marked, windows, self.config)
            # In order of windows, so a later batch reads only the pages of those it closes.
            filed = filed.drop("window_index", "closable").sortWithinPartitions("assigned_window")
            self._write(filed, "readings", batch_id)
        finally:
            rows.unpersist()
        closed = windows.filter(_CLOSED)
        if batch_id > 0:
            done = self._windows(spark, batch_id - 1).filter(_CLOSED)
            closed = closed.join(done, "window_index", "left_anti")
        self._run_windows(closed, batch_id, batch_id)

    def drain(self) -> None:
        """Run the windows still open when the stream ended, as one more batch."""
        last = self.last_batch()
        opened = self._windows(self.spark, last).filter("opened and close_seq is null")
        self._run_windows(opened, last, last + 1)

    def ledger(self) -> DataFrame:
        """Ledger rows of all windows run so far."""
        return self.spark.read.parquet(f"{self.path}/ledger").drop("batch")

    def filed(self) -> DataFrame:
        """All readings with their assigned window and late flag."""
        return self.spark.read.parquet(f"{self.path}/readings")

    def last_batch(self) -> int:
        folders = self.spark.read.parquet(f"{self.path}/marks").select("batch")
        return folders.agg(F.max("batch").alias("batch")).first().batch

    def _taken(self, batch_id: int) -> int:
        """Readings taken up to a batch."""
        if batch_id < 0:
            return 0
        return self.spark.read.parquet(f"{self.path}/taken/batch={batch_id}").first().n

    def _write_taken(self, taken: int, batch_id: int) -> None:
        self._write(self.spark.range(1).select(F.lit(taken).alias("n")), "taken", batch_id)

    def _run_windows(self, chosen: DataFrame, last: int, batch_id: int) -> None:
        """Run the chosen windows over the batches since the first of them."""
        first, low, high = chosen.agg(
            F.min("first_batch"), F.min("window_index"), F.max("window_index")
        ).first()
        if first is None:
            return
        spark = chosen.sparkSession
        folders = [f"{self.path}/readings/batch={b}" for b in range(first, last + 1)]
        stored = spark.read.parquet(*folders).filter(F.col("assigned_window").between(low, high))
        stored = stored.withColumnRenamed("assigned_window", "window_index")
        rows = stored.join(chosen.select("window_index"), "window_index", "left_semi")
        stages = stage_ledger(rows, "window_index")
        contents = window_contents(rows.withColumnRenamed("window_index", "assigned_window"))
        spans = window_spans(contents, self._origin(None), self.config.width_us)
        self._write(stages.unionByName(spans), "ledger", batch_id)
        if self.on_windows is not None:
            self.on_windows(spark.read.parquet(f"{self.path}/ledger/batch={batch_id}"), batch_id)

    def _origin(self, first_batch: DataFrame | None) -> Column:
        """The origin follows from the first reading and is kept from then on."""
        path = f"{self.path}/origin"
        if first_batch is not None:
            origin = find_origin(first_batch, self.config.width_us)
            table = self.spark.range(1).select(origin.alias("origin_us"))
            table.write.mode("overwrite").parquet(path)
        return F.lit(self.spark.read.parquet(path).first().origin_us).cast("bigint")

    def _registry(self, marked: DataFrame, batch_id: int) -> DataFrame:
        """The windows, with the batch in which each was first seen."""
        windows = registry(marked)
        if batch_id == 0:
            return windows.withColumn("first_batch", F.lit(0))
        known = self._windows(marked.sparkSession, batch_id - 1)
        return windows.join(
            known.select("window_index", "first_batch"), "window_index", "left"
        ).withColumn("first_batch", F.coalesce("first_batch", F.lit(batch_id)))

    def _open_marks(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Marks that still matter: from the highest closed window upwards.

        That window alone makes every reading at or below it late, so the state
        does not grow with the age of the stream.
        """
        if batch_id < 0:
            return spark.createDataFrame([], MARKS_SCHEMA)
        closed = self._windows(spark, batch_id).filter(_CLOSED)
        top = closed.agg(F.max("window_index").alias("top")).first().top
        before = self._marks(spark, batch_id)
        return before if top is None else before.filter(F.col("window_index") >= top)

    def _marks(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.schema(MARKS_SCHEMA).parquet(f"{self.path}/marks/batch={batch_id}")

    def _windows(self, spark: SparkSession, batch_id: int) -> DataFrame:
        return spark.read.parquet(f"{self.path}/windows/batch={batch_id}")

    def _write(self, table: DataFrame, name: str, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")


def tumbling_counts(readings: DataFrame, config: StreamConfig, start: str = "0 minutes") -> DataFrame:
    """Rows per window by Spark's own watermark, which drops late rows.

    The cheap mode where lateness does not matter. Windows align to the epoch,
    moved by ``start``.
    """
    width = f"{config.width_us} microseconds"
    return (
        readings.withWatermark("event_time", f"{config.lateness_us} microseconds")
        .groupBy(F.window("event_time", width, width, start))
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.array_sort(F.collect_set("line_id")).alias("lines"),
        )
    )
