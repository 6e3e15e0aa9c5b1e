"""Streams of readings: landed files, a broker log, or any other source."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linewarden.schema import READING_SCHEMA
from linewarden.session import settle
from linewarden.streaming.budget import Gate, LimitedRun, RunBudget


def read_readings(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Readings as their files land; ``files_per_trigger`` bounds a batch."""
    reader = spark.readStream.schema(READING_SCHEMA).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


#: Rows of a landed file: small enough that a batch of a million is read by several tasks.
FILE_ROWS = 1 << 17
#: Readings of a batch whose lines each come together in one Python task.
STATE_ROWS = 1 << 21


def land(
    rows: DataFrame,
    order: str,
    path: str,
    steps: int = 4,
    per_file: int = FILE_ROWS,
    per_step: int | None = None,
) -> int:
    """Write rows in the order of a number, a range of it at a time.

    Every range becomes equally many files, which this returns: a stream that takes so
    many at a time gets the ranges one by one. ``per_step`` rows of a gapless number are the
    most of a range, however many ranges that takes.
    """
    low, high, n = rows.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    steps = max(steps, -(-n // per_step)) if per_step else steps
    files = max(1, -(-n // (steps * per_file)))
    low, high = low or 0, high or 0
    for k in range(steps):
        begin, end = (low + (high + 1 - low) * i // steps for i in (k, k + 1))
        part = rows.where((F.col(order) >= begin) & (F.col(order) < end))
        part.repartition(files).write.mode("append").parquet(path)
    return files


def read_landed(spark: SparkSession, schema: T.StructType, path: str, files: int) -> DataFrame:
    """A stream over landed files, so many in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


ARRIVAL = ("time", "partition", "offset")


def numbered(messages: DataFrame, start: int = 0, order: tuple[str, ...] = ARRIVAL) -> DataFrame:
    """Add ``seq``: ``start`` and on, without a gap, in the order of a log's messages.

    All partitions are merged by time, then partition and offset. That is a sort over
    ranges of the order, in which each task numbers its own rows behind those of the tasks
    before it; the only totals are one row per task.
    """
    placed = messages.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper bits are the task, the lower 33 the row in it.
    placed = settle(placed.withColumn("_place", F.monotonically_increasing_id()), "arrivals")
    task = F.shiftright("_place", 33).alias("_task")
    sizes = placed.groupBy(task).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_task", F.shiftright("_place", 33))
    own = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = rows.join(settle(starts, "task-starts"), "_task")
    return joined.select(
        (F.lit(start) + F.col("_before") + own).alias("seq"),
        *[joined[c] for c in messages.columns],
    )


class ArrivalRun:
    """Files a stream of log messages with their arrival numbers, below ``path``.

    A batch goes to a folder of its own number, with the count of all messages up to it, so
    a batch that runs again gives the same numbers.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.gate: Gate | None = None

    def start(self, messages: DataFrame, *, available_now: bool = False, every: str = "10 seconds"):
        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        self.gate = Gate()
        writer = (
            messages.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**trigger)
        )
        return LimitedRun(writer.start, self.gate, RunBudget(), self.spark)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        with self.gate.admit(batch_id) if self.gate else nullcontext():
            before = 0
            if batch_id > 0:
                before = self.spark.read.parquet(f"{self.path}/taken/batch={batch_id - 1}").first().n
            seen = Observation()
            rows = numbered(batch, before).observe(seen, F.count(F.lit(1)).alias("n"))
            rows.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch_id}")
            total = self.spark.range(1).select(F.lit(before + seen.get["n"]).alias("n"))
            total.write.mode("overwrite").parquet(f"{self.path}/taken/batch={batch_id}")

    def rows(self) -> DataFrame:
        """All messages filed so far, with ``seq``."""
        return self.spark.read.parquet(f"{self.path}/rows").drop("batch")


def read_broker_log(spark: SparkSession, servers: str, topics: list[str], **options) -> DataFrame:
    """Messages of a broker, in the shape of ``segments.SCHEMA``.

    A broker's message has no number of its own over all partitions: ``ArrivalRun`` gives
    it one. The Kafka package must be on the class path.
    """
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
        .options(**options)
        .load()
    )
    return raw.select(
        "partition",
        "offset",
        F.col("timestamp").alias("time"),
        F.coalesce(F.col("key").cast("string"), F.col("topic")).alias("topic"),
        F.col("value").cast("string").alias("payload"),
    )
