"""Immediate alerts from a stream of readings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.operators.alerts import reading_triggers, silence_events
from linewarden.operators.ledger import alert_spans
from linewarden.schema import StreamConfig
from linewarden.sources.records import judge
from linewarden.sources.sinks import write_ledger
from linewarden.streaming.budget import Gate, LimitedRun, RunBudget
from linewarden.streaming.stateful import pending_alerts, watch_silence

OnAlerts = Callable[[DataFrame, int], None]


def immediate_alerts(readings: DataFrame, config: StreamConfig) -> DataFrame:
    """Hot and malformed readings as they arrive; a projection without state."""
    return reading_triggers(judge(readings), config)


def all_alerts(readings: DataFrame, config: StreamConfig, threshold_s: float) -> DataFrame:
    """Hot and malformed readings, silence and recovery, as one stream of events.

    Pass it to ``streaming.stateful.cool_down``, or deliver it as it is.
    """
    watched = silence_events(watch_silence(readings, threshold_s), threshold_s)
    return immediate_alerts(readings, config).unionByName(watched)


def into_ledger(path: str) -> OnAlerts:
    """A callback for ``deliver`` that appends the alerts of a batch to the ledger."""

    def write(alerts: DataFrame, batch: int) -> None:
        held = [] if "suppressed" in alerts.columns else [F.lit(0).cast("bigint").alias("suppressed")]
        rows = alerts.select("*", *held).withColumnRenamed("at_us", "fired_us")
        write_ledger(alert_spans(rows), f"{path}/batch={batch}", mode="overwrite")

    return write


def deliver(
    alerts: DataFrame,
    on_alerts: OnAlerts,
    checkpoint: str,
    *,
    budget: RunBudget | None = None,
    **trigger,
) -> LimitedRun:
    """Hand every batch of alerts to a callback.

    The batch is kept while the callback runs, so it may have several actions. ``budget``
    counts the readings that were passed through its ``watch``. What a cooldown holds at the end
    is delivered by ``deliver_pending``.
    """
    gate = Gate()

    def handle(rows: DataFrame, batch: int) -> None:
        with gate.admit(batch):
            rows = rows.persist()
            try:
                on_alerts(rows, batch)
            finally:
                rows.unpersist()

    writer = (
        alerts.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
    )
    return LimitedRun(writer.start, gate, budget or RunBudget(), alerts.sparkSession)


def deliver_pending(spark: SparkSession, checkpoint: str, on_alerts: OnAlerts) -> int:
    """Hand over what the cooldown of a stopped stream holds, as one more batch.

    Returns the number of that batch, the one after the last committed.
    """
    last = spark.read.format("state-metadata").load(checkpoint).agg(F.max("maxBatchId")).first()[0]
    on_alerts(pending_alerts(spark, checkpoint), last + 1)
    return last + 1
