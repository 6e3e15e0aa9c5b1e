"""Streaming jobs over the given tables, run to the end of the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.operators import tags
from linewarden.operators.metrics import LAG_BOUNDS_MS
from linewarden.plans import sql
from linewarden.plans.quality import RUN_CONFIG
from linewarden.plans.registry import query, rounded
from linewarden.plans.sql import BASE, FILED, READINGS, REGISTRY, RUNS, TAG_CHANGES, ctes
from linewarden.schema import StreamConfig
from linewarden.session import new_path, prepare, settle
from linewarden.plans import fixtures
from linewarden.sources.records import judge
from linewarden.sources.segments import land_segments, read_segments
from linewarden.sources.streams import STATE_ROWS, ArrivalRun, land, read_landed
from linewarden.streaming.alerts import deliver, deliver_pending, immediate_alerts
from linewarden.streaming.metrics import MetricRun
from linewarden.streaming.rules import oee_rule
from linewarden.streaming.stateful import assemble_stream, cool_down, watch_silence_by_events
from linewarden.streaming.windows import WindowRun, tumbling_counts


def _readings(spark: SparkSession, sf_dir: str, per_step: int | None = None) -> DataFrame:
    """The events as they would land: in the order of arrival, over several batches."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    path = new_path(spark, "landed")
    files = land(events, "event_id", path, per_step=per_step)
    return fixtures.readings_from(read_landed(spark, events.schema, path, files))


def _landed(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that is there into files, and read them."""
    spark = stream.sparkSession
    path = new_path(spark, label)
    started = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start(path)
    )
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@query(
    ctes(*BASE)
    + "select seq, ts_us, arrival_us, line_id, batch_id, temperature from judged"
)
def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir).select(
        "seq",
        F.unix_micros("event_time").alias("ts_us"),
        F.unix_micros("ingest_time").alias("arrival_us"),
        "line_id",
        "batch_id",
        "temperature",
    )
    return _landed(rows, "stream-scan")


@query(ctes(*BASE) + "select seq, malformed from judged")
def stream_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of the batch job, row by row on a stream."""
    rows = judge(_readings(spark, sf_dir)).select("seq", "malformed")
    return _landed(rows, "stream-malformed")


@query(
    ctes(*BASE, sql.triggers(900_000_000))
    + """select seq, kind, line_id, detail from triggers
where phase in ('breach', 'malformed')"""
)
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = immediate_alerts(_readings(spark, sf_dir), StreamConfig())
    return _landed(rows.select("seq", "kind", "line_id", "detail"), "stream-alerts")


@query(
    ctes(*BASE)
    + """select ts_us - ts_us % 28800000000 as window_start_us, count(*) as n_rows,
  coalesce(string_agg(distinct line_id, ',' order by line_id), '') as lines
from judged group by 1
having window_start_us + 28800000000 <= (select max(ts_us) from judged) - 3600000000"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark of the stream closed."""
    counts = tumbling_counts(_readings(spark, sf_dir), StreamConfig())
    rows = counts.select(
        F.unix_micros("window.start").alias("window_start_us"),
        "n_rows",
        F.array_join("lines", ",").alias("lines"),
    )
    return _landed(rows, "stream-windows")


@query(
    ctes(
        *RUNS,
        REGISTRY,
        FILED,
        sql.ledger(
            "(select * from filed where assigned_window is not null)", "assigned_window"
        ),
    )
    + """select run_index, name, line_id, rows_in, rows_out, rows_dropped, round(oee, 6) as oee
from ledger"""
)
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all windows, closed by the stream or drained at its end."""
    run = WindowRun(spark, new_path(spark, "window-run"), RUN_CONFIG)
    run.start(_readings(spark, sf_dir), available_now=True).awaitTermination()
    run.drain()
    stages = run.ledger().filter(F.col("name") != "stream_window")
    return rounded(
        stages.select(
            "run_index", "name", "line_id", "rows_in", "rows_out", "rows_dropped", "oee"
        )
    )


@query(
    ctes(READINGS, TAG_CHANGES, sql.assembled("tag_changes_flat")).replace(
        "state as (",
        """tag_changes_flat as (
  select seq, 0 as pos, line_id, field, value, source_us, false as is_flush from tag_changes),
state as (""",
    )
    + """select seq, line_id, batch_id, event_us, total_count, good_count, temperature, missing
from batches"""
)
def tag_assembly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches out of a stream of tag changes, with state per line."""
    changes = tags.as_tags(fixtures.tag_changes(_readings(spark, sf_dir, STATE_ROWS)))
    batches = _landed(assemble_stream(changes), "tag-stream")
    return batches.select(
        "seq",
        "line_id",
        "batch_id",
        "event_us",
        "total_count",
        "good_count",
        "temperature",
        F.array_join("missing", ",").alias("missing"),
    )


_COOLED = ctes(
    *BASE,
    sql.triggers(900_000_000).replace("triggers as (", "all_triggers as ("),
    "triggers as (select * from all_triggers where phase in ('breach', 'malformed'))",
    sql.folded(3_600_000_000),
)


@query(_COOLED + "select seq, kind, line_id, detail, suppressed from fires")
def stream_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Immediate alerts of a stream, once per hour for a kind and line."""
    alerts = immediate_alerts(_readings(spark, sf_dir, STATE_ROWS), RUN_CONFIG)
    passed = _landed(cool_down(alerts, RUN_CONFIG.cooldown_us), "stream-cooldown")
    return passed.select("seq", "kind", "line_id", "detail", "suppressed")


@query(_COOLED + "select seq, fired_us, kind, line_id, phase, detail, suppressed from feed")
def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts that a stream delivers, with what the cooldown held at its end."""
    path = new_path(spark, "stream-feed")

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    alerts = cool_down(
        immediate_alerts(_readings(spark, sf_dir, STATE_ROWS), RUN_CONFIG), RUN_CONFIG.cooldown_us
    )
    deliver(alerts, write, f"{path}/checkpoint", availableNow=True).awaitTermination()
    deliver_pending(spark, f"{path}/checkpoint", write)
    return spark.read.schema(alerts.schema).parquet(f"{path}/rows").select(
        "seq",
        F.col("at_us").alias("fired_us"),
        "kind",
        "line_id",
        "phase",
        "detail",
        "suppressed",
    )


_HALF = "(select count(*) // 2 + 7 from events)"
_FIRST = [
    sql.READINGS.replace("readings as (", "every_reading as (", 1),
    f"readings as (select * from every_reading qualify row_number() over (order by seq) <= {_HALF})",
]


@query(
    ctes(
        *_FIRST,
        *RUNS[1:],
        REGISTRY,
        FILED,
        sql.ledger(
            "(select * from filed where assigned_window is not null)", "assigned_window"
        ),
    )
    + """select run_index, name, line_id, rows_in, rows_out, rows_dropped, round(oee, 6) as oee
from ledger"""
)
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of a run that ends after half of its readings, in the middle of a batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    run = WindowRun(spark, new_path(spark, "budget-run"), RUN_CONFIG)
    limit = events.count() // 2 + 7
    run.start(
        _readings(spark, sf_dir), available_now=True, max_readings=limit
    ).awaitTermination()
    run.drain()
    stages = run.ledger().filter(F.col("name") != "stream_window")
    return rounded(
        stages.select(
            "run_index", "name", "line_id", "rows_in", "rows_out", "rows_dropped", "oee"
        )
    )


@query(
    """select cast(row_number() over (order by event_id // 7, event_id % 300, event_id // 300) - 1
    as bigint) as seq,
  cast(event_id % 300 as int) as "partition", cast(event_id // 300 as bigint) as "offset",
  1784505600000 + event_id // 7 as time_ms, concat('plant/', event_type) as topic,
  concat('m', event_id) as payload
from events"""
)
def broker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A broker's log of 300 partitions, read in two starts of one stream, in order of arrival."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    path = new_path(spark, "broker-log")
    # A whole number of milliseconds, so no message of the first part is behind the second.
    cut = events.count() // 14 * 7
    run = ArrivalRun(spark, f"{path}/run")
    for part in (F.col("event_id") < cut, F.col("event_id") >= cut):
        land_segments(fixtures.log_messages(events.where(part)), f"{path}/segments")
        stream = read_segments(spark, f"{path}/segments")
        run.start(stream, available_now=True).awaitTermination()
    return run.rows().select(
        "seq",
        "partition",
        "offset",
        F.unix_millis("time").alias("time_ms"),
        "topic",
        "payload",
    )


@query(
    ctes(*BASE)
    + """, gaps as (
  select line_id, arrival_us, lead(arrival_us) over (partition by line_id order by seq) as next_us,
    (select max(arrival_us) from judged where line_id is not null) as end_us
  from judged where line_id is not null)
select line_id, 'silent' as phase, arrival_us + 900000000 as at_us from gaps
where coalesce(next_us, end_us) > arrival_us + 900000000
union all
select line_id, 'resumed', next_us from gaps where next_us > arrival_us + 900000000"""
)
def stream_silence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silence by the clock of the events, the same in every run."""
    watched = watch_silence_by_events(_readings(spark, sf_dir, STATE_ROWS), 900.0)
    return _landed(watched, "stream-silence")


@query(
    ctes(*BASE)
    + f"""select line_id, count(*) as n_readings, round(sum((arrival_us - ts_us) / 1000), 6)
    as sum_lag_ms, cast(b as bigint) as le_ms,
  count(*) filter ((arrival_us - ts_us) / 1000 <= b) as n_le
from judged, (select unnest({LAG_BOUNDS_MS}) as b) group by line_id, b"""
)
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lag histogram as it stands after the last batch of a stream."""
    run = MetricRun(spark, new_path(spark, "metric-run"))
    run.start(_readings(spark, sf_dir), available_now=True).awaitTermination()
    return rounded(run.lag_histogram())


@query(
    ctes(READINGS, TAG_CHANGES, sql.assembled("tag_changes_flat")).replace(
        "state as (",
        """tag_changes_flat as (
  select seq, 0 as pos, line_id, field, value, source_us, false as is_flush from tag_changes),
state as (""",
    )
    + """select seq, line_id, batch_id, event_us, total_count, good_count, temperature, missing
from batches"""
)
def tag_handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a table's first half, and of a stream that goes on where it ends."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    cut = events.count() // 2
    early = fixtures.readings_from(events.where(F.col("event_id") < cut))
    early = settle(tags.as_tags(fixtures.tag_changes(early)), "early-tags")
    path = new_path(spark, "landed")
    later = events.where(F.col("event_id") >= cut)
    files = land(later, "event_id", path, steps=2, per_step=STATE_ROWS)
    stream = fixtures.readings_from(read_landed(spark, events.schema, path, files))
    stream = tags.as_tags(fixtures.tag_changes(stream))
    held = settle(tags.held_values(early), "held-values")
    followed = _landed(assemble_stream(stream, held=held), "tag-handover")
    both = tags.assemble(early).unionByName(followed)
    return both.select(
        "seq",
        "line_id",
        "batch_id",
        "event_us",
        "total_count",
        "good_count",
        "temperature",
        F.array_join("missing", ",").alias("missing"),
    )


@query(
    ctes(*BASE, sql.oee("judged", "ts_us - ts_us % 60000000 as step_us, line_id"))
    + """select * from (
  select step_us - k * 60000000 as eval_start_us, step_us - k * 60000000 + 300000000 as eval_end_us,
    line_id, count(*) as breaching_steps
  from result, (select unnest(range(5)) as k) where oee < 0.65 group by all)
where eval_end_us <= (select max(ts_us) from judged where line_id is not null) - 3600000000"""
)
def stream_rule_oee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of the OEE floor that the watermark of a stream has closed."""
    fired = oee_rule(_readings(spark, sf_dir), StreamConfig())
    return _landed(fired, "stream-rule")
