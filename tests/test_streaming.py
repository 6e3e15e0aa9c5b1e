"""Streams over several files against the same job over the whole table."""

import time

import pytest
from pyspark.sql import functions as F

from linewarden.operators import tags
from linewarden.operators.alerts import alert_feed, reading_triggers
from linewarden.operators.ledger import stage_ledger
from linewarden.operators.windows import assigned
from linewarden.schema import READING_SCHEMA, StreamConfig
from linewarden.session import prepare
from linewarden.plans import fixtures
from linewarden.sources.records import judge
from linewarden.sources.streams import read_readings
from linewarden.streaming.alerts import deliver, immediate_alerts
from linewarden.streaming.stateful import (
    assemble_stream,
    cool_down,
    held_alerts,
    pending_alerts,
    watch_silence,
)
from linewarden.streaming.windows import WindowRun


@pytest.fixture(scope="module")
def landed(spark, sf_dir, tmp_path_factory):
    """Readings in four files that arrive in order of ``seq``."""
    folder = str(tmp_path_factory.mktemp("landed"))
    rows = fixtures.readings(prepare(spark), sf_dir).cache()
    for part in range(4):
        piece = rows.filter(F.floor(F.col("seq") / 250) == part)
        piece.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return folder


def test_window_run_equals_replay(spark, landed, tmp_path):
    config = StreamConfig(window_min=120, allowed_lateness_min=5)
    seen = []
    run = WindowRun(
        spark, str(tmp_path / "run"), config, on_windows=lambda rows, b: seen.append(b)
    )
    stream = read_readings(spark, landed, files_per_trigger=1)
    run.start(stream, available_now=True).awaitTermination()
    run.drain()
    whole = judge(spark.read.schema(READING_SCHEMA).parquet(landed))
    filed = assigned(whole, config).cache()
    assert filed.filter("late").count() > 0
    wanted = {(r.seq, r.late, r.assigned_window) for r in filed.collect()}
    assert {(r.seq, r.late, r.assigned_window) for r in run.filed().collect()} == wanted
    columns = ["run_index", "line_id", "name", "rows_in", "rows_out", "stale_batch", "oee"]
    batch = stage_ledger(filed.filter("assigned_window is not null"), "assigned_window")
    got = run.ledger().filter("name <> 'stream_window'").select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(
        map(tuple, batch.select(*columns).collect()), key=repr
    )
    windows = run.ledger().filter("name = 'stream_window'")
    rows = windows.agg(F.sum(F.col("attrs")["window.rows"].cast("int"))).first()[0]
    assert rows == sum(1 for _, _, w in wanted if w is not None)
    assert len(seen) >= 3 and seen == sorted(seen)


def test_a_batch_that_runs_again_changes_nothing(spark, landed, tmp_path):
    config = StreamConfig(window_min=120, allowed_lateness_min=5)
    run = WindowRun(spark, str(tmp_path / "run"), config)
    rows = spark.read.schema(READING_SCHEMA).parquet(landed)
    for batch_id, cut in enumerate([(0, 400), (400, 2000)]):
        piece = rows.filter(F.col("seq").between(cut[0], cut[1] - 1))
        run.process(piece, batch_id)
        once = run.ledger().count(), run.filed().count()
        run.process(piece, batch_id)
        assert (run.ledger().count(), run.filed().count()) == once


def test_tag_stream_equals_replay(spark, landed, tmp_path):
    stream = tags.as_tags(fixtures.tag_changes(read_readings(spark, landed, files_per_trigger=1)))
    out = str(tmp_path / "out")
    batches = assemble_stream(stream)
    batches.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    whole = tags.as_tags(fixtures.tag_changes(spark.read.schema(READING_SCHEMA).parquet(landed)))
    columns = ["seq", "line_id", "batch_id", "event_us", "total_count", "temperature", "missing"]
    got = spark.read.schema(batches.schema).parquet(out).select(*columns).collect()
    want = tags.assemble(whole).select(*columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def test_alerts_reach_the_callback(spark, landed, tmp_path):
    counts = []
    alerts = immediate_alerts(read_readings(spark, landed), StreamConfig())
    deliver(
        alerts, lambda rows, _: counts.append(rows.count()), str(tmp_path / "c"), availableNow=True
    ).awaitTermination()
    whole = judge(spark.read.schema(READING_SCHEMA).parquet(landed))
    bad = whole.filter("malformed").count() + whole.filter("temperature > 85").count()
    assert sum(counts) == bad


def test_cooldown_stream_equals_replay(spark, landed, tmp_path):
    config = StreamConfig()
    out, cooldown = str(tmp_path / "out"), 3600 * 1_000_000
    alerts = cool_down(
        immediate_alerts(read_readings(spark, landed, files_per_trigger=1), config), cooldown
    )
    alerts.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    whole = judge(spark.read.schema(READING_SCHEMA).parquet(landed))
    feed = alert_feed(reading_triggers(whole, config), cooldown).collect()
    want = {(r.seq, r.kind, r.line_id, r.suppressed) for r in feed if r.phase != "pending"}
    got = spark.read.schema(alerts.schema).parquet(out).collect()
    assert {(r.seq, r.kind, r.line_id, r.suppressed) for r in got} == want and want
    held = {(r.kind, r.line_id, r.suppressed) for r in feed if r.phase == "pending"}
    left = held_alerts(spark, f"{out}-c").collect()
    assert {(r.kind, r.line_id, r.suppressed) for r in left} == held
    last = {(r.kind, r.line_id, r.fired_us) for r in feed if r.phase == "pending"}
    assert {(r.kind, r.line_id, r.at_us) for r in pending_alerts(spark, f"{out}-c").collect()} == last


def test_silence_fires_without_any_arrival(spark, landed, tmp_path):
    found = []
    query = (
        watch_silence(read_readings(spark, landed), threshold_s=2.0)
        .writeStream.foreachBatch(lambda rows, _: found.extend(rows.collect()))
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        end = time.time() + 90
        while time.time() < end and not any(r.phase == "silent" for r in found):
            time.sleep(0.5)
    finally:
        query.stop()
    silent = {r.line_id for r in found if r.phase == "silent"}
    assert "line_1" in silent
    assert all(r.quiet_s >= 2.0 for r in found if r.phase == "silent")


def test_silence_shares_the_feed_and_reaches_the_ledger(spark, landed, tmp_path):
    from linewarden.sources.sinks import read_ledger
    from linewarden.streaming.alerts import all_alerts, into_ledger

    path, found = str(tmp_path / "ledger"), []
    write = into_ledger(path)

    def on_alerts(rows, batch):
        write(rows, batch)
        found.extend((r.kind, r.phase, r.detail) for r in rows.collect())

    events = all_alerts(read_readings(spark, landed), StreamConfig(), threshold_s=2.0)
    running = deliver(events, on_alerts, str(tmp_path / "checkpoint"))
    try:
        until = time.time() + 90
        while time.time() < until and not any(f[1] == "silent" for f in found):
            time.sleep(0.2)
    finally:
        running.stop()
    assert not running.isActive and running.awaitTermination(5)
    assert {"line_silent", "malformed_reading"} <= {f[0] for f in found}
    stored = read_ledger(spark, path).collect()
    assert {"line_silent", "malformed_reading"} <= {r.attrs["alert.kind"] for r in stored}
    # Every alert has a name of its own, silences of one line too.
    assert len({r.span_id for r in stored}) == len(stored) >= len(found)


def test_a_run_takes_its_readings_and_no_more(spark, landed, tmp_path):
    """Equal to a replay of the first readings; a batch that runs again counts once."""
    config = StreamConfig(window_min=120, allowed_lateness_min=5)
    run = WindowRun(spark, str(tmp_path / "run"), config)
    stream = read_readings(spark, landed, files_per_trigger=1)
    limited = run.start(stream, available_now=True, max_readings=333)
    limited.awaitTermination()
    assert limited.reason == "readings" and not limited.isActive
    run.drain()
    whole = spark.read.schema(READING_SCHEMA).parquet(landed).orderBy("seq").limit(333)
    filed = assigned(judge(whole), config).collect()
    wanted = {(r.seq, r.late, r.assigned_window) for r in filed}
    assert {(r.seq, r.late, r.assigned_window) for r in run.filed().collect()} == wanted
    assert (run.budget.taken, run.budget.last_seq) == (333, max(r.seq for r in filed))
    again = WindowRun(spark, str(tmp_path / "run"), config)
    more = again.start(stream, available_now=True, max_readings=333)
    more.awaitTermination()
    assert run.filed().count() == 333


def test_a_run_ends_in_time_between_two_batches(spark, landed, tmp_path):
    """What a stopped run has not taken, the next start takes."""
    config = StreamConfig(window_min=120, allowed_lateness_min=5)
    run = WindowRun(spark, str(tmp_path / "run"), config)
    stream = read_readings(spark, landed, files_per_trigger=1)
    limited = run.start(stream, every="0 seconds", max_seconds=0.5)
    limited.awaitTermination(120)
    assert limited.reason == "seconds"
    # No batch was cut: all tables of the last one are there.
    if limited.gate.entered >= 0:
        assert run.last_batch() == limited.gate.entered
        assert run.filed().count() == run.budget.taken
    run = WindowRun(spark, str(tmp_path / "run"), config)
    run.start(stream, available_now=True).awaitTermination()
    whole = spark.read.schema(READING_SCHEMA).parquet(landed)
    assert run.filed().count() == whole.count() == run.filed().select("seq").distinct().count()


def test_alerts_stop_at_a_boundary_and_the_rest_is_delivered(spark, landed, tmp_path):
    from linewarden.streaming.alerts import deliver_pending
    from linewarden.streaming.budget import RunBudget

    config, rows = StreamConfig(), {}
    budget = RunBudget(readings=400)
    readings = budget.watch(read_readings(spark, landed, files_per_trigger=1))
    alerts = cool_down(immediate_alerts(readings, config), 3600 * 1_000_000)
    checkpoint = str(tmp_path / "c")

    def note(batch_rows, batch):
        assert batch_rows.count() >= 0  # a second action over the same batch
        rows[batch] = batch_rows.collect()

    running = deliver(alerts, note, checkpoint, budget=budget, processingTime="2 seconds")
    running.awaitTermination(120)
    assert running.reason == "readings" and budget.taken >= 400
    last = deliver_pending(spark, checkpoint, note)
    assert last == max(rows) and set(rows) == set(range(last + 1))
    whole = spark.read.schema(READING_SCHEMA).parquet(landed)
    seen = judge(whole.filter(F.col("seq") <= budget.last_seq))
    feed = alert_feed(reading_triggers(seen, config), 3600 * 1_000_000).collect()
    want = {(r.seq, r.fired_us, r.kind, r.line_id, r.phase, r.suppressed) for r in feed}
    got = [r for b in rows.values() for r in b]
    assert {(r.seq, r.at_us, r.kind, r.line_id, r.phase, r.suppressed) for r in got} == want


def test_budget_limits():
    from linewarden.streaming.budget import Gate, RunBudget, StopRequested

    now = [10.0]
    budget = RunBudget(readings=5, seconds=3, clock=lambda: now[0])
    budget.begin()
    assert budget.spent() is None
    now[0] = 13.0
    assert budget.spent() == "seconds"
    budget.note(5, 9)
    budget.note(6, 4)
    assert budget.spent() == "readings" and budget.last_seq == 9
    assert RunBudget().spent() is None
    with pytest.raises(ValueError):
        RunBudget(readings=-1)
    gate = Gate()
    with gate.admit(3):
        pass
    gate.close()
    with pytest.raises(StopRequested):
        gate.admit(4)
    assert gate.entered == 3


def test_broker_log_restarts_and_numbers_every_message(spark, tmp_path):
    """Many messages of one millisecond, more than one segment, a gap that is filled later."""
    from linewarden.sources import segments
    from linewarden.sources.streams import ArrivalRun, numbered

    rows = [
        (p, o, 1000 + o // 3, f"m{p}-{o}") for p in range(300) for o in range(3 + p % 4)
    ] + [(300, o, 1001, f"m300-{o}") for o in range(20_000)]
    df = spark.createDataFrame(rows, "partition int, offset long, ms long, payload string").select(
        "partition", "offset", F.timestamp_millis("ms").alias("time"), F.lit("t").alias("topic"), "payload"
    )
    path = str(tmp_path / "log")
    log = f"file://{path}"
    late = F.col("partition").between(250, 299) & (F.col("offset") >= 2)
    early = df.where(~late)
    n = segments.land_segments(early, log)
    assert n == len(segments.listing(log)) and segments.ends(segments.listing(log))["299"] == 2
    run = ArrivalRun(spark, str(tmp_path / "run"))
    run.start(segments.read_segments(spark, log), available_now=True).awaitTermination()
    first = {(r.partition, r.offset): r.seq for r in run.rows().collect()}
    assert len(first) == early.count()
    segments.land_segments(df.where(late), log)
    run = ArrivalRun(spark, str(tmp_path / "run"))
    run.start(segments.read_segments(spark, log), available_now=True).awaitTermination()
    rows_now = run.rows().collect()
    assert sorted(r.seq for r in rows_now) == list(range(len(rows)))
    assert {k: v for k, v in first.items()} == {
        (r.partition, r.offset): r.seq for r in rows_now if r.seq < len(first)
    }
    in_order = sorted((r for r in rows_now if r.seq < len(first)), key=lambda r: r.seq)
    assert [(r.time, r.partition, r.offset) for r in in_order] == sorted(
        (r.time, r.partition, r.offset) for r in in_order
    )
    assert {r.payload for r in rows_now} == {r[3] for r in rows}
    table = segments.segment_table(spark, log)
    assert table.count() == len(rows)
    assert numbered(table.limit(0)).count() == 0
    # A batch that runs again leaves the same numbers.
    run.process(early, 0)
    assert {(r.partition, r.offset): r.seq for r in run.rows().collect() if r.seq < len(first)} == first


def test_a_missing_segment_holds_its_partition_back(tmp_path):
    from linewarden.sources import segments

    found = [(0, 0, 5, "a"), (0, 9, 2, "b"), (1, 0, 3, "c"), (1, 3, 4, "d"), (2, 1, 1, "e")]
    assert segments.ends(found) == {"0": 5, "1": 7}
    assert segments.listing(f"file://{tmp_path}/none") == []


@pytest.mark.parametrize("files", [1, 3])
def test_silence_by_events_does_not_depend_on_batches(spark, tmp_path, files):
    import random

    from linewarden.streaming.stateful import watch_silence_by_events

    rng, now, rows = random.Random(4), 0, []
    for seq in range(240):
        now += rng.choice([0, 1, 2, 30])
        rows.append((seq, rng.choice(["a", "a", "b", None]) if seq < 200 else "a", now))
    folder = str(tmp_path / "in")
    for part in range(files):
        piece = [r for r in rows if r[0] * files // 240 == part]
        df = spark.createDataFrame(piece, "seq long, line_id string, s long")
        df = df.select("seq", "line_id", F.timestamp_seconds("s").alias("ingest_time"))
        df.coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema("seq long, line_id string, ingest_time timestamp")
    stream = stream.option("maxFilesPerTrigger", 1).parquet(folder)
    out = str(tmp_path / "out")
    watched = watch_silence_by_events(stream, 60.0)
    watched.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    want, last = [], {}
    for _, line, at in rows:
        if line is not None:
            if line in last and at - last[line] > 60:
                want += [(line, "silent", last[line] + 60), (line, "resumed", at)]
            last[line] = at
    end = max(last.values())
    want += [(line, "silent", at + 60) for line, at in last.items() if end - at > 60]
    got = spark.read.schema(watched.schema).parquet(out).collect()
    assert sorted((r.line_id, r.phase, r.at_us // 1_000_000) for r in got) == sorted(want) and want


def test_metrics_of_a_stream_equal_those_of_the_table(spark, landed, tmp_path):
    from linewarden.operators import metrics
    from linewarden.operators.windows import place
    from linewarden.streaming.metrics import MetricRun

    run = MetricRun(spark, str(tmp_path / "m"))
    run.start(read_readings(spark, landed, files_per_trigger=1), available_now=True).awaitTermination()
    rows = spark.read.schema(READING_SCHEMA).parquet(landed)
    placed = place(rows, StreamConfig(), F.lit(0).cast("bigint"))

    def same(a, b):
        return sorted(map(repr, a.select(*b.columns).collect())) == sorted(map(repr, b.collect()))

    assert same(run.received(), metrics.readings_received(rows))
    assert same(run.lag_histogram(), metrics.lag_histogram(placed))
    assert same(run.latest_temperature(), metrics.latest_temperature(rows))
    assert same(run.peak_lag(), metrics.peak_lag(placed))
    run.process(rows.limit(0), 4)
    assert same(run.received(), metrics.readings_received(rows))


def test_a_stream_goes_on_where_a_table_ends(spark, landed, tmp_path):
    whole = tags.as_tags(fixtures.tag_changes(spark.read.schema(READING_SCHEMA).parquet(landed)))
    cut = whole.filter("seq < 4000")
    stream = tags.as_tags(fixtures.tag_changes(read_readings(spark, landed, files_per_trigger=1)))
    out = str(tmp_path / "out")
    batches = assemble_stream(stream.filter("seq >= 4000"), held=tags.held_values(cut))
    batches.writeStream.format("parquet").option("checkpointLocation", f"{out}-c").trigger(
        availableNow=True
    ).start(out).awaitTermination()
    got = spark.read.schema(batches.schema).parquet(out)
    both = tags.assemble(cut).unionByName(got).collect()
    assert sorted(map(repr, both)) == sorted(map(repr, tags.assemble(whole).select(*batches.columns).collect()))
