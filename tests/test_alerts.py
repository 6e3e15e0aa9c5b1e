"""Silence and cooldown against loops over the arrivals."""

import random

import pytest
from pyspark.sql import functions as F

from linewarden.operators.alerts import alert_feed, silence_triggers

US = 1_000_000


def silence_loop(arrivals, threshold):
    last, silent, out = {}, set(), []
    for seq, line, now in arrivals:
        last[line] = now
        if line in silent:
            silent.discard(line)
            out.append((seq, "resumed", line))
        for other, seen in last.items():
            if now - seen > threshold and other not in silent:
                silent.add(other)
                out.append((seq, "silent", other))
    return sorted(out, key=repr)


def silences(spark, arrivals, threshold, **shifts):
    rows = [(s, line, t * US) for s, line, t in arrivals]
    df = spark.createDataFrame(rows, "seq bigint, line_id string, ingest_us bigint")
    got = silence_triggers(df, threshold, **shifts).collect()
    return sorted(((r.seq, r.phase, r.line_id) for r in got), key=repr)


def test_fires_once_and_recovers(spark):
    arrivals = [(0, "a", 0), (1, "b", 3), (2, "b", 10), (3, "b", 20), (4, "a", 21), (5, "a", 22)]
    assert silences(spark, arrivals, 5) == silence_loop(arrivals, 5)
    assert (2, "silent", "a") in silences(spark, arrivals, 5)


@pytest.mark.parametrize("seed", range(5))
def test_random_silence(spark, seed):
    rng, now, arrivals = random.Random(seed), 0, []
    for seq in range(250):
        now += rng.choice([0, 1, 1, 2, 15])
        arrivals.append((seq, rng.choice(["a", "a", "a", "b", "c", None]), now))
    for threshold in (3, 12):
        got = silences(spark, arrivals, threshold, seq_shift=4, time_shift=24)
        assert got == silence_loop(arrivals, threshold)


def gate_loop(events, cooldown):
    last, held, fires = {}, {}, []
    for seq, key, t in events:
        if key in last and t - last[key] < cooldown:
            held[key] = held.get(key, 0) + 1
            continue
        last[key] = t
        fires.append((seq, key, held.pop(key, 0)))
    return sorted(fires, key=repr), sorted(held.items(), key=repr)


def gate(spark, events, cooldown, **options):
    rows = [(s, t, 0, k[0], "breach", k[1], "x", float(s)) for s, k, t in events]
    schema = (
        "seq bigint, at_us bigint, trigger_rank int, kind string, phase string, "
        "line_id string, detail string, value double"
    )
    feed = alert_feed(spark.createDataFrame(rows, schema), cooldown, **options).collect()
    fires = [(r.seq, (r.kind, r.line_id), r.suppressed) for r in feed if r.phase != "pending"]
    held = [((r.kind, r.line_id), r.suppressed) for r in feed if r.phase == "pending"]
    return sorted(fires, key=repr), sorted(held, key=repr)


def test_cooldown_carries_the_count(spark):
    events = [(0, ("k", "a"), 0), (1, ("k", "a"), 500), (2, ("k", "a"), 1000), (3, ("k", "a"), 3000)]
    assert gate(spark, events, 2000) == ([(0, ("k", "a"), 0), (3, ("k", "a"), 2)], [])


def test_lines_and_kinds_are_apart(spark):
    events = [(i, (k, line), i) for i, (k, line) in enumerate([("k", "a"), ("k", "b"), ("j", "a")])]
    assert len(gate(spark, events, 1000)[0]) == 3


@pytest.mark.parametrize("seed", range(4))
def test_random_cooldown(spark, seed):
    rng, now, events = random.Random(seed), -300, []
    for seq in range(400):
        now += rng.choice([0, 0, 1, 2, 3, 9])
        events.append((seq, (rng.choice("kkj"), rng.choice(["a", None])), now))
    for cooldown, shift in ((7, 4), (7, 6), (20, 4), (1, 3)):
        got = gate(spark, events, cooldown, shift=shift)
        assert got == gate_loop(events, cooldown)


def test_no_cooldown_fires_all(spark):
    events = [(i, ("k", "a"), 0) for i in range(3)]
    assert len(gate(spark, events, 0)[0]) == 3


def test_pending_text(spark):
    rows = [(i, i, 0, "k", "breach", "a", "x", None) for i in range(4)]
    schema = (
        "seq bigint, at_us bigint, trigger_rank int, kind string, phase string, "
        "line_id string, detail string, value double"
    )
    feed = alert_feed(spark.createDataFrame(rows, schema), 100)
    row = feed.filter(F.col("phase") == "pending").first()
    assert row.detail == "3 further occurrence(s) suppressed by cooldown"
    assert (row.suppressed, row.seq) == (3, None)


def test_the_clock_is_an_argument(spark):
    """The same triggers by another column of microseconds."""
    from linewarden.operators.alerts import triggers
    from linewarden.schema import StreamConfig

    rows = [(i, "a", f"b{i}", 90.0 if i == 2 else 20.0, i == 1, i * US, i * 100 * US) for i in range(4)]
    df = spark.createDataFrame(
        rows, "seq bigint, line_id string, batch_id string, temperature double, malformed boolean, "
        "arrival_us bigint, ts_us bigint"
    )
    slow = {(r.seq, r.kind): r.at_us for r in triggers(df, StreamConfig(), 50.0).collect()}
    assert slow == {(2, "threshold_breach"): 2 * US, (1, "malformed_reading"): US}
    # The line's own return ends each gap, so no silence is noticed by this clock either.
    by_event = triggers(df, StreamConfig(), 50.0, clock="ts_us").collect()
    assert {(r.seq, r.kind): r.at_us for r in by_event} == {k: 100 * v for k, v in slow.items()}
