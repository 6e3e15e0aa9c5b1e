"""Windows against a loop over the arrivals, on hand-made and random orders."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from linewarden.functions.clocks import aligned_origin
from linewarden.operators import windows
from linewarden.schema import READING_SCHEMA, StreamConfig

BASE = datetime(2026, 7, 20)


def readings(spark, minutes, lines=None):
    rows = [
        (i, BASE + timedelta(minutes=m), BASE + timedelta(minutes=10_000 + i),
         (lines or ["line_1"] * len(minutes))[i], f"b{i}", 60.0, 5.0, 2.0, "100", "90", 70.0)
        for i, m in enumerate(minutes)
    ]
    return spark.createDataFrame(rows, READING_SCHEMA)


def loop(minutes, width, lateness):
    """Per arrival (late, window); per window its closing arrival or None."""
    open_at, closed_at, top, newest, out = {}, {}, None, None, []
    for i, m in enumerate(minutes):
        w = m // width
        if top is not None and w <= top:
            out.append((True, min(open_at) if open_at else None))
            continue
        open_at.setdefault(w, i)
        out.append((False, w))
        newest = m if newest is None else max(newest, m)
        for done in sorted(x for x in open_at if (x + 1) * width <= newest - lateness):
            del open_at[done]
            closed_at[done] = i
            top = done if top is None else max(top, done)
    closed_at.update({w: None for w in open_at})
    return out, closed_at


def run(spark, minutes, width, lateness):
    config = StreamConfig(window_min=width, allowed_lateness_min=lateness)
    rows = windows.place(readings(spark, minutes), config, F.lit(_us(BASE)).cast("bigint"))
    marked = windows.marks(rows).cache()
    opened = windows.registry(marked).cache()
    filed = windows.assign(rows, marked, opened, config)
    got = [(r.late, r.assigned_window) for r in filed.orderBy("seq").collect()]
    closes = {r.window_index: r.close_seq for r in windows.window_closes(opened).collect()}
    return got, closes


def _us(moment):
    return int((moment - datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize(
    "minutes, width, lateness, closes",
    [
        ([0, 30, 59], 60, 0, {0: None}),
        ([0, 60], 60, 0, {0: 1, 1: None}),
        ([0, 70, 55, 95], 60, 30, {0: 3, 1: None}),
        ([0, 60, 30], 60, 0, {0: 1, 1: None}),
        ([0, 65, 130, 200, 320], 60, 120, {0: 3, 1: 4, 2: 4, 3: None, 5: None}),
        ([0, -90], 60, 0, {-2: 1, 0: None}),
    ],
)
def test_hand_made(spark, minutes, width, lateness, closes):
    got, found = run(spark, minutes, width, lateness)
    assert found == closes
    assert (got, found) == loop(minutes, width, lateness)


def test_late_row_counts_in_the_oldest_open_window(spark):
    got, _ = run(spark, [0, 60, 30], 60, 0)
    assert got == [(False, 0), (False, 1), (True, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_random_orders(spark, seed):
    rng = random.Random(seed)
    width, lateness = rng.choice([(10, 0), (10, 15), (7, 3), (5, 40), (60, 10), (3, 3)])
    now, minutes = 0, []
    for _ in range(150):
        now += rng.choice([0, 1, 2, 3, 30]) if rng.random() < 0.9 else 90
        minutes.append(now - rng.choice([0, 0, 1, 5, 20, 60, 200]))
    assert run(spark, minutes, width, lateness) == loop(minutes, width, lateness)


def test_contents_lose_nothing(spark):
    minutes = [0, 61, 20, 130, 10, 200, 90, 400]
    config = StreamConfig(window_min=60, allowed_lateness_min=0)
    filed = windows.assigned(readings(spark, minutes, ["a", "b"] * 4), config)
    contents = windows.window_contents(filed).collect()
    assert sum(r.n_rows for r in contents) == len(minutes)
    assert sum(r.late_rows for r in contents) == sum(l for l, _ in loop(minutes, 60, 0)[0])


@pytest.mark.parametrize(
    "minute, width, start", [(557, 480, 480), (5, 480, 0), (557, 420, 420), (1439, 1440, 0)]
)
def test_aligned_origin(spark, minute, width, start):
    first = F.lit(_us(BASE + timedelta(minutes=minute))).cast("bigint")
    got = spark.range(1).select(aligned_origin(first, width * 60_000_000).alias("o")).first().o
    assert got == _us(BASE + timedelta(minutes=start))


def test_width_must_be_positive():
    with pytest.raises(ValueError):
        StreamConfig(window_min=0)


def test_watermark_over_blocks(spark):
    minutes = [0, 5, 3, 9, 2, 30, 8]
    config = StreamConfig(window_min=60, allowed_lateness_min=1)
    rows = windows.place(readings(spark, minutes), config)
    got = windows.watermark_trace(rows, config, shift=1).orderBy("seq").collect()
    newest = [max(minutes[: i + 1]) for i in range(len(minutes))]
    assert [r.watermark_us for r in got] == [
        _us(BASE + timedelta(minutes=m - 1)) for m in newest
    ]
