"""Moments a minimal distance lets through, against a loop."""

import random

import pytest

from linewarden.operators.spacing import spaced

SCHEMA = "k string, line string, t bigint"


def loop(rows, distance):
    taken, last = [], {}
    for k, line, t in sorted(rows, key=lambda r: r[2]):
        if (k, line) not in last or t - last[k, line] >= distance:
            last[k, line] = t
            taken.append((k, line, t))
    return sorted(taken, key=repr)


def found(spark, rows, distance, shift=4):
    df = spaced(spark.createDataFrame(rows, SCHEMA), ["k", "line"], "t", distance, shift=shift)
    assert df.columns == ["k", "line", "t"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize("distance, steps", [(7, [1, 2, 3, 9]), (20, [1, 1, 5]), (1, [1, 2])])
def test_random_moments(spark, distance, steps):
    """Long sessions and short ones, null keys, times before the epoch."""
    rng, rows, now = random.Random(distance), set(), -500
    for _ in range(500):
        now += rng.choice(steps)
        rows.add((rng.choice("aab"), rng.choice(["x", "x", None]), now))
    assert found(spark, list(rows), distance) == loop(rows, distance)


def test_one_endless_session_needs_few_rounds(spark):
    """Regular times never fall onto one another; chunks thin them out all the same."""
    rows = [("a", "x", 3 * i) for i in range(2000)]
    assert found(spark, rows, 10, shift=6) == loop(rows, 10)


def test_distances_are_met_exactly(spark):
    rows = [("a", None, t) for t in (0, 9, 10, 19, 20, 21, 40)]
    assert [t for *_, t in found(spark, rows, 10)] == [0, 10, 20, 40]


def test_empty_and_single(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [(None, None, 3)], 5) == [(None, None, 3)]
    with pytest.raises(ValueError):
        spaced(spark.createDataFrame([], SCHEMA), ["k"], "t", 0)
