"""The blocked scans against plain loops on random data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linewarden.operators.ordered import Running, as_of, running
from linewarden.operators.quantiles import exact_quantile


def _rows(seed, n=400):
    rng = random.Random(seed)
    places = rng.sample(range(-200, 3000), n)
    return [
        (rng.choice(["a", "a", "a", "b", None]), p, rng.choice([None, rng.randint(0, 99)]))
        for p in places
    ]


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("how", ["last", "min", "max", "sum"])
def test_running_matches_a_loop(spark, how, reverse):
    rows = _rows(7)
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = running(df, ["k"], "o", [Running("r", F.col("v"), how)], reverse=reverse, shift=5)
    state, want = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1], reverse=reverse):
        want[(k, o)] = state.get(k)
        if v is not None:
            old = state.get(k)
            state[k] = (
                v
                if how == "last" or old is None
                else {"min": min, "max": max, "sum": lambda a, b: a + b}[how](old, v)
            )
    assert {(r.k, r.o): r.r for r in got.collect()} == want
    assert got.columns == ["k", "o", "v", "r"]


def test_struct_lets_null_replace_an_older_value(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "o bigint, v int")
    got = running(df, [], "o", [Running("r", F.struct("v"))], shift=1).collect()
    assert {r.o: (r.r and r.r.v) for r in got} == {1: None, 2: 5, 3: None}
    assert [r.r is None for r in sorted(got)] == [True, False, False]


@pytest.mark.parametrize("reverse", [False, True])
def test_as_of_is_strict(spark, reverse):
    rng = random.Random(3)
    probes = [(i, rng.randint(0, 300)) for i in range(200)]
    events = [(t, t * 10) for t in sorted(rng.sample(range(300), 60))]
    got = as_of(
        spark.createDataFrame(probes, "id int, t bigint"),
        spark.createDataFrame(events, "t bigint, x bigint"),
        "t",
        ["x"],
        reverse=reverse,
        shift=4,
    )
    for r in got.collect():
        side = [x for t, x in events if (t > r.t if reverse else t < r.t)]
        assert r.x == ((min(side) if reverse else max(side)) if side else None)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, q):
    rng = random.Random(11)
    data = [("a", rng.randint(0, 5000)) for _ in range(501)]
    data += [("b", rng.choice([7, 7, 9])) for _ in range(40)] + [("c", 3), ("d", None)]
    df = spark.createDataFrame(data, "k string, v bigint")
    got = {r.k: (r.quantile, r.n_values) for r in exact_quantile(df, ["k"], "v", q, shift=4).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, (value, n) in got.items():
        values = [v for kk, v in data if kk == k]
        assert n == len(values)
        assert value == pytest.approx(np.quantile(values, q))


def test_exact_quantile_with_weights(spark):
    df = spark.createDataFrame([(1, 3), (10, 1), (5, 0)], "v bigint, n bigint")
    assert exact_quantile(df, [], "v", 0.5, weight="n").first().quantile == 1.0
