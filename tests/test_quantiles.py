"""Bracketed quantiles against sorted lists, proved and missed brackets."""

import random

import pytest
from pyspark.sql import functions as F

from linewarden.operators import quantiles


def expected(rows, q):
    out = {}
    for key in {k for k, v in rows if k is not None}:
        values = sorted(v for k, v in rows if k == key and v is not None)
        if values:
            place = (len(values) - 1) * q
            low, high = values[int(place)], values[-int(-place // 1)]
            out[key] = (round(low + (high - low) * (place - int(place)), 6), len(values))
    return out


def found(spark, rows, q):
    df = spark.createDataFrame(rows, "k string, v bigint").repartition(3)
    got = quantiles.bracketed_quantile(df, ["k"], "v", q).collect()
    assert len({r.k for r in got}) == len(got)
    return {r.k: (round(r.quantile, 6), r.n_values) for r in got}


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_equals_sorting(spark, q):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(-(10**12), 10**12)) for _ in range(4000)]
    rows += [("same", 7)] * 50 + [("one", -3), ("two", 1), ("two", 2)]
    rows += [("few", rng.randrange(4)) for _ in range(500)]
    rows += [("hot", None), (None, 5), ("none", None)]
    rng.shuffle(rows)
    assert found(spark, rows, q) == expected(rows, q)


def test_a_missed_bracket_takes_the_exact_way(spark, monkeypatch):
    """Brackets without any width miss the ranks between two values."""
    monkeypatch.setattr(quantiles, "BRACKET", -0.2)
    rng = random.Random(2)
    rows = [(k, rng.randrange(10**9)) for k in ("a", "b") for _ in range(2000)]
    assert found(spark, rows, 0.95) == expected(rows, 0.95)


def test_few_values_are_exchanged(spark):
    df = spark.range(40_000).select(F.lit("a").alias("k"), (F.col("id") * 7919 % 1_000_003).alias("v"))
    inside = df.filter(F.col("v").between(925_000, 975_000)).count()
    got = quantiles.bracketed_quantile(df, ["k"], "v", 0.95).first()
    values = sorted(r.v for r in df.collect())
    place = 39_999 * 0.95
    assert abs(got.quantile - (values[int(place)] + (values[int(place) + 1] - values[int(place)]) * (place % 1))) < 1e-6
    assert inside < 0.06 * 40_000
