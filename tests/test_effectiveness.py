import random
import pytest
from pyspark.sql import functions as F

from linewarden.functions.effectiveness import oee_band
from linewarden.functions.numbers import fixed_text, int_or_null, plain_text
from linewarden.operators.effectiveness import oee_by, oee_table
from linewarden.operators.quality import (
    fault_profile,
    null_ratios,
    quarantine,
    reason_counts,
    staleness,
)
from linewarden.schema import RECORD_SCHEMA
from linewarden.sources.records import judge

START = "2026-07-20T00:0"


def records(spark, rows):
    """Rows of (planned, downtime, cycle, total, good), with the rest filled in."""
    full = [
        (f"{START}{i}:00", "line_1", f"b{i}", str(p), str(d), str(c), str(t), str(g), 70.0)
        for i, (p, d, c, t, g) in enumerate(rows)
    ]
    return judge(spark.createDataFrame(full, RECORD_SCHEMA))


@pytest.mark.parametrize(
    "rows, expected",
    [
        ([(100, 20, 1.0, 4800, 4560)], (0.8, 1.0, 0.95, 0.76)),
        ([(100, 20, 1.0, 4800, 4560)] * 2, (0.8, 1.0, 0.95, 0.76)),
        ([(100, 20, 1.0, 0, 0)], (0.8, 0.0, 0.0, 0.0)),
        ([(100, 100, 1.0, 4800, 4560)], (0.0, 0.0, 0.95, 0.0)),
        ([(100, 20, 5.0, 4800, 4560)], (0.8, 1.0, 0.95, 0.76)),
        ([(100, 120, 1.0, 4800, 4560)], (0.0, 0.0, 0.95, 0.0)),
    ],
)
def test_oee_vectors(spark, rows, expected):
    got = oee_by(records(spark, rows)).first()
    assert (got.availability, got.performance, got.quality, got.oee) == pytest.approx(expected)
    assert got.total_count == sum(r[3] for r in rows)
    assert got.run_min == max(0, sum(r[0] - r[1] for r in rows))


def test_line_without_a_clean_row_keeps_its_row_of_zeros(spark):
    got = oee_by(records(spark, [(100, 20, 1.0, "ERR", 5)])).first()
    assert (got.line_id, got.oee, got.total_count) == ("line_1", 0.0, 0)


def test_mean_cycle_is_unweighted(spark):
    got = oee_by(records(spark, [(100, 0, 1.0, 100, 100), (100, 0, 3.0, 2900, 2900)])).first()
    assert got.performance == pytest.approx(3000 * 2.0 / 60 / 200)
    fixed = oee_by(records(spark, [(100, 0, 1.0, 600, 600)]), ideal_cycle_s=F.lit(5.0)).first()
    assert fixed.performance == pytest.approx(600 * 5 / 60 / 100)


def test_bands(spark):
    values = [(0.75,), (0.7499,), (0.65,), (0.6499,)]
    df = spark.createDataFrame(values, "oee double").select(oee_band(F.col("oee")).alias("b"))
    assert [r.b for r in df.collect()] == ["green", "yellow", "yellow", "red"]
    table = oee_table(oee_by(records(spark, [(100, 20, 1.0, 4800, 4560)]))).first()
    assert (table.availability, table.oee, table.band) == ("0.80", "0.76", "green")


BAD = {
    "negative_count": {"total_count": "-1"},
    "good_exceeds_total": {"good_count": "125"},
    "blank_batch": {"batch_id": " \t"},
    "blank_line": {"line_id": None},
    "non_positive_planned": {"planned_min": "0.0"},
    "non_numeric": {"total_count": "ERR"},
}


def _record(**changes):
    row = {
        "ts": "2026-07-20T00:00:00",
        "line_id": "line_1",
        "batch_id": "b0",
        "planned_min": "60",
        "downtime_min": "5",
        "ideal_cycle_s": "2",
        "total_count": "100",
        "good_count": "90",
        "temperature": None,
    }
    row.update(changes)
    return tuple(row[c] for c in RECORD_SCHEMA.names)


@pytest.mark.parametrize("reason", BAD)
def test_each_corruption_is_named(spark, reason):
    judged = judge(spark.createDataFrame([_record(**BAD[reason])], RECORD_SCHEMA))
    row = quarantine(judged).first()
    assert reason in row.reasons
    assert reason_counts(judged).filter(F.col("reason") == reason).first().n_rows == 1


def test_missing_temperature_is_kept(spark):
    judged = judge(spark.createDataFrame([_record()], RECORD_SCHEMA))
    assert judged.filter("malformed").count() == 0
    assert null_ratios(judged).first().clean_null_ratio == 1.0
    assert fault_profile(judged).first().missing_rate == 1.0


@pytest.mark.parametrize(
    "text, number",
    [
        ("12", 12.0),
        (" 12\n", 12.0),
        ("+1.5e2", 150.0),
        (".5", 0.5),
        ("5.", 5.0),
        ("1d", None),
        ("1f", None),
        ("inf", None),
        ("NaN", None),
        ("1e999", None),
        ("1_000", None),
        ("0x10", None),
        ("", None),
        ("ERR", None),
        (None, None),
    ],
)
def test_numbers(spark, text, number):
    judged = judge(spark.createDataFrame([_record(downtime_min=text)], RECORD_SCHEMA)).first()
    assert judged.downtime_min == number
    assert judged.malformed == (number is None)


def test_mask_equals_the_union_of_its_reasons(spark, sf_dir):
    from linewarden.functions.validity import malformed_reasons
    from linewarden.plans import fixtures

    judged = judge(fixtures.readings(spark, sf_dir))
    differs = judged.filter((F.size(malformed_reasons()) > 0) != F.col("malformed"))
    assert differs.count() == 0


def test_fixed_text_rounds_the_binary_value(spark):
    rng = random.Random(7)
    values = [0.125, 0.375, 85.25, 85.35, 2.675, 0.0, 1234.995, -0.125, 99.995, 0.045, 1e-9]
    values += [k / 1000 for k in range(-1000, 1001)] + [k / 10000 for k in range(-9999, 10000, 7)]
    values += [rng.uniform(-2, 2) for _ in range(2000)] + [10 ** -rng.uniform(0, 12) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2, 3):
        got = [r[0] for r in df.select(fixed_text(F.col("v"), digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in values]


def test_plain_text_and_int_or_null(spark):
    df = spark.createDataFrame([(28800000.0,), (12.34,), (0.5,)], "v double")
    assert [r[0] for r in df.select(plain_text(F.col("v"))).collect()] == [
        "28800000.0",
        "12.34",
        "0.5",
    ]
    texts = ["45", "45.9", '"45"', '"45.9"', '" 7 "', '"x"', "null", "-3.7", "1e3", None]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = df.select(int_or_null(F.try_parse_json("v"))).collect()
    assert [r[0] for r in got] == [45, 45, 45, None, 7, None, None, -3, 1000, None]


def _stale(spark, minutes):
    rows = [_record(ts=f"2026-07-20T{m // 60:02d}:{m % 60:02d}:00") for m in minutes]
    judged = judge(spark.createDataFrame(rows, RECORD_SCHEMA))
    found = staleness(judged).filter("scope = 'raw'").first()
    return bool(found and found.stale_batch)


def test_staleness(spark):
    assert not _stale(spark, [0, 10])  # too few rows
    assert not _stale(spark, [0, 10, 20, 30])
    assert not _stale(spark, [0, 10, 20, 70])  # exactly five times the median
    assert _stale(spark, [0, 10, 20, 71])
    assert not _stale(spark, [5, 5, 5, 5, 90])  # a median of zero is no cadence
    assert _stale(spark, [0, 1, 2, 3, 60])


def test_copies_keep_the_ratios(spark, sf_dir):
    from linewarden.plans import fixtures

    judged = judge(fixtures.readings(spark, sf_dir))
    once = {r.line_id: r.oee for r in oee_by(judged).collect()}
    twice = {r.line_id: r.oee for r in oee_by(judged.unionAll(judged).repartition(7)).collect()}
    assert once.keys() == twice.keys()
    assert all(once[k] == pytest.approx(twice[k]) for k in once)


def test_any_finite_count_is_counted(spark):
    """A count beyond a long stops nothing: it is shown as null, and the factors are those of the sums."""
    from linewarden.functions.effectiveness import oee_factors, oee_sums, whole

    rows = [("a", 60.0, 5.0, 2.0, 1e300, 950.0), ("a", 60.0, 5.0, 2.0, 100.5, 90.0),
            ("b", 60.0, 0.0, 2.0, 1e308, 1e308), ("b", 60.0, 0.0, 2.0, 1e308, 1e308),
            ("c", 60.0, 0.0, 2.0, 7.9, 7.0), ("d", 60.0, 0.0, 2.0, float(2**53), float(2**53))]
    df = spark.createDataFrame(
        rows, "line_id string, planned_min double, downtime_min double, ideal_cycle_s double, "
        "total_count double, good_count double"
    )
    got = {
        r.line_id: r
        for r in oee_factors(df.groupBy("line_id").agg(*oee_sums(F.lit(True)))).collect()
    }
    assert (got["a"].total_count, got["a"].good_count, got["a"].performance) == (None, 1040, 1.0)
    assert 0.0 <= got["a"].quality < 1e-200
    assert got["b"].total_count is None and 0.0 <= got["b"].oee <= 1.0
    assert (got["c"].total_count, got["d"].total_count) == (7, 2**53)
    shown = spark.range(1).select(whole(F.lit(-3.7)).alias("a"), whole(F.lit(1e19)).alias("b")).first()
    assert (shown.a, shown.b) == (-3.0, 1e19)


def test_large_numbers_have_a_fixed_text(spark):
    from linewarden.functions.numbers import fixed_text, once

    values = [1e15, 2.0**53 - 1, 2.0**53, 1e17, 1e19, -1e19, 123456789012345.25, 1e22, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(fixed_text(F.col("v"), 1)).collect()]
    assert got == [None if v is None else f"{v:.1f}" for v in values]
    assert len(df.limit(1).select(fixed_text(F.lit(1e300), 2)).first()[0]) == 304
    again = [r[0] for r in df.select(once(F.col("v"), lambda x: fixed_text(x, 1))).collect()]
    assert again == got


def test_a_duration_beyond_a_long_is_no_duration(spark):
    from linewarden.operators import provider_calls as calls

    answer = '{"choices":[{"message":{"content":"x"}}]}'
    rows = [(i, 0, "p", "m", True, 200, answer, d) for i, d in enumerate([1e300, 9e9, 9e9, 1.5, None])]
    df = spark.createDataFrame(
        rows, "call_id long, attempt int, provider string, model string, configured boolean, "
        "status int, body string, duration_s double"
    ).withColumn("started_at", F.lit("2026-07-20 00:00:00").cast("timestamp"))
    served = calls.served_by(df)
    got = calls.durations(served).first()
    assert (got.n_calls, got.sum_s) == (5, 18e9 + 1.5)
    ends = {r.call_id: r.end_ns for r in calls.call_rows(served).collect()}
    assert ends[0] is None and ends[1] is None and ends[3] is not None
