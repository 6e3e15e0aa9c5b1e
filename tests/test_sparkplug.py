"""The binary payload format, read and written."""

import random
import struct

from pyspark.sql import functions as F

from linewarden.functions import sparkplug


def test_round_trip():
    rng = random.Random(1)
    for _ in range(300):
        metrics = {
            f"m{i}": rng.choice([None, "", "ERR", "é🙂", 0, 1, -1, 2**63 - 1, -(2**63), rng.randrange(10**6)])
            for i in range(rng.randrange(6))
        }
        stamp = rng.choice([0, 127, 128, 1784505600000, 2**50])
        got = sparkplug.decode(sparkplug.encode(stamp, list(metrics.items())))
        shown = [(k, None if v is None else str(v)) for k, v in metrics.items()]
        assert got == {"line_id": None, "timestamp": float(stamp), "metrics": shown}


def test_kinds_of_values():
    def metric(datatype, number, wire, value):
        body = sparkplug._field(1, 2, b"x") + sparkplug._field(4, 0, datatype)
        return sparkplug._field(2, 2, body + sparkplug._field(number, wire, value))

    cases = [
        (metric(1, 10, 0, 255), "-1"),
        (metric(3, 10, 0, 2**32 - 5), "-5"),
        (metric(7, 10, 0, 2**32 - 5), str(2**32 - 5)),
        (metric(8, 11, 0, 2**64 - 1), str(2**64 - 1)),
        (metric(9, 12, 5, struct.pack("<f", 1.5)), "1.5"),
        (metric(10, 13, 1, struct.pack("<d", -0.1)), "-0.1"),
        (metric(11, 14, 0, 1), "true"),
        (metric(11, 14, 0, 0), "false"),
    ]
    for data, value in cases:
        assert sparkplug.decode(data)["metrics"] == [("x", value)], value


def test_unknown_fields_are_skipped():
    data = (
        sparkplug._field(3, 0, 7) + sparkplug._field(4, 2, b"uuid") + sparkplug._field(99, 5, b"1234")
        + sparkplug._field(98, 1, b"12345678") + sparkplug.encode(5, [("a", 1)])
    )
    assert sparkplug.decode(data) == {"line_id": None, "timestamp": 5.0, "metrics": [("a", "1")]}


def test_broken_bytes_are_none():
    good = sparkplug.encode(1784505600000, [("total_count", 1000), ("batch_id", "b1")])
    assert sparkplug.decode(None) is None
    assert sparkplug.decode(b"")["metrics"] == []
    rng = random.Random(2)
    for cut in range(1, len(good)):
        assert sparkplug.decode(good[:cut]) is None or len(sparkplug.decode(good[:cut])["metrics"]) < 2
    for _ in range(2000):
        noise = bytes(rng.randrange(256) for _ in range(rng.randrange(40)))
        found = sparkplug.decode(noise)
        assert found is None or set(found) == {"line_id", "timestamp", "metrics"}
    assert sparkplug.decode(b"\xff" * 30) is None
    assert sparkplug.decode(sparkplug._field(2, 2, sparkplug._field(15, 2, b"nameless"))) is None


def test_column(spark):
    rows = [(1, sparkplug.encode(9, [("a", -3), ("b", None)])), (2, b"\x12\x7f"), (3, None)]
    df = spark.createDataFrame(rows, "seq int, payload binary")
    got = df.select("seq", sparkplug.decode_binary(F.col("payload")).alias("d")).orderBy("seq").collect()
    assert (got[0].d.timestamp, got[0].d.metrics) == (9.0, {"a": "-3", "b": None})
    assert got[1].d is None and got[2].d is None
