"""Batch records: scan, typing and the view of a reading as a record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions.clocks import iso_text, micros, parse_us
from linewarden.functions.numbers import as_number, finite
from linewarden.functions.validity import malformed
from linewarden.schema import NUMERIC_COLUMNS, RECORD_COLUMNS, RECORD_SCHEMA


def read_records(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Scan raw records in the fixed column order, without type inference.

    Parquet files bring their own types, since counts may be text in one plant
    and numbers in the next. Text formats are read with the raw schema.
    """
    reader = spark.read.options(**options)
    if fmt in ("csv", "json"):
        return reader.schema(RECORD_SCHEMA).format(fmt).load(path).select(*RECORD_COLUMNS)
    return reader.format(fmt).load(path).select(*RECORD_COLUMNS)


def as_records(readings: DataFrame) -> DataFrame:
    """A reading as a raw record: event time becomes ISO text."""
    return readings.withColumn("ts", iso_text(F.col("event_time"))).select(*RECORD_COLUMNS)


def coerce(records: DataFrame) -> DataFrame:
    """Numbers instead of text, null where a value is none; all rows stay."""
    typed = {
        name: as_number(F.col(name), records.schema[name].dataType) for name in NUMERIC_COLUMNS
    }
    typed["temperature"] = finite(F.col("temperature"))
    return records.withColumns(typed)


def judge(records: DataFrame) -> DataFrame:
    """Coerced records with the ``malformed`` flag and ``ts_us``.

    Readings already carry a clock and skip the trip through text. Rows without
    event time keep a null ``ts_us``: they count, but leave no gap.
    """
    if "event_time" in records.columns:
        clock = {"ts_us": micros(F.col("event_time"))}
        if "ingest_time" in records.columns:
            clock["arrival_us"] = micros(F.col("ingest_time"))
    else:
        clock = {"ts_us": parse_us(F.col("ts"))}
    return coerce(records).withColumns(clock).withColumn("malformed", malformed())
