"""Writers of the ledger, of logs, alerts and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from linewarden.operators.ledger import LEDGER_COLUMNS, log_records

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("run_index", T.LongType()),
        T.StructField("trace_id", T.StringType()),
        T.StructField("span_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("start_ns", T.LongType()),
        T.StructField("end_ns", T.LongType()),
        T.StructField("line_id", T.StringType()),
        T.StructField("rows_in", T.LongType()),
        T.StructField("rows_out", T.LongType()),
        T.StructField("rows_dropped", T.LongType()),
        T.StructField("null_ratio", T.DoubleType()),
        T.StructField("stale_batch", T.BooleanType()),
        T.StructField("availability", T.DoubleType()),
        T.StructField("performance", T.DoubleType()),
        T.StructField("quality", T.DoubleType()),
        T.StructField("oee", T.DoubleType()),
        T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    ]
)


def write_ledger(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """Append ledger rows; one folder per span name, which readers prune by."""
    ledger.select(*LEDGER_COLUMNS).write.mode(mode).partitionBy("name").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).select(*LEDGER_COLUMNS)


def write_logs(ledger: DataFrame, path: str, mode: str = "append") -> None:
    """The log twin of ledger rows, as JSON lines."""
    log_records(ledger).write.mode(mode).json(path)


def write_metric(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A counter, gauge or histogram table, keyed by its label columns."""
    table.write.mode(mode).parquet(path)
