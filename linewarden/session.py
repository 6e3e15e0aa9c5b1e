"""Session settings and tables that cut lineage."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Where a local session that names no folder keeps its tables.
LOCAL_DIR = "file:///tmp/checkpoints"


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the time zone, so timestamps mean the same on every cluster."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship(module: str) -> None:
    """Send the functions of a module along with the tasks that call them.

    Executors then need no copy of the package.
    """
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    A session on one machine may name none; any other must.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_DIR


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/linewarden/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a small derived table once and read it back.

    The rows survive lost executors, later plans do not repeat the work, and
    Spark knows the size from the files: it broadcasts the table only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles it beyond that.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
