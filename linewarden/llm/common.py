"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Used only by a local session that names no folder.
LOCAL_DIR = "file:///tmp/checkpoints"

#: Rows of a batch for Python workers, where the session has Spark's default: texts are long.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_DEFAULT, BATCH_MOST = "10000", "1000"

_shipped: set[str] = set()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = LOCAL_DIR
    return f"{base.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


#: Removes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str, lean: bool = False, **options: str) -> DataFrame:
    """Write rows once and read them back: no later step repeats the work.

    The table survives lost executors, and Spark knows its size. With ``lean`` the shuffle
    files of the write go when it has ended; a setting that the session holds meanwhile.
    ``options`` are those of the writer.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, str(lean or before == "true").lower())
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, as ``--py-files`` would, and bound their batches."""
    if spark.conf.get(BATCH_ROWS) == BATCH_DEFAULT:
        spark.conf.set(BATCH_ROWS, BATCH_MOST)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(here)
    archive = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{name}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join(name, os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns that an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    clash = [c for c in df.columns if c.lower() in taken]
    return df.select(*[df[f"`{c}`"] for c in df.columns if c not in clash]) if clash else df


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def prefix_sums(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of a key that come before, for small tables of totals."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0).cast(T.LongType())))


def running_start(
    df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str
) -> DataFrame:
    """Sum of ``value`` before each row within its key, with no task holding a whole key.

    Rows are ordered by ``bucket``, then by ``order``. Totals of a bucket are
    added up over the (few) buckets of a key, rows only within their bucket.
    """
    df = df.withColumn("__value", value.cast(T.LongType()))
    totals = df.groupBy(*keys, bucket).agg(F.sum("__value").alias("__total"))
    totals = prefix_sums(totals, keys, bucket, "__total", "__before").drop("__total")
    w = Window.partitionBy(*keys, bucket).orderBy(*order)
    own = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = df.withColumn("__own", F.sum("__value").over(own) - F.col("__value"))
    return (
        left.join(totals, [*keys, bucket])
        .withColumn(out, F.col("__before") + F.col("__own"))
        .drop("__value", "__before", "__own")
    )
