"""Data quality per key: null ratio, stage counts, gaps and staleness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.validity import malformed_reasons
from linewarden.operators.ordered import TIME_SHIFT, Running, running
from linewarden.operators.quantiles import exact_quantile
from linewarden.schema import NULLABLE_QUALITY_COLUMNS, STALE_GAP_FACTOR

LINE = ["line_id"]


def clean(judged: DataFrame) -> DataFrame:
    """Rows that keep every rule; a missing temperature is no fault."""
    return judged.filter(~F.col("malformed"))


def quarantine(judged: DataFrame) -> DataFrame:
    """The rows that clean drops, with the reasons."""
    return judged.filter("malformed").withColumn("reasons", malformed_reasons())


def reason_counts(judged: DataFrame) -> DataFrame:
    reasons = judged.select("line_id", F.explode(malformed_reasons()).alias("reason"))
    return reasons.groupBy("line_id", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def null_cells(rows: Column | None = None) -> Column:
    """Null cells over the quality columns, as an aggregate."""
    cells = F.lit(0)
    for name in NULLABLE_QUALITY_COLUMNS:
        cells = cells + F.col(name).isNull().cast("int")
    return F.coalesce(F.sum(cells if rows is None else F.when(rows, cells)), F.lit(0))


def ratio(nulls: Column, rows: Column) -> Column:
    """Nulls per cell, 0 for no rows."""
    cells = rows * len(NULLABLE_QUALITY_COLUMNS)
    return F.when(cells > 0, nulls / cells).otherwise(0.0)


def null_ratios(judged: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Null ratio of the raw and of the clean rows of each key."""
    kept = ~F.col("malformed")
    counts = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(kept).alias("clean_rows"),
        null_cells().alias("_raw"),
        null_cells(kept).alias("_clean"),
    )
    return counts.select(
        *keys,
        ratio(F.col("_raw"), F.col("raw_rows")).alias("raw_null_ratio"),
        ratio(F.col("_clean"), F.col("clean_rows")).alias("clean_null_ratio"),
    )


def fault_profile(judged: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """Shares of malformed rows and missing readings, and their overlap."""
    bad, missing = F.col("malformed"), F.col("temperature").isNull()
    return judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(bad.cast("int")).alias("malformed_rate"),
        F.avg(missing.cast("int")).alias("missing_rate"),
        F.count_if(bad & missing).alias("both"),
    )


def _instants(judged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per distinct time of a key, with its raw and clean rows.

    Copies of one timestamp collapse before anything is ordered. The ordered scan
    reads them twice, from one exchange.
    """
    return (
        judged.filter(F.col("ts_us").isNotNull())
        .groupBy(*keys, "ts_us")
        .agg(
            F.count(F.lit(1)).alias("raw_rows"),
            F.count_if(~F.col("malformed")).alias("clean_rows"),
        )
    )


def ts_gaps(judged: DataFrame, keys: Sequence[str] = LINE, shift: int = TIME_SHIFT) -> DataFrame:
    """Gaps between neighbouring timestamps: keys, scope, gap_us, n_gaps.

    ``scope`` is raw or clean. Rows with one timestamp are zero gaps.
    """
    instants = running(
        _instants(judged, keys),
        keys,
        "ts_us",
        [
            Running("_raw_before", F.col("ts_us")),
            Running("_clean_before", F.when(F.col("clean_rows") > 0, F.col("ts_us"))),
        ],
        shift=shift,
    )

    def gap(scope: str, rows: Column, before: Column) -> list[Column]:
        name = F.lit(scope).alias("scope")
        step = F.when((rows > 0) & before.isNotNull(), F.lit(1).cast("bigint"))
        return [
            F.struct(name, (F.col("ts_us") - before).alias("gap_us"), step.alias("n_gaps")),
            F.struct(
                name, F.lit(0).cast("bigint").alias("gap_us"), (rows - 1).alias("n_gaps")
            ),
        ]

    gaps = F.array(
        *gap("raw", F.col("raw_rows"), F.col("_raw_before")),
        *gap("clean", F.col("clean_rows"), F.col("_clean_before")),
    )
    return (
        instants.select(*keys, F.inline(gaps))
        .filter("n_gaps > 0")
        .groupBy(*keys, "scope", "gap_us")
        .agg(F.sum("n_gaps").alias("n_gaps"))
    )


def staleness(
    judged: DataFrame,
    keys: Sequence[str] = LINE,
    factor: float = STALE_GAP_FACTOR,
    shift: int = TIME_SHIFT,
) -> DataFrame:
    """Median and largest gap per key and scope, and whether the key is stale.

    Three timestamps make the two gaps that a cadence needs. A key with fewer
    gaps than one has no row here.
    """
    scoped = [*keys, "scope"]
    gaps = exact_quantile(
        ts_gaps(judged, keys, shift),
        scoped,
        "gap_us",
        0.5,
        weight="n_gaps",
        name="median_gap_us",
        largest="max_gap_us",
    )
    typical = F.col("median_gap_us")
    return gaps.select(
        *scoped,
        (F.col("n_values") + 1).alias("n_ts"),
        "median_gap_us",
        "max_gap_us",
        (
            (F.col("n_values") >= 2)
            & (typical > 0)
            & (F.col("max_gap_us") > F.lit(float(factor)) * typical)
        ).alias("stale_batch"),
    )


def stale_flags(judged: DataFrame, keys: Sequence[str] = LINE) -> DataFrame:
    """One row per key with the raw and the clean flag side by side."""
    flag = F.col("stale_batch")
    return (
        staleness(judged, keys)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.bool_or(F.when(F.col("scope") == "raw", flag)), F.lit(False)).alias(
                "raw_stale"
            ),
            F.coalesce(F.bool_or(F.when(F.col("scope") == "clean", flag)), F.lit(False)).alias(
                "clean_stale"
            ),
        )
    )
