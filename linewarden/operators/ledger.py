"""The ledger: one row per stage, run, window and alert, and its log twin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.effectiveness import oee_factors, oee_sums
from linewarden.operators.quality import null_cells, ratio, stale_flags

SERVICE = "linewarden"

LEDGER_COLUMNS = [
    "run_index",
    "trace_id",
    "span_id",
    "parent_id",
    "name",
    "service",
    "start_ns",
    "end_ns",
    "line_id",
    "rows_in",
    "rows_out",
    "rows_dropped",
    "null_ratio",
    "stale_batch",
    "availability",
    "performance",
    "quality",
    "oee",
    "attrs",
]

# Level names with the severity number and text of a log record.
SEVERITY = {
    "critical": (21, "CRITICAL"),
    "error": (17, "ERROR"),
    "warning": (13, "WARN"),
    "warn": (13, "WARN"),
    "info": (9, "INFO"),
    "debug": (5, "DEBUG"),
    "notset": (0, "NOTSET"),
}

# Names a log record keeps for itself.
RESERVED_LOG_KEYS = [
    "name",
    "msg",
    "args",
    "levelname",
    "levelno",
    "pathname",
    "filename",
    "module",
    "exc_info",
    "exc_text",
    "stack_info",
    "lineno",
    "funcName",
    "created",
    "msecs",
    "relativeCreated",
    "thread",
    "threadName",
    "processName",
    "process",
    "taskName",
]


def stage_facts(
    judged: DataFrame, keys: Sequence[str] = ("line_id",), stale: bool = True
) -> DataFrame:
    """All measures of the four stages, one row per key.

    Raw and clean measures come from the same pass over the rows; only
    staleness needs the order of time and joins in afterwards. Without ``stale``
    its flags are null and no row is ordered.
    """
    keys = list(keys)
    kept = ~F.col("malformed")
    rows = judged.filter(F.col("line_id").isNotNull())
    counts = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(kept).alias("clean_rows"),
        null_cells().alias("_raw_nulls"),
        null_cells(kept).alias("_clean_nulls"),
        F.min("arrival_us").alias("first_us"),
        F.max("arrival_us").alias("last_us"),
        F.min(F.when(kept, F.col("arrival_us"))).alias("first_clean_us"),
        F.max(F.when(kept, F.col("arrival_us"))).alias("last_clean_us"),
        *oee_sums(kept),
    )
    facts = oee_factors(counts).withColumns(
        {
            "raw_null_ratio": ratio(F.col("_raw_nulls"), F.col("raw_rows")),
            "clean_null_ratio": ratio(F.col("_clean_nulls"), F.col("clean_rows")),
        }
    )
    facts = facts.drop("_raw_nulls", "_clean_nulls")
    if not stale:
        unknown = F.lit(None).cast("boolean")
        return facts.withColumns({"raw_stale": unknown, "clean_stale": unknown})
    return facts.join(stale_flags(rows, keys), keys, "left").fillna(
        False, ["raw_stale", "clean_stale"]
    )


def stage_ledger(judged: DataFrame, run: str | None = None, stale: bool = True) -> DataFrame:
    """Five rows per line and run: the run itself and its four stages.

    A lazy plan has no wall time per stage. A stage therefore lasts from the
    first to the last arrival of the rows it handled.
    """
    keys = [run, "line_id"] if run else ["line_id"]
    facts = stage_facts(judged, keys, stale)
    run_index = F.col(run).cast("bigint") if run else F.lit(0).cast("bigint")
    facts = facts.withColumn("run_index", run_index)

    first_clean = F.coalesce("first_clean_us", "last_us")
    last_clean = F.coalesce("last_clean_us", "last_us")
    zero = F.lit(0).cast("bigint")
    raw, good = F.col("raw_rows"), F.col("clean_rows")
    raw_quality = (F.col("raw_null_ratio"), F.col("raw_stale"))
    clean_quality = (F.col("clean_null_ratio"), F.col("clean_stale"))
    spans = [
        _span("pipeline_run", F.col("first_us"), F.col("last_us"), oee=True),
        _span("ingest", F.col("first_us"), F.col("last_us"), (raw, raw, zero), raw_quality),
        _span("clean", first_clean, last_clean, (raw, good, raw - good), clean_quality),
        _span("transform", first_clean, last_clean, (good, good, zero), clean_quality),
        _span(
            "aggregate",
            last_clean,
            F.col("last_us"),
            (good, F.lit(1).cast("bigint"), zero),
            clean_quality,
            factors=True,
            oee=True,
        ),
    ]
    long = facts.select(
        "run_index",
        F.concat(F.lit("run-"), F.col("run_index").cast("string")).alias("trace_id"),
        "line_id",
        F.inline(F.array(*spans)),
    )
    line_path = F.concat_ws("/", "trace_id", "line_id")
    is_run = F.col("name") == "pipeline_run"
    return long.select(
        "run_index",
        "trace_id",
        F.concat_ws("/", line_path, "name").alias("span_id"),
        F.when(is_run, F.concat_ws("/", "trace_id", F.lit("stream_window")))
        .otherwise(F.concat_ws("/", line_path, F.lit("pipeline_run")))
        .alias("parent_id"),
        *LEDGER_COLUMNS[4:5],
        F.lit(SERVICE).alias("service"),
        *LEDGER_COLUMNS[6:-1],
        F.create_map().cast("map<string,string>").alias("attrs"),
    )


def _span(
    name: str,
    start_us: Column,
    end_us: Column,
    rows: tuple[Column, Column, Column] | None = None,
    quality: tuple[Column, Column] | None = None,
    *,
    factors: bool = False,
    oee: bool = False,
) -> Column:
    count = F.lit(None).cast("bigint")
    number = F.lit(None).cast("double")
    rows_in, rows_out, dropped = rows or (count, count, count)
    nulls, stale = quality or (number, F.lit(None).cast("boolean"))

    def rounded(column: str, present: bool) -> Column:
        return F.bround(F.col(column), 4) if present else number

    return F.struct(
        F.lit(name).alias("name"),
        (start_us * 1000).alias("start_ns"),
        (end_us * 1000).alias("end_ns"),
        rows_in.alias("rows_in"),
        rows_out.alias("rows_out"),
        dropped.alias("rows_dropped"),
        F.bround(nulls, 4).alias("null_ratio"),
        stale.alias("stale_batch"),
        rounded("availability", factors).alias("availability"),
        rounded("performance", factors).alias("performance"),
        rounded("quality", factors).alias("quality"),
        rounded("oee", oee).alias("oee"),
    )


def window_spans(contents: DataFrame, origin_us: Column, width_us: int) -> DataFrame:
    """One ``stream_window`` row per window, above its ``pipeline_run`` rows."""
    start = origin_us + F.col("window_index") * width_us
    typed = {
        name: F.lit(None).cast(kind)
        for name, kind in [
            ("parent_id", "string"),
            ("line_id", "string"),
            ("rows_in", "bigint"),
            ("rows_out", "bigint"),
            ("rows_dropped", "bigint"),
            ("null_ratio", "double"),
            ("stale_batch", "boolean"),
            ("availability", "double"),
            ("performance", "double"),
            ("quality", "double"),
            ("oee", "double"),
        ]
    }
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    trace = F.concat(F.lit("run-"), F.col("window_index").cast("string"))
    return contents.withColumns(
        {
            **typed,
            "run_index": F.col("window_index"),
            "trace_id": trace,
            "span_id": F.concat_ws("/", trace, F.lit("stream_window")),
            "name": F.lit("stream_window"),
            "service": F.lit(SERVICE),
            "start_ns": F.col("first_us") * 1000,
            "end_ns": F.col("last_us") * 1000,
            "attrs": F.create_map(
                F.lit("window.index"),
                F.col("window_index").cast("string"),
                F.lit("window.start"),
                F.date_format(F.timestamp_micros(start), iso),
                F.lit("window.end"),
                F.date_format(F.timestamp_micros(start + width_us), iso),
                F.lit("window.rows"),
                F.col("n_rows").cast("string"),
                F.lit("window.late_rows"),
                F.col("late_rows").cast("string"),
                F.lit("window.lines"),
                F.array_join("lines", ","),
            ),
        }
    ).select(*LEDGER_COLUMNS)


def alert_spans(alerts: DataFrame) -> DataFrame:
    """Alerts as ledger rows; a value appears only where there is one."""
    number = F.lit(None).cast("double")
    count = F.lit(None).cast("bigint")
    attrs = F.map_filter(
        F.create_map(
            F.lit("alert.kind"),
            F.col("kind"),
            F.lit("alert.detail"),
            F.col("detail"),
            F.lit("alert.suppressed"),
            F.col("suppressed").cast("string"),
            F.lit("alert.value"),
            F.col("value").cast("string"),
        ),
        lambda _, v: v.isNotNull(),
    )
    return alerts.select(
        count.alias("run_index"),
        F.lit("alerts").alias("trace_id"),
        # A streamed silence and a pending row have no arrival number: their moment tells them apart.
        F.concat_ws(
            "/",
            F.lit("alerts"),
            "line_id",
            "kind",
            "phase",
            F.coalesce(F.col("seq"), F.col("fired_us")).cast("string"),
        ).alias("span_id"),
        F.lit(None).cast("string").alias("parent_id"),
        F.lit("alert").alias("name"),
        F.lit(SERVICE).alias("service"),
        (F.col("fired_us") * 1000).alias("start_ns"),
        (F.col("fired_us") * 1000).alias("end_ns"),
        "line_id",
        *[count.alias(c) for c in ("rows_in", "rows_out", "rows_dropped")],
        number.alias("null_ratio"),
        F.lit(None).cast("boolean").alias("stale_batch"),
        *[number.alias(c) for c in ("availability", "performance", "quality", "oee")],
        attrs.alias("attrs"),
    )


def severity(level: Column) -> list[Column]:
    """Number and name of a level; an unknown one counts as info."""

    def mapped(part: int) -> Column:
        pairs = [x for name, both in SEVERITY.items() for x in (F.lit(name), F.lit(both[part]))]
        return F.coalesce(F.create_map(*pairs)[level], F.lit(SEVERITY["info"][part]))

    return [mapped(0).alias("severity"), mapped(1).alias("severity_text")]


def event_logs(rows: DataFrame, body: Column, level: str, attrs: Sequence[str]) -> DataFrame:
    """Log records of events that are no ledger row, such as discards and failures."""
    pairs = [x for name in attrs for x in (F.lit(name), F.col(name).cast("string"))]
    return rows.select(
        body.alias("body"),
        *severity(F.lit(level)),
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("attrs"),
    )


def log_records(ledger: DataFrame, level: Column | None = None) -> DataFrame:
    """The fields of each ledger row as a log record.

    The span name becomes the body. Names that a log record keeps for itself
    are left out of the attributes, and so are absent values.
    """
    level = F.lit("info") if level is None else level
    fields = [
        "line_id",
        "rows_in",
        "rows_out",
        "rows_dropped",
        "null_ratio",
        "stale_batch",
        "availability",
        "performance",
        "quality",
        "oee",
    ]
    pairs = [x for f in fields for x in (F.lit(f), F.col(f).cast("string"))]
    reserved = F.array(*[F.lit(k) for k in [*RESERVED_LOG_KEYS, "event"]])
    attrs = F.map_filter(
        F.map_concat(F.create_map(*pairs), F.col("attrs")),
        lambda k, v: v.isNotNull() & ~F.array_contains(reserved, k),
    )
    return ledger.select(
        F.col("name").alias("body"),
        *severity(level),
        "trace_id",
        "span_id",
        F.col("end_ns").alias("observed_ns"),
        attrs.alias("attrs"),
    )


def span_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("run_index", "name").agg(F.count(F.lit(1)).alias("n_spans"))
