"""Windows, lateness, metrics and alerts, replayed over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions.clocks import aligned_origin
from linewarden.operators import alerts, metrics, windows
from linewarden.operators.effectiveness import latest, oee_by
from linewarden.operators.quality import staleness
from linewarden.operators.quantiles import bracketed_quantile
from linewarden.operators.summary import stream_summary as summarise
from linewarden.plans import sql
from linewarden.plans.ledgers import SILENCE_S
from linewarden.plans.quality import RUN_CONFIG, judged, run_rows
from linewarden.plans.registry import query, rounded
from linewarden.plans.sql import BASE, FILED, REGISTRY, RUNS, ctes
from linewarden.schema import StreamConfig
from linewarden.session import prepare, settle
from linewarden.plans import fixtures

TIME_SCALE = 6000.0
_FILED = [*RUNS, REGISTRY, FILED]


def filed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.assigned(judged(spark, sf_dir), RUN_CONFIG)


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = settle(windows.marks(run_rows(spark, sf_dir)), "marks")
    return windows.registry(marked)


@query(
    ctes(*BASE) + "select seq, line_id, (arrival_us - ts_us) / 1000 as lag_ms from judged"
)
def ingest_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rows(spark, sf_dir).select("seq", "line_id", "lag_ms")


@query(
    ctes(*RUNS)
    + """select seq, window_index, window_start_us, window_start_us + 28800000000 as window_end_us
from placed"""
)
def window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir)
    origin = windows.find_origin(rows, RUN_CONFIG.width_us)
    rows = windows.place(rows, RUN_CONFIG, origin)
    start = origin + F.col("window_index") * RUN_CONFIG.width_us
    return rows.select(
        "seq",
        "window_index",
        start.alias("window_start_us"),
        (start + RUN_CONFIG.width_us).alias("window_end_us"),
    )


@query(
    ctes(*BASE)
    + """select width_min, first_us - first_us % 86400000000 + (first_us % 86400000000)
    - (first_us % 86400000000) % (width_min * 60000000) as origin_us
from (select arg_min(ts_us, seq) + 33420000000 as first_us from judged),
  (select cast(unnest([420, 480, 1440]) as bigint) as width_min)""",
    name="aligned_origin",
)
def aligned_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins for a feed that starts at 09:17, on three grids."""
    first = windows.first_event_us(fixtures.readings(spark, sf_dir)).select(
        (F.col("first_us") + 33_420_000_000).alias("first_us")
    )
    origins = [
        F.struct(
            F.lit(w).cast("bigint").alias("width_min"),
            aligned_origin(F.col("first_us"), w * 60_000_000).alias("origin_us"),
        )
        for w in (420, 480, 1440)
    ]
    return first.select(F.inline(F.array(*origins)))


@query(
    ctes(*BASE, sql.gaps("judged", "line_id"))
    + """select line_id, median_gap_us / 1e6 as interval_s,
  greatest(5 * median_gap_us / 1e6, 1) as threshold_s
from stale where scope = 'raw'"""
)
def silence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = StreamConfig()
    rows = judged(spark, sf_dir).filter(F.col("line_id").isNotNull())
    interval = F.col("median_gap_us") / 1e6
    return staleness(rows).filter(F.col("scope") == "raw").select(
        "line_id",
        interval.alias("interval_s"),
        F.greatest(F.lit(config.silence_factor) * interval, F.lit(config.min_silence_s)).alias(
            "threshold_s"
        ),
    )


@query(
    ctes(*BASE, sql.gaps("judged", "line_id"))
    + """select line_id, round(median_gap_us / 6e7, 6) as cadence_min,
  round(median_gap_us / 1e6 / 6000, 6) as wall_interval_s
from stale where scope = 'raw'"""
)
def expected_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall seconds between readings when time runs 6000 times as fast."""
    rows = judged(spark, sf_dir).filter(F.col("line_id").isNotNull())
    cadence = F.col("median_gap_us") / 6e7
    return rounded(
        staleness(rows)
        .filter(F.col("scope") == "raw")
        .select(
            "line_id",
            cadence.alias("cadence_min"),
            (cadence * 60.0 / TIME_SCALE).alias("wall_interval_s"),
        )
    )


@query(
    ctes(*RUNS)
    + """select seq, ts_us as event_us, max(ts_us) over (order by seq) - 600000000 as watermark_us
from placed"""
)
def watermark_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.watermark_trace(run_rows(spark, sf_dir), RUN_CONFIG)


@query(
    ctes(*RUNS, REGISTRY)
    + """select window_index, first_seq, close_seq, close_seq is null as drained
from registry where opened"""
)
def window_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.window_closes(_registry(spark, sf_dir))


@query(ctes(*_FILED) + "select seq, line_id, window_index from filed where late")
def late_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filed_rows(spark, sf_dir).filter("late").select("seq", "line_id", "window_index")


@query(ctes(*_FILED) + "select seq, late, window_index, assigned_window from filed")
def late_reassign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filed_rows(spark, sf_dir).select("seq", "late", "window_index", "assigned_window")


_CONTENTS = """, contents as (
  select assigned_window as window_index, count(*) as n_rows, count(*) filter (late) as late_rows,
    array_to_string(list_sort(list_distinct(list(line_id) filter (line_id is not null))), ',')
      as lines
  from filed where assigned_window is not null group by assigned_window)
"""


@query(ctes(*_FILED) + _CONTENTS + "select window_index, n_rows, late_rows, lines from contents")
def window_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = windows.window_contents(filed_rows(spark, sf_dir))
    return contents.select(
        "window_index", "n_rows", "late_rows", F.array_join("lines", ",").alias("lines")
    )


@query(
    ctes(*_FILED)
    + _CONTENTS
    + """select c.window_index, n_rows, late_rows from contents c join registry r
  on r.window_index = c.window_index where r.opened and r.close_seq is null"""
)
def drained_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that only the end of the run closes."""
    rows = run_rows(spark, sf_dir)
    marked = settle(windows.marks(rows), "marks")
    opened = settle(windows.registry(marked), "windows")
    contents = windows.window_contents(windows.assign(rows, marked, opened, RUN_CONFIG))
    drained = windows.window_closes(opened).filter("drained").select("window_index")
    return contents.join(drained, "window_index").select("window_index", "n_rows", "late_rows")


@query(
    ctes(*_FILED, sql.oee("(select * from filed where assigned_window is not null)",
                          "assigned_window as window_index, line_id"))
    + f"select {sql.oee_columns('window_index', 'line_id')} from result"
)
def oee_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_window_oee(spark, sf_dir))


@query(
    ctes(*_FILED, sql.oee("(select * from filed where assigned_window is not null)",
                          "assigned_window as window_index, line_id"))
    + f"""select {sql.oee_columns('window_index', 'line_id')} from result
where window_index = (select max(window_index) from result)"""
)
def latest_window_oee(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = settle(_window_oee(spark, sf_dir), "window-oee")
    return rounded(latest(results, "window_index"))


def _window_oee(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        filed_rows(spark, sf_dir)
        .filter(F.col("assigned_window").isNotNull())
        .drop("window_index")
        .withColumnRenamed("assigned_window", "window_index")
    )
    return oee_by(rows, ["window_index", "line_id"])


_ROW_BOUNDS = [100, 250, 400, 450, 475, 480, 500]


@query(
    ctes(*_FILED)
    + _CONTENTS
    + "select count(*) as n_windows, cast(sum(n_rows) as bigint) as sum_rows, "
    + ", ".join(f"count(*) filter (n_rows <= {b}) as le_{b}" for b in _ROW_BOUNDS)
    + " from contents"
)
def window_rows_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = windows.window_contents(filed_rows(spark, sf_dir))
    return windows.rows_histogram(contents, _ROW_BOUNDS)


@query(
    ctes(*BASE)
    + "select seq, line_id, batch_id from judged order by seq limit 500"
)
def first_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop condition of a run: its first 500 arrivals."""
    rows = fixtures.readings(spark, sf_dir).select("seq", "line_id", "batch_id")
    return rows.orderBy("seq").limit(500)


# --- metrics -----------------------------------------------------------------------


@query(ctes(*BASE) + "select line_id, count(*) as n_readings from judged group by line_id")
def readings_received(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.readings_received(fixtures.readings(spark, sf_dir))


@query(
    ctes(*BASE)
    + f"""select line_id, count(*) as n_readings, round(sum((arrival_us - ts_us) / 1000), 6)
    as sum_lag_ms, cast(b as bigint) as le_ms,
  count(*) filter ((arrival_us - ts_us) / 1000 <= b) as n_le
from judged, (select unnest({metrics.LAG_BOUNDS_MS}) as b) group by line_id, b"""
)
def lag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.lag_histogram(run_rows(spark, sf_dir)))


@query(
    ctes(*BASE)
    + """select line_id, round(quantile_cont(arrival_us - ts_us, 0.95) / 1000, 6) as lag_ms,
  count(*) as n_values from judged where line_id is not null group by line_id"""
)
def lag_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(spark, sf_dir).filter(F.col("line_id").isNotNull())
    return rounded(metrics.lag_quantile(rows))


@query(
    """select event_type, round(quantile_cont(epoch_us(ts), 0.95) / 1e6, 6) as p95_s,
  count(ts) as n_values from events where event_type is not null group by event_type"""
)
def event_time_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quantile of values that are all distinct, by brackets."""
    events = prepare(spark).read.parquet(f"{sf_dir}/events.parquet")
    timed = events.select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    found = bracketed_quantile(timed, ["event_type"], "us", 0.95)
    return rounded(
        found.select("event_type", (F.col("quantile") / 1e6).alias("p95_s"), "n_values")
    )


@query(
    ctes(*BASE)
    + """select line_id, greatest(0, max(arrival_us - ts_us) / 1e6) as max_lag_s
from judged group by line_id"""
)
def peak_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.peak_lag(run_rows(spark, sf_dir))


@query(
    ctes(*BASE)
    + """select line_id, arg_max(temperature, seq) as temperature
from judged where temperature is not null group by line_id"""
)
def latest_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latest_temperature(fixtures.readings(spark, sf_dir))


# --- alerts ------------------------------------------------------------------------

_TRIGGERS = [*BASE, sql.triggers(900_000_000)]
_ALERTS = [*_TRIGGERS, sql.folded(3_600_000_000)]


def _triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.triggers(judged(spark, sf_dir), RUN_CONFIG, SILENCE_S)


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_rows(spark, sf_dir).select("seq", "line_id", "ingest_us")


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_feed(_triggers(spark, sf_dir), RUN_CONFIG.cooldown_us)


@query(
    ctes(*_TRIGGERS) + "select seq, kind, phase, line_id, detail from triggers"
)
def alert_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _triggers(spark, sf_dir).select("seq", "kind", "phase", "line_id", "detail")


@query(
    ctes(*_TRIGGERS)
    + "select seq, line_id, arrival_us as ingest_us, limit_us, next_seq, next_us from spells"
)
def silence_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    spells = alerts.silence_spells(_arrivals(spark, sf_dir), SILENCE_S)
    return spells.select("seq", "line_id", "ingest_us", "limit_us", "next_seq", "next_us")


@query(
    ctes(*_TRIGGERS)
    + """select seq, at_us, line_id, round(value, 6) as quiet_s from triggers
where phase = 'silent'"""
)
def silence_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = alerts.silence_triggers(_arrivals(spark, sf_dir), SILENCE_S)
    return rounded(
        fired.filter(F.col("phase") == "silent").select(
            "seq", "at_us", "line_id", F.col("value").alias("quiet_s")
        )
    )


@query(ctes(*_TRIGGERS) + "select seq, at_us, line_id from triggers where phase = 'resumed'")
def silence_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = alerts.silence_triggers(_arrivals(spark, sf_dir), SILENCE_S)
    return fired.filter(F.col("phase") == "resumed").select("seq", "at_us", "line_id")


@query(
    ctes(*_ALERTS) + "select seq, at_us, kind, phase, line_id, detail, suppressed from fires"
)
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = _feed(spark, sf_dir).filter(F.col("phase") != "pending")
    return fired.select(
        "seq",
        F.col("fired_us").alias("at_us"),
        "kind",
        "phase",
        "line_id",
        "detail",
        "suppressed",
    )


@query(ctes(*_ALERTS) + "select kind, line_id, at_us, suppressed from held")
def alert_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _feed(spark, sf_dir).filter(F.col("phase") == "pending")
    return left.select("kind", "line_id", F.col("fired_us").alias("at_us"), "suppressed")


@query(
    ctes(*_ALERTS)
    + """select seq, fired_us, kind, phase, line_id, detail, round(value, 6) as value, suppressed
from feed"""
)
def alert_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_feed(spark, sf_dir).drop("trigger_rank"))


@query(ctes(*_ALERTS) + "select line_id, kind, count(*) as n_alerts from feed group by all")
def alerts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_counts(_feed(spark, sf_dir))


@query(
    ctes(*_FILED, sql.triggers(900_000_000), sql.folded(3_600_000_000))
    + """, lags as (
  select line_id, cast(round(greatest(0, max(arrival_us - ts_us) / 1e6)) as bigint) as s
  from judged where line_id is not null group by line_id),
kinds as (select kind, count(*) as n from feed group by kind)
select (select count(*) from filed) as n_readings,
  (select count(*) from registry where opened) as n_windows,
  (select count(*) from filed where late) as n_late,
  (select string_agg(line_id || '=' || s || 's', '  ' order by line_id) from lags) as peak_lag,
  (select string_agg(kind || '=' || n, '  ' order by kind) from kinds) as alerts"""
)
def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(spark, sf_dir)
    marked = settle(windows.marks(rows), "marks")
    opened = settle(windows.registry(marked), "windows")
    filed = windows.assign(rows, marked, opened, RUN_CONFIG)
    feed = alerts.alert_feed(
        alerts.triggers(rows, RUN_CONFIG, SILENCE_S), RUN_CONFIG.cooldown_us
    )
    return summarise(filed, opened, feed)
