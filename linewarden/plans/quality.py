"""Records, validity, quality and OEE over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions.effectiveness import oee_band, run_minutes
from linewarden.functions.validity import threshold_breach
from linewarden.operators import effectiveness, quality
from linewarden.operators.windows import find_origin, place
from linewarden.plans import sql
from linewarden.plans.registry import query, rounded
from linewarden.plans.sql import BASE, RUNS, ctes
from linewarden.schema import NUMERIC_COLUMNS, RECORD_COLUMNS, StreamConfig
from linewarden.session import new_path
from linewarden.plans import fixtures
from linewarden.sources.records import as_records, coerce, judge, read_records

RUN_CONFIG = StreamConfig(window_min=480, allowed_lateness_min=10, alert_cooldown_s=3600)
TEMP_MAX = 85.0


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(fixtures.readings(spark, sf_dir))


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged readings with their window index; a window counts as a run."""
    readings = fixtures.readings(spark, sf_dir)
    return place(judge(readings), RUN_CONFIG, find_origin(readings, RUN_CONFIG.width_us))


_RECORDS = (
    ctes(sql.READINGS)
    + """select strftime(event_time, '%Y-%m-%dT%H:%M:%S') as ts, line_id, batch_id, planned_min,
  downtime_min, ideal_cycle_s, total_count, good_count, temperature from readings"""
)


@query(_RECORDS)
def records_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records written out and scanned back in the fixed column order."""
    path = new_path(spark, "records")
    as_records(fixtures.readings(spark, sf_dir)).write.parquet(path)
    return read_records(spark, path)


@query(_RECORDS)
def reading_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_records(fixtures.readings(spark, sf_dir)).select(*RECORD_COLUMNS)


@query(
    ctes(*BASE)
    + "select seq, planned_min, downtime_min, ideal_cycle_s, total_count, good_count from typed"
)
def numeric_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coerce(fixtures.readings(spark, sf_dir)).select("seq", *NUMERIC_COLUMNS)


@query(
    ctes(*BASE)
    + """select seq, round(greatest(planned_min - downtime_min, 0), 6) as run_min
from judged where not malformed""",
    name="run_minutes",
)
def run_minutes_per_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.clean(judged(spark, sf_dir)).select("seq", run_minutes().alias("run_min"))
    return rounded(rows)


@query(ctes(*BASE) + "select seq, malformed from judged")
def malformed_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir).select("seq", "malformed")


@query(
    ctes(*BASE)
    + f"""select line_id, reason, count(*) as n_rows from (
  select line_id, unnest([
    case when total_count is null or good_count is null or planned_min is null
      or downtime_min is null or ideal_cycle_s is null then 'non_numeric' end,
    case when total_count < 0 or good_count < 0 then 'negative_count' end,
    case when good_count > total_count then 'good_exceeds_total' end,
    case when planned_min <= 0 then 'non_positive_planned' end,
    case when {sql.blank("batch_id")} then 'blank_batch' end,
    case when {sql.blank("line_id")} then 'blank_line' end]) as reason
  from judged) where reason is not null group by line_id, reason"""
)
def malformed_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reason_counts(judged(spark, sf_dir))


@query(
    ctes(*BASE)
    + """select seq, line_id, batch_id, planned_min, downtime_min, total_count, good_count,
  temperature from judged where not malformed"""
)
def clean_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean(judged(spark, sf_dir)).select(
        "seq",
        "line_id",
        "batch_id",
        "planned_min",
        "downtime_min",
        "total_count",
        "good_count",
        "temperature",
    )


@query(
    ctes(*BASE)
    + f"""select seq, line_id, concat_ws(',',
    case when total_count is null or good_count is null or planned_min is null
      or downtime_min is null or ideal_cycle_s is null then 'non_numeric' end,
    case when total_count < 0 or good_count < 0 then 'negative_count' end,
    case when good_count > total_count then 'good_exceeds_total' end,
    case when planned_min <= 0 then 'non_positive_planned' end,
    case when {sql.blank("batch_id")} then 'blank_batch' end,
    case when {sql.blank("line_id")} then 'blank_line' end) as reasons
from judged where malformed"""
)
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.quarantine(judged(spark, sf_dir))
    return rows.select("seq", "line_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    ctes(*BASE) + "select seq, line_id, temperature from judged where temperature > 85",
    name="threshold_breach",
)
def threshold_breach_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).filter(threshold_breach(TEMP_MAX))
    return rows.select("seq", "line_id", "temperature")


@query(
    ctes(*BASE)
    + """select line_id, round(count(*) filter (temperature is null) / count(*), 6)
    as raw_null_ratio,
  round(case when count(*) filter (not malformed) > 0 then
    count(*) filter (temperature is null and not malformed) / count(*) filter (not malformed)
    else 0 end, 6) as clean_null_ratio
from judged where line_id is not null group by line_id"""
)
def null_ratio_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).filter(F.col("line_id").isNotNull())
    return rounded(quality.null_ratios(rows))


@query(
    ctes(*BASE)
    + """select line_id, count(*) as n_rows, round(avg(cast(malformed as int)), 6) as malformed_rate,
  round(avg(cast(temperature is null as int)), 6) as missing_rate,
  count(*) filter (malformed and temperature is null) as both
from judged group by line_id"""
)
def fault_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(quality.fault_profile(judged(spark, sf_dir)))


@query(
    ctes(*BASE, sql.gaps("judged", "line_id"))
    + """select line_id, scope, gap_us, count(*) as n_gaps from gaps where gap_us is not null
group by line_id, scope, gap_us"""
)
def ts_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).filter(F.col("line_id").isNotNull())
    return quality.ts_gaps(rows)


@query(
    ctes(*BASE, sql.gaps("judged", "line_id"))
    + "select line_id, scope, n_ts, median_gap_us, max_gap_us, stale_batch from stale"
)
def stale_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).filter(F.col("line_id").isNotNull())
    return quality.staleness(rows)


@query(
    ctes(*RUNS, sql.gaps("runs", "run_index, line_id"))
    + """select run_index, line_id, scope, n_ts, median_gap_us, max_gap_us, stale_batch
from stale"""
)
def stale_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silence that fills an edge of a window leaves no gap inside it."""
    rows = run_rows(spark, sf_dir).filter(F.col("line_id").isNotNull())
    return quality.staleness(rows, ["window_index", "line_id"]).withColumnRenamed(
        "window_index", "run_index"
    )


@query(
    ctes(*BASE)
    + """select line_id, count(*) as rows_in, count(*) filter (not malformed) as rows_out,
  count(*) filter (malformed) as rows_dropped
from judged where line_id is not null group by line_id"""
)
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(spark, sf_dir).filter(F.col("line_id").isNotNull())
    return rows.groupBy("line_id").agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(~F.col("malformed")).alias("rows_out"),
        F.count_if("malformed").alias("rows_dropped"),
    )


@query(
    ctes(*BASE, sql.oee("judged", "line_id"))
    + f"select {sql.oee_columns('line_id')} from result"
)
def oee_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effectiveness.oee_by(judged(spark, sf_dir)))


@query(
    ctes(*BASE, sql.oee("judged", "line_id", "1.5"))
    + f"select {sql.oee_columns('line_id')} from result"
)
def oee_fixed_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effectiveness.oee_by(judged(spark, sf_dir), ideal_cycle_s=F.lit(1.5)))


@query(
    ctes(
        *BASE,
        sql.oee(
            "judged",
            "line_id",
            """case when max(line_id) = 'line_3' then avg(ideal_cycle_s) filter (not malformed)
              else min(ideal_cycle_s) end""",
        ),
    )
    + f"select {sql.oee_columns('line_id')} from result"
)
def oee_line_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best cycle ever seen on a line as its given one; line_3 has none given."""
    rows = judged(spark, sf_dir)
    cycles = (
        rows.where("line_id IS NOT NULL AND line_id <> 'line_3'")
        .groupBy("line_id")
        .agg(F.min("ideal_cycle_s").alias("ideal_cycle_s"))
    )
    return rounded(effectiveness.oee_by(rows, cycles=cycles))


@query(
    ctes(*BASE, sql.oee("judged", "line_id"))
    + """select line_id, format('{:.2f}', availability) as availability,
  format('{:.2f}', performance) as performance, format('{:.2f}', quality) as quality,
  format('{:.2f}', oee) as oee,
  case when oee >= 0.75 then 'green' when oee >= 0.65 then 'yellow' else 'red' end as band
from result"""
)
def oee_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return effectiveness.oee_table(effectiveness.oee_by(judged(spark, sf_dir)))


@query(
    ctes(*RUNS, sql.oee("runs", "run_index, line_id"))
    + """select run_index, line_id, round(oee, 6) as oee,
  case when oee >= 0.75 then 'green' when oee >= 0.65 then 'yellow' else 'red' end as band
from result""",
    name="oee_band",
)
def oee_band_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _oee_by_run(spark, sf_dir).withColumn("band", oee_band(F.col("oee")))
    return rounded(result.select("run_index", "line_id", "oee", "band"))


@query(
    ctes(*RUNS, sql.oee("runs", "run_index, line_id"))
    + """select line_id, min(run_index) as first_run, max(run_index) as last_run,
  round(arg_min(oee, run_index), 6) as first_oee, round(arg_max(oee, run_index), 6) as last_oee,
  round(arg_max(oee, run_index) - arg_min(oee, run_index), 6) as oee_drift
from result group by line_id"""
)
def oee_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(effectiveness.drift(_oee_by_run(spark, sf_dir), "run_index"))


@query(
    ctes(*RUNS, sql.oee("runs", "run_index, line_id"))
    + """, whole as (select line_id,
    coalesce(sum(planned_min) filter (not malformed), 0) as planned_min,
    count(*) as n_rows from judged where line_id is not null group by line_id)
select 'whole table' as run, line_id, round(planned_min, 6) as planned_min from whole
union all
select 'run ' || run_index, line_id, round(planned_min, 6) from result"""
)
def union_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the whole table and of its runs, one below the other."""
    whole = effectiveness.oee_by(judged(spark, sf_dir)).withColumn("run", F.lit("whole table"))
    runs = _oee_by_run(spark, sf_dir).withColumn(
        "run", F.concat(F.lit("run "), F.col("run_index").cast("string"))
    )
    both = whole.unionByName(runs.drop("run_index"))
    return rounded(both.select("run", "line_id", "planned_min"))


def _oee_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = run_rows(spark, sf_dir).withColumn("run_index", F.col("window_index"))
    return effectiveness.oee_by(rows, ["run_index", "line_id"])
