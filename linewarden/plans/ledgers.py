"""The stage ledger, its logs, facts, evidence, panels and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.operators import alerts, facts, ledger, panels
from linewarden.operators.provider_calls import call_rows, served_by
from linewarden.operators.windows import find_origin, window_contents
from linewarden.plans import sql
from linewarden.plans.quality import RUN_CONFIG, judged, run_rows
from linewarden.plans.registry import query, rounded
from linewarden.plans.sql import FACTS, RUN_LEDGER, ctes
from linewarden.schema import OEE_FLOOR, STAGES
from linewarden.session import new_path
from linewarden.plans import fixtures
from linewarden.sources.sinks import read_ledger, write_ledger

SILENCE_S = 900.0
LAG_LIMIT_MS = 1_200_000.0
QUESTION = "Why did the OEE of line_3 move?"

_MEASURES = (
    "name, line_id, rows_in, rows_out, rows_dropped, null_ratio, stale_batch, "
    "availability, performance, quality, oee"
)


def run_ledger(spark: SparkSession, sf_dir: str, stale: bool = False) -> DataFrame:
    """The ledger of every run; only readers of its stale flag ask for that."""
    return ledger.stage_ledger(run_rows(spark, sf_dir), "window_index", stale)


def run_facts(spark: SparkSession, sf_dir: str, stale: bool = True) -> DataFrame:
    return facts.line_facts(run_ledger(spark, sf_dir, stale))


@query(
    ctes(*sql.BASE, sql.ledger("judged", "0"))
    + f"select {_MEASURES}, start_ns, end_ns from ledger"
)
def stage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run over the whole table."""
    columns = [c.strip() for c in _MEASURES.split(",")]
    return ledger.stage_ledger(judged(spark, sf_dir)).select(*columns, "start_ns", "end_ns")


@query(
    ctes(*RUN_LEDGER)
    + f"""select run_index, {_MEASURES}, start_ns, end_ns, cast(null as varchar) as window_lines
from ledger
union all
select window_index, 'stream_window', null, null, null, null, null, null, null, null, null, null,
  min(arrival_us) * 1000, max(arrival_us) * 1000,
  array_to_string(list_sort(list_distinct(list(line_id) filter (line_id is not null))), ',')
from placed group by window_index"""
)
def span_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage and window rows through the ledger sink and back."""
    rows = run_rows(spark, sf_dir)
    contents = window_contents(
        rows.withColumns({"assigned_window": F.col("window_index"), "late": F.lit(False)})
    )
    origin = find_origin(rows, RUN_CONFIG.width_us)
    path = new_path(spark, "ledger")
    write_ledger(ledger.stage_ledger(rows, "window_index"), path)
    write_ledger(ledger.window_spans(contents, origin, RUN_CONFIG.width_us), path)
    columns = [c.strip() for c in _MEASURES.split(",")]
    return read_ledger(spark, path).select(
        "run_index",
        *columns,
        "start_ns",
        "end_ns",
        F.col("attrs")["window.lines"].alias("window_lines"),
    )


@query(
    ctes(*RUN_LEDGER)
    + """select name as body, 9 as severity, 'INFO' as severity_text,
  'run-' || run_index || '/' || line_id || '/' || name as span_id,
  end_ns as observed_ns, cast(rows_out as varchar) as rows_out,
  1 + (rows_in is not null)::int * 5 + (name = 'aggregate')::int * 4
    + (name = 'pipeline_run')::int as n_attrs
from ledger"""
)
def log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = ledger.log_records(run_ledger(spark, sf_dir, stale=True))
    return logs.select(
        "body",
        "severity",
        "severity_text",
        "span_id",
        "observed_ns",
        F.col("attrs")["rows_out"].alias("rows_out"),
        F.size("attrs").alias("n_attrs"),
    )


@query(
    ctes(*RUN_LEDGER)
    + "select run_index, name, count(*) as n_spans from ledger group by run_index, name"
)
def span_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.span_counts(run_ledger(spark, sf_dir))


@query(
    ctes(*RUN_LEDGER)
    + """select run_index, line_id, name, round((end_ns - start_ns) / 1e6, 2) as duration_ms
from ledger where name <> 'pipeline_run'"""
)
def stage_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.stage_durations(run_ledger(spark, sf_dir))


@query(
    ctes(*FACTS)
    + """select run_index, line_id, rows_in, rows_out, rows_dropped, null_ratio, stale_batch,
  availability, performance, quality, oee, ms_aggregate, ms_clean, ms_ingest, ms_transform
from facts"""
)
def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = run_facts(spark, sf_dir)
    stages = {f"ms_{s}": F.col("stage_ms")[s] for s in STAGES}
    return wide.withColumns(stages).drop("stage_ms")


@query(
    ctes(*FACTS)
    + """select dense_rank() over (order by run_index) as run_number, run_index, line_id, oee,
  rows_dropped from facts"""
)
def run_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = facts.number_runs(run_facts(spark, sf_dir))
    return numbered.select("run_number", "run_index", "line_id", "oee", "rows_dropped")


@query(
    ctes(*FACTS)
    + """select run_index, line_id, oee, lag(oee) over w as previous_oee,
  round(oee - lag(oee) over w, 6) as oee_change,
  rows_dropped - lag(rows_dropped) over w as rows_dropped_change,
  round(null_ratio - lag(null_ratio) over w, 6) as null_ratio_change
from facts window w as (partition by line_id order by run_index)"""
)
def run_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(facts.run_trend(run_facts(spark, sf_dir, stale=False)))


_EVIDENCE = """, evidence as (
  select run_index, line_id, '  ' || line_id || ': rows_in=' || rows_in || ' rows_out=' || rows_out
    || ' rows_dropped=' || rows_dropped || format(' null_ratio={:.3f}', null_ratio)
    || ' stale_batch=' || case when stale_batch then 'True' else 'False' end
    || format(' | availability={:.2f} performance={:.2f}', availability, performance)
    || format(' quality={:.2f} OEE={:.2f} | stage durations: ', quality, oee)
    || 'aggregate=' || ms(ms_aggregate) || 'ms clean=' || ms(ms_clean)
    || 'ms ingest=' || ms(ms_ingest) || 'ms transform=' || ms(ms_transform) || 'ms' as evidence
  from facts)
"""
for _stage in STAGES:
    _EVIDENCE = _EVIDENCE.replace(
        f"ms(ms_{_stage})",
        f"regexp_replace(cast(cast(ms_{_stage} as decimal(38, 2)) as varchar), '0$', '')",
    )


@query(ctes(*FACTS) + _EVIDENCE + "select run_index, line_id, evidence from evidence")
def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.evidence_lines(run_facts(spark, sf_dir))


@query(
    ctes(*FACTS)
    + _EVIDENCE
    + f"""select run_index, 'Pipeline telemetry: 1 run(s).' || chr(10) || chr(10) || 'Run:'
  || chr(10) || string_agg(evidence, chr(10) order by line_id)
  || chr(10) || chr(10) || 'Question: {QUESTION}' as prompt
from evidence group by run_index"""
)
def evidence_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per run, from the evidence of all its lines."""
    contexts = facts.run_contexts(run_facts(spark, sf_dir))
    return facts.prompts(contexts, QUESTION).select("run_index", "prompt")


@query(
    ctes(*FACTS)
    + _EVIDENCE
    + """, all_runs as (
  select run_index, row_number() over (order by run_index) as k, count(*) over () as n
  from (select distinct run_index from facts))
select run_index, k as run_number, n as n_runs,
  'Pipeline telemetry: ' || n || case when n > 1
    then ' run(s), oldest first — use this to judge trends.' else ' run(s).' end as head,
  chr(10) || case when n > 1 then 'Run ' || k || ':' else 'Run:' end
    || chr(10) || string_agg(evidence, chr(10) order by line_id) as section
from evidence join all_runs using (run_index) group by run_index, k, n"""
)
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend over all runs."""
    return facts.trend_context(run_facts(spark, sf_dir))


# --- panels ----------------------------------------------------------------------

_STEP = "(start_ns // 1000) - (start_ns // 1000) % 60000000 as step_us"


def _series(spark: SparkSession, sf_dir: str, name: str, column: str, label: str = "") -> DataFrame:
    return panels.panel(
        run_ledger(spark, sf_dir),
        F.avg(column),
        ["line_id"],
        where=(F.col("service") == ledger.SERVICE) & (F.col("name") == name),
        legend=F.concat(F.lit(label), "line_id"),
    )


def _series_sql(name: str, column: str, label: str = "") -> str:
    return f"""select {_STEP}, line_id, round(avg({column}), 6) as value,
  '{label}' || line_id as legend from ledger where name = '{name}' group by all"""


@query(
    ctes(*RUN_LEDGER)
    + f"""select {_STEP}, name, round(avg(end_ns - start_ns), 6) as value, name as legend
from ledger where name in ('ingest', 'clean', 'transform', 'aggregate') group by all"""
)
def panel_stage_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (F.col("service") == ledger.SERVICE) & F.col("name").isin(STAGES)
    return rounded(
        panels.panel(
            run_ledger(spark, sf_dir),
            F.avg(F.col("end_ns") - F.col("start_ns")),
            ["name"],
            where=where,
            legend=F.col("name"),
        )
    )


@query(ctes(*RUN_LEDGER) + _series_sql("clean", "rows_dropped", "dropped "))
def panel_rows_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_series(spark, sf_dir, "clean", "rows_dropped", "dropped "))


@query(ctes(*RUN_LEDGER) + _series_sql("clean", "null_ratio", "null_ratio "))
def panel_null_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_series(spark, sf_dir, "clean", "null_ratio", "null_ratio "))


@query(ctes(*RUN_LEDGER) + _series_sql("aggregate", "oee"))
def panel_oee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_series(spark, sf_dir, "aggregate", "oee"))


_CALL_STEP = "started_us - started_us % 60000000 as step_us"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_rows(served_by(fixtures.call_attempts(spark, sf_dir)))


@query(
    ctes(sql.ATTEMPTS)
    + f"""select {_CALL_STEP}, provider as gen_ai_system,
  cast(sum(input_tokens) as bigint) as value, 'input ' || provider as legend
from served group by all
union all
select {_CALL_STEP}, provider, cast(sum(output_tokens) as bigint), 'output ' || provider
from served group by all"""
)
def panel_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both series of the panel, from one pass over the calls."""

    def side(name: str):
        return F.struct(
            F.sum(f"{name}_tokens").alias("value"),
            F.concat(F.lit(f"{name} "), "gen_ai_system").alias("legend"),
        )

    both = F.array(side("input"), side("output"))
    series = panels.panel(_calls(spark, sf_dir), both, ["gen_ai_system"])
    return series.select("step_us", "gen_ai_system", F.inline("value"))


@query(
    ctes(sql.ATTEMPTS)
    + f"""select {_CALL_STEP}, provider as gen_ai_system,
  round(quantile_cont(duration_ns, 0.95), 1) as value, count(*) as n_values,
  'p95 ' || provider as legend
from served where duration_ns is not null group by all"""
)
def panel_llm_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = panels.quantile_panel(
        _calls(spark, sf_dir), "duration_ns", 0.95, ["gen_ai_system"]
    )
    return rounded(series.withColumn("legend", F.concat(F.lit("p95 "), "gen_ai_system")), 1)


@query(
    ctes(sql.ATTEMPTS)
    + f"""select {_CALL_STEP}, provider as gen_ai_system, fallback_used, count(*) as value,
  provider || ' fallback=' || cast(fallback_used as varchar) as legend
from served group by all"""
)
def panel_llm_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.panel(
        _calls(spark, sf_dir),
        F.count(F.lit(1)),
        ["gen_ai_system", "fallback_used"],
        legend=F.concat(
            "gen_ai_system", F.lit(" fallback="), F.col("fallback_used").cast("string")
        ),
    )


def _alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = alerts.triggers(judged(spark, sf_dir), RUN_CONFIG, SILENCE_S)
    feed = alerts.alert_feed(events, RUN_CONFIG.cooldown_us)
    return ledger.alert_spans(feed).withColumn("kind", F.col("attrs")["alert.kind"])


_ALERTS = [*sql.BASE, sql.triggers(900_000_000), sql.folded(3_600_000_000)]


@query(
    ctes(*_ALERTS)
    + """select line_id, kind, fired_us * 1000 as start_ns, detail,
  cast(suppressed as varchar) as suppressed from feed"""
)
def alert_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert rows through the ledger sink and back."""
    path = new_path(spark, "alert-ledger")
    write_ledger(_alert_rows(spark, sf_dir).drop("kind"), path)
    attrs = F.col("attrs")
    return read_ledger(spark, path).select(
        "line_id",
        attrs["alert.kind"].alias("kind"),
        "start_ns",
        attrs["alert.detail"].alias("detail"),
        attrs["alert.suppressed"].alias("suppressed"),
    )


@query(
    ctes(*_ALERTS)
    + """select fired_us - fired_us % 60000000 as step_us, kind, line_id, count(*) as value,
  kind || ' ' || coalesce(line_id, '') as legend
from feed group by all"""
)
def panel_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = (F.col("service") == ledger.SERVICE) & (F.col("name") == "alert")
    return panels.panel(
        _alert_rows(spark, sf_dir),
        F.count(F.lit(1)),
        ["kind", "line_id"],
        where=where,
        legend=F.concat("kind", F.lit(" "), F.coalesce("line_id", F.lit(""))),
    )


@query(
    ctes(*RUN_LEDGER)
    + f""", steps as ({_series_sql("aggregate", "oee")}),
ends as (select line_id, min(step_us) as a, max(step_us) as b from steps group by line_id),
grid as (select line_id, unnest(range(a, b + 1, 60000000)) as step_us from ends)
select g.line_id, g.step_us, coalesce(s.value, 0) as value
from grid g left join steps s on s.line_id = g.line_id and s.step_us = g.step_us"""
)
def panel_zero_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _series(spark, sf_dir, "aggregate", "oee")
    return rounded(panels.zero_fill(series, ["line_id"]))


@query(
    ctes(*RUN_LEDGER)
    + f""", steps as ({_series_sql("clean", "rows_dropped")})
select line_id, round(avg(value), 4) as avg_dropped, round(sum(value), 4) as sum_dropped,
  count(*) as n_steps from steps group by line_id"""
)
def panel_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _series(spark, sf_dir, "clean", "rows_dropped")
    averages = panels.reduce_series(series, ["line_id"], "avg").withColumnRenamed(
        "value", "avg_dropped"
    )
    sums = panels.reduce_series(series, ["line_id"], "sum").withColumnRenamed(
        "value", "sum_dropped"
    )
    return rounded(averages.join(sums.drop("n_steps"), "line_id"), 4).select(
        "line_id", "avg_dropped", "sum_dropped", "n_steps"
    )


# --- rules -----------------------------------------------------------------------


def _firing_sql(steps: str, breach: str) -> str:
    """Each step belongs to the five evaluations that start up to 4 minutes before."""
    return f""", steps as ({steps})
select step_us - k * 60000000 as eval_start_us, step_us - k * 60000000 + 300000000 as eval_end_us,
  line_id, count(*) as breaching_steps
from steps, (select unnest(range(5)) as k) where {breach} group by all"""


@query(ctes(*RUN_LEDGER) + _firing_sql(_series_sql("aggregate", "oee"), "value < 0.65"))
def rule_oee_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = _series(spark, sf_dir, "aggregate", "oee")
    return panels.firing_rule(series, ["line_id"], F.col("value") < OEE_FLOOR)


@query(
    ctes(*_ALERTS)
    + _firing_sql(
        """select fired_us - fired_us % 60000000 as step_us, line_id, count(*) as value
  from feed where kind = 'line_silent' group by all""",
        "value > 0",
    )
)
def rule_line_silent(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = panels.panel(
        _alert_rows(spark, sf_dir),
        F.count(F.lit(1)),
        ["line_id"],
        where=F.col("kind") == "line_silent",
    )
    return panels.firing_rule(series, ["line_id"], F.col("value") > 0)


@query(
    ctes(*sql.BASE)
    + _firing_sql(
        """select arrival_us - arrival_us % 60000000 as step_us, line_id,
    quantile_cont(arrival_us - ts_us, 0.95) / 1000 as value
  from judged where line_id is not null group by all""",
        "value > 1200000",
    )
)
def rule_lag_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag above twenty minutes; a step is cut by arrival time."""
    rows = (
        judged(spark, sf_dir)
        .filter(F.col("line_id").isNotNull())
        .withColumns(
            {
                "start_ns": F.col("arrival_us") * 1000,
                "lag_us": F.col("arrival_us") - F.col("ts_us"),
            }
        )
    )
    series = panels.quantile_panel(rows, "lag_us", 0.95, ["line_id"])
    return panels.firing_rule(series, ["line_id"], F.col("value") / 1000.0 > LAG_LIMIT_MS)
