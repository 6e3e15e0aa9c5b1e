"""Accounting of provider calls over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.operators import provider_calls as calls
from linewarden.operators.ledger import event_logs
from linewarden.plans.registry import query, rounded
from linewarden.plans.sql import ATTEMPTS, ctes
from linewarden.plans import fixtures


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.call_attempts(spark, sf_dir)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.served_by(_attempts(spark, sf_dir))


@query(ctes(ATTEMPTS) + "select call_id, attempt, provider, outcome from classified")
def llm_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = calls.classify(_attempts(spark, sf_dir))
    return rows.select("call_id", "attempt", "provider", "outcome")


@query(
    ctes(ATTEMPTS)
    + """select call_id, attempt, provider, request_model, response_model, input_tokens,
  output_tokens, finish_reason, content, duration_ns from answers"""
)
def llm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.usage(calls.classify(_attempts(spark, sf_dir))).drop("started_us")


@query(
    ctes(ATTEMPTS) + "select call_id, provider, fallback_used, attempts, content from served"
)
def llm_served_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _served(spark, sf_dir).select(
        "call_id", "provider", "fallback_used", "attempts", "content"
    )


@query(
    ctes(ATTEMPTS)
    + """select c.call_id, cast(count(f.error) as int) as n_failures,
  case when count(f.error) = 0 then 'no LLM provider is configured'
    else 'all LLM providers failed: ' || string_agg(f.error, ' | ' order by f.attempt) end
    as message, coalesce(string_agg(f.body, ' | ' order by f.attempt), '') as bodies
from classified c left join failures f using (call_id, attempt)
group by c.call_id having not bool_or(c.outcome = 'ok')"""
)
def llm_unanswered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.unanswered(_attempts(spark, sf_dir))


@query(
    ctes(ATTEMPTS)
    + """select error as body, 13 as severity, 'WARN' as severity_text,
  cast(call_id as varchar) as call_id, cast(attempt as varchar) as attempt from failures"""
)
def log_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warning for every provider that failed."""
    failed = calls.classify(_attempts(spark, sf_dir)).where("error IS NOT NULL")
    attrs = ["call_id", "attempt", "provider", "outcome"]
    logs = event_logs(failed, F.col("error"), "warning", attrs)
    shown = [F.col("attrs")[c].alias(c) for c in attrs[:2]]
    return logs.select("body", "severity", "severity_text", *shown)


@query(
    ctes(ATTEMPTS)
    + """select * from (
  select call_id, provider, request_model, 'input' as token_type, input_tokens as tokens
  from served
  union all select call_id, provider, request_model, 'output', output_tokens from served)
where tokens is not null"""
)
def token_usage_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.token_usage(_served(spark, sf_dir))


@query(
    ctes(ATTEMPTS)
    + """select provider, request_model, count(*) as n_calls,
  round(sum(duration_ns) / 1e9, 6) as sum_s,
  round(quantile_cont(duration_ns, 0.95) / 1e9, 6) as p95_s
from served group by provider, request_model"""
)
def llm_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(calls.durations(_served(spark, sf_dir)))


@query(
    ctes(ATTEMPTS)
    + """select call_id, 'llm_ask' as name, started_us * 1000 as start_ns,
  started_us * 1000 + duration_ns as end_ns, provider as gen_ai_system, request_model,
  response_model, cast(input_tokens as varchar) as input_tokens,
  cast(output_tokens as varchar) as output_tokens, finish_reason as finish_reasons,
  fallback_used, attempts
from served"""
)
def llm_call_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    attrs = F.col("attrs")
    return calls.call_rows(_served(spark, sf_dir)).select(
        "call_id",
        "name",
        "start_ns",
        "end_ns",
        "gen_ai_system",
        "request_model",
        attrs["gen_ai.response.model"].alias("response_model"),
        attrs["gen_ai.usage.input_tokens"].alias("input_tokens"),
        attrs["gen_ai.usage.output_tokens"].alias("output_tokens"),
        attrs["gen_ai.response.finish_reasons"].alias("finish_reasons"),
        "fallback_used",
        "attempts",
    )
