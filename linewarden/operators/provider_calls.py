"""Accounting over a log of provider responses: outcome, usage, fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.clocks import micros
from linewarden.functions.numbers import int_or_null, is_blank, strip
from linewarden.operators.quantiles import exact_quantile

# The operation, and how much of a body an error text shows.
OPERATION = "chat"
BODY_SHOWN = 200


def _part(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("_answer"), path, kind)


def classify(attempts: DataFrame) -> DataFrame:
    """Add ``outcome`` and, for failures, ``error``.

    An attempt at a provider without key is skipped, which is no failure. The
    whole body stays in ``body``; an error text shows its beginning.
    """
    # A content of null is an empty answer, a missing content is a bad shape.
    there = _part("$.choices[0].message.content", "variant")
    content = F.col("content")
    outcome = (
        F.when(~F.col("configured"), "skipped")
        .when(F.col("status").isNull(), "transport_error")
        .when(F.col("status") != 200, "http_error")
        .when(content.isNull() & there.isNull(), "bad_shape")
        .when(is_blank(content), "empty_answer")
        .otherwise("ok")
    )
    error = (
        F.when(F.col("outcome") == "transport_error", F.lit(" request failed"))
        .when(
            F.col("outcome") == "http_error",
            F.concat(
                F.lit(" returned HTTP "),
                F.col("status").cast("string"),
                F.lit(": "),
                F.substring(F.coalesce("body", F.lit("")), 1, BODY_SHOWN),
            ),
        )
        .when(F.col("outcome") == "bad_shape", F.lit(" returned an unexpected response shape"))
        .when(F.col("outcome") == "empty_answer", F.lit(" returned an empty answer"))
    )
    return (
        attempts.withColumn("_answer", F.try_parse_json("body"))
        .withColumn("content", strip(_part("$.choices[0].message.content")))
        .withColumn("outcome", outcome)
        .withColumn("error", F.concat("provider", error))
    )


_USAGE_COLUMNS = [
    "call_id",
    "attempt",
    "provider",
    "request_model",
    "response_model",
    "input_tokens",
    "output_tokens",
    "finish_reason",
    "content",
    "started_us",
    "duration_ns",
]


def _with_usage(classified: DataFrame) -> DataFrame:
    named = _part("$.model")
    return classified.withColumns(
        {
            "request_model": F.col("model"),
            "response_model": F.coalesce(F.when(named != "", named), F.col("model")),
            "input_tokens": int_or_null(_part("$.usage.prompt_tokens", "variant")),
            "output_tokens": int_or_null(_part("$.usage.completion_tokens", "variant")),
            "finish_reason": _part("$.choices[0].finish_reason"),
            "started_us": micros(F.col("started_at")),
            # Null where the time is beyond a long of nanoseconds, which is 292 years.
            "duration_ns": F.round(F.col("duration_s") * 1e9).try_cast("bigint"),
        }
    )


def usage(classified: DataFrame) -> DataFrame:
    """Tokens, model and finish reason of the answers; odd values are null."""
    answers = classified.filter(F.col("outcome") == "ok")
    return _with_usage(answers).select(*_USAGE_COLUMNS)


def served_by(attempts: DataFrame) -> DataFrame:
    """The first answer of each call, and whether a failure came before it.

    A call has one attempt per provider, so its group is as small as the list
    of providers.
    """
    tried = _with_usage(classify(attempts))
    ok = F.col("outcome") == "ok"
    failed = ~F.col("outcome").isin("ok", "skipped")
    answer = F.struct(*_USAGE_COLUMNS[1:])
    return (
        tried.groupBy("call_id")
        .agg(
            F.min_by(answer, F.when(ok, F.col("attempt"))).alias("_answer"),
            F.min(F.when(failed, F.col("attempt"))).alias("_failed"),
        )
        .filter(F.col("_answer").isNotNull())
        .select(
            "call_id",
            "_answer.*",
            F.coalesce(F.col("_failed") < F.col("_answer.attempt"), F.lit(False)).alias(
                "fallback_used"
            ),
            (F.col("_answer.attempt") + 1).alias("attempts"),
        )
    )


def unanswered(attempts: DataFrame) -> DataFrame:
    """Calls without an answer, with the errors and whole bodies of all providers tried."""
    classified = classify(attempts)
    errors = F.array_sort(
        F.collect_list(
            F.when(F.col("error").isNotNull(), F.struct("attempt", "error", "body"))
        )
    )
    joined = F.array_join(F.transform("_errors", lambda e: e["error"]), " | ")
    return (
        classified.groupBy("call_id")
        .agg(F.bool_or(F.col("outcome") == "ok").alias("_ok"), errors.alias("_errors"))
        .filter(~F.col("_ok"))
        .select(
            "call_id",
            F.size("_errors").alias("n_failures"),
            F.when(F.size("_errors") == 0, "no LLM provider is configured")
            .otherwise(F.concat(F.lit("all LLM providers failed: "), joined))
            .alias("message"),
            F.array_join(F.transform("_errors", lambda e: e["body"]), " | ").alias("bodies"),
        )
    )


def token_usage(served: DataFrame) -> DataFrame:
    """One row per call and token type; absent counts leave no row."""
    kinds = F.array(
        F.struct(F.lit("input").alias("token_type"), F.col("input_tokens").alias("tokens")),
        F.struct(F.lit("output").alias("token_type"), F.col("output_tokens").alias("tokens")),
    )
    return served.select("call_id", "provider", "request_model", F.inline(kinds)).filter(
        F.col("tokens").isNotNull()
    )


def durations(served: DataFrame, q: float = 0.95) -> DataFrame:
    """Count, sum and quantile of the call time per provider and model.

    A call without a usable time counts, but adds nothing to the sum and the quantile.
    """
    keys = ["provider", "request_model"]
    sums = served.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_calls"),
        (F.sum(F.col("duration_ns").cast("decimal(19,0)")).cast("double") / 1e9).alias("sum_s"),
    )
    timed = served.filter(F.col("duration_ns").isNotNull())
    quantile = exact_quantile(timed, keys, "duration_ns", q, name="_ns")
    return sums.join(quantile, keys, "left").select(
        *keys, "n_calls", "sum_s", (F.col("_ns") / 1e9).alias("p95_s")
    )


def call_rows(served: DataFrame) -> DataFrame:
    """Served calls as ledger rows; absent attributes are left out."""
    # Attribute names.
    attrs = {
        "gen_ai.operation.name": F.lit(OPERATION),
        "gen_ai.system": F.col("provider"),
        "gen_ai.request.model": F.col("request_model"),
        "gen_ai.response.model": F.col("response_model"),
        "gen_ai.usage.input_tokens": F.col("input_tokens").cast("string"),
        "gen_ai.usage.output_tokens": F.col("output_tokens").cast("string"),
        "gen_ai.response.finish_reasons": F.col("finish_reason"),
        "provider": F.col("provider"),
        "model": F.col("request_model"),
        "fallback_used": F.col("fallback_used").cast("string"),
        "attempts": F.col("attempts").cast("string"),
    }
    pairs = [x for name, value in attrs.items() for x in (F.lit(name), value)]
    start_ns = F.col("started_us") * 1000
    return served.select(
        "call_id",
        F.lit("llm_ask").alias("name"),
        start_ns.alias("start_ns"),
        F.try_add(start_ns, F.col("duration_ns")).alias("end_ns"),
        "duration_ns",
        F.col("provider").alias("gen_ai_system"),
        "request_model",
        "input_tokens",
        "output_tokens",
        "fallback_used",
        "attempts",
        F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & (v != "")).alias("attrs"),
    )
