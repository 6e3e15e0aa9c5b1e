"""Line facts out of the ledger, their trend, and evidence text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.numbers import fixed_text, plain_text
from linewarden.operators.ordered import Running, running
from linewarden.schema import STAGES

RUN_SHIFT = 16

_CLEAN_FACTS = {"rows_in": 0, "rows_out": 0, "rows_dropped": 0, "null_ratio": 0.0, "stale_batch": False}
_OEE_FACTS = {"availability": 0.0, "performance": 0.0, "quality": 0.0, "oee": 0.0}


def duration_ms() -> Column:
    return (F.col("end_ns") - F.col("start_ns")) / F.lit(1_000_000.0)


def stage_durations(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("name").isin(STAGES)).select(
        "run_index", "line_id", "name", F.bround(duration_ms(), 2).alias("duration_ms")
    )


def line_facts(ledger: DataFrame) -> DataFrame:
    """One row per run and line; the last row of a stage wins.

    Data quality comes from the clean stage, the OEE factors from aggregate,
    a duration from every stage. What is absent counts as 0 or false.
    """
    spans = ledger.filter(F.col("name").isin(STAGES) & F.col("line_id").isNotNull())

    def newest(stage: str, value: Column) -> Column:
        return F.max_by(value, F.when(F.col("name") == stage, F.col("end_ns")))

    stage_ms = [x for s in STAGES for x in (F.lit(s), newest(s, F.bround(duration_ms(), 2)))]
    return spans.groupBy("run_index", "line_id").agg(
        *[
            F.coalesce(newest("clean", F.col(c)), F.lit(zero)).alias(c)
            for c, zero in _CLEAN_FACTS.items()
        ],
        *[
            F.coalesce(newest("aggregate", F.col(c)), F.lit(zero)).alias(c)
            for c, zero in _OEE_FACTS.items()
        ],
        F.map_filter(F.create_map(*stage_ms), lambda _, ms: ms.isNotNull()).alias("stage_ms"),
    )


def run_trend(facts: DataFrame, shift: int = RUN_SHIFT) -> DataFrame:
    """Each run of a line beside the run before."""
    seen = running(
        facts.select("run_index", "line_id", "oee", "rows_dropped", "null_ratio"),
        ["line_id"],
        "run_index",
        [Running("_before", F.struct("oee", "rows_dropped", "null_ratio"))],
        shift=shift,
    )
    before = F.col("_before")
    return seen.select(
        "run_index",
        "line_id",
        "oee",
        before["oee"].alias("previous_oee"),
        (F.col("oee") - before["oee"]).alias("oee_change"),
        (F.col("rows_dropped") - before["rows_dropped"]).alias("rows_dropped_change"),
        (F.col("null_ratio") - before["null_ratio"]).alias("null_ratio_change"),
    )


def evidence_lines(facts: DataFrame) -> DataFrame:
    """One line of text per run and line, every number as on the ledger."""
    stages = F.array_join(
        F.transform(
            F.array_sort(F.map_entries("stage_ms")),
            lambda e: F.concat(e["key"], F.lit("="), plain_text(e["value"]), F.lit("ms")),
        ),
        " ",
    )

    def show(label: str, text: Column) -> list[Column]:
        return [F.lit(f"{label}="), text]

    def number(name: str) -> Column:
        return F.col(name).cast("string")

    # The labels of an evidence line.
    text = F.concat(
        F.lit("  "),
        "line_id",
        F.lit(": "),
        *show("rows_in", number("rows_in")),
        *show(" rows_out", number("rows_out")),
        *show(" rows_dropped", number("rows_dropped")),
        *show(" null_ratio", fixed_text(F.col("null_ratio"), 3)),
        *show(" stale_batch", F.initcap(number("stale_batch"))),
        *show(" | availability", fixed_text(F.col("availability"), 2)),
        *show(" performance", fixed_text(F.col("performance"), 2)),
        *show(" quality", fixed_text(F.col("quality"), 2)),
        *show(" OEE", fixed_text(F.col("oee"), 2)),
        F.lit(" | stage durations: "),
        stages,
    )
    return facts.select("run_index", "line_id", text.alias("evidence"))


def _joined(rows: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda r: r["t"]), "\n")


def run_texts(facts: DataFrame) -> DataFrame:
    """The evidence of a run as one text; its size is the number of lines."""
    line = F.struct(F.col("line_id").alias("k"), F.col("evidence").alias("t"))
    return evidence_lines(facts).groupBy("run_index").agg(_joined(line).alias("body"))


def run_contexts(facts: DataFrame) -> DataFrame:
    """A context of its own for every single run."""
    head = F.lit("Pipeline telemetry: 1 run(s).\n\nRun:\n")
    return run_texts(facts).select("run_index", F.concat(head, "body").alias("context"))


def trend_context(facts: DataFrame) -> DataFrame:
    """The context over all runs, a row for each, oldest first.

    ``head`` opens the text, ``section`` is the part of one run; the context is the head
    and the sections in the order of ``run_number``, a line end between each.
    """
    numbered = number_runs(run_texts(facts))
    count = numbered.agg(F.count(F.lit(1)).alias("n")).scalar()
    many = F.col("n_runs") > 1
    # The texts of a context.
    title = F.when(
        many, F.concat(F.lit("\nRun "), F.col("run_number").cast("string"), F.lit(":\n"))
    ).otherwise("\nRun:\n")
    head = F.concat(
        F.lit("Pipeline telemetry: "),
        F.col("n_runs").cast("string"),
        F.when(many, " run(s), oldest first — use this to judge trends.").otherwise(" run(s)."),
    )
    return numbered.withColumn("n_runs", count).select(
        "run_index", "run_number", "n_runs", head.alias("head"), F.concat(title, "body").alias("section")
    )


def prompts(contexts: DataFrame, question: Column | str) -> DataFrame:
    """Context and question as one text."""
    asked = F.lit(question) if isinstance(question, str) else question
    return contexts.withColumn("prompt", F.concat("context", F.lit("\n\nQuestion: "), asked))


def number_runs(facts: DataFrame, shift: int = RUN_SHIFT) -> DataFrame:
    """Add ``run_number``: 1 for the oldest run, and so on."""
    runs = facts.select("run_index").distinct()
    counted = running(
        runs, [], "run_index", [Running("_older", F.lit(1), "sum")], shift=shift
    )
    numbers = counted.select(
        "run_index", (F.coalesce("_older", F.lit(0)) + 1).alias("run_number")
    )
    return facts.join(numbers, "run_index")
