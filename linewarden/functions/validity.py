"""When a record is malformed, and why."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linewarden.functions.numbers import is_blank
from linewarden.schema import NUMERIC_COLUMNS


def _rules() -> dict[str, Column]:
    """One test per rule, on columns that are already coerced to numbers."""
    total, good, planned = F.col("total_count"), F.col("good_count"), F.col("planned_min")
    absent = F.lit(False)
    for name in NUMERIC_COLUMNS:
        absent = absent | F.col(name).isNull()
    return {
        "non_numeric": absent,
        "negative_count": (total < 0) | (good < 0),
        "good_exceeds_total": good > total,
        "non_positive_planned": planned <= 0,
        "blank_batch": is_blank(F.col("batch_id")),
        "blank_line": is_blank(F.col("line_id")),
    }


def malformed() -> Column:
    """True where any rule is broken; a rule that cannot be decided is.

    Said the other way round, each column is named once or twice: a good count
    from zero up to the total leaves no room for a negative total, and a null
    fails every comparison. The expression stays small when Spark moves it
    into a filter.
    """
    valid = (
        F.col("good_count").between(F.lit(0.0), F.col("total_count"))
        & (F.col("planned_min") > 0)
        & F.col("downtime_min").isNotNull()
        & F.col("ideal_cycle_s").isNotNull()
        & ~is_blank(F.col("batch_id"))
        & ~is_blank(F.col("line_id"))
    )
    return ~F.coalesce(valid, F.lit(False))


def malformed_reasons() -> Column:
    """The broken rules by name, as an array."""
    return F.array_compact(
        F.array(*[F.when(test, F.lit(name)) for name, test in _rules().items()])
    )


def threshold_breach(temp_max: float) -> Column:
    """A present temperature above the limit; NaN is no temperature."""
    temperature = F.col("temperature")
    return F.coalesce(
        ~F.isnan(temperature) & (temperature > F.lit(float(temp_max))), F.lit(False)
    )
