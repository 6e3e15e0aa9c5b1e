"""Exact quantiles that never gather a key in one task.

The values of a key are first counted per distinct value, which spreads a hot
key over all its values. The counts are then searched by prefix: first over
``value >> shift``, then inside the one or two prefixes that hold the wanted
ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewarden.session import settle

PREFIX_SHIFT = 20
#: Half the width of a bracket, as a share of the ranks; a sketch errs by less.
BRACKET = 0.02


def exact_quantile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    q: float,
    *,
    weight: str | None = None,
    name: str = "quantile",
    largest: str | None = None,
    shift: int = PREFIX_SHIFT,
) -> DataFrame:
    """Interpolated quantile of a bigint column per key, as a double.

    Returns the keys, ``name`` and ``n_values``, and with ``largest`` the
    maximum under that name. Null values and null keys are left out. ``weight``
    names a column of repeat counts.
    """
    keys = list(keys)
    repeats = F.sum(weight) if weight else F.count(F.lit(1))
    # The counts are read twice. Both reads must carry the same filters, or
    # Spark would not reuse the exchange below them.
    present = F.col(value).isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    counts = (
        df.filter(present)
        .groupBy(*keys, F.coalesce(F.col(value), F.lit(0)).alias("_v"))
        .agg(repeats.alias("_n"))
        .filter(F.col("_n") > 0)
        .withColumn("_p", F.shiftright("_v", shift))
    )

    prefixes = counts.groupBy(*keys, "_p").agg(
        F.sum("_n").alias("_n"), F.max("_v").alias("_top")
    )
    in_key = Window.partitionBy(*keys)
    up_to = in_key.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    position = (F.col("_total") - 1) * F.lit(float(q))
    ranked = (
        prefixes.withColumns(
            {
                "_total": F.sum("_n").over(in_key),
                "_top": F.max("_top").over(in_key),
                "_end": F.sum("_n").over(up_to),
            }
        )
        .withColumns({"_lo": F.floor(position), "_hi": F.ceil(position)})
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    chosen = ranked.filter(_covers("_lo") | _covers("_hi")).select(
        *keys, "_p", "_start", "_total", "_top", "_lo", "_hi"
    )

    joined = counts.join(chosen, [*keys, "_p"])
    in_prefix = (
        Window.partitionBy(*keys, "_p")
        .orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = joined.withColumn("_end", F.col("_start") + F.sum("_n").over(in_prefix)).withColumn(
        "_start", F.col("_end") - F.col("_n")
    )
    low, high = F.col("_low"), F.col("_high")
    fraction = (F.col("_total") - 1) * F.lit(float(q)) - F.col("_lo")
    return (
        placed.filter(_covers("_lo") | _covers("_hi"))
        .groupBy(*keys)
        .agg(
            F.max(F.when(_covers("_lo"), F.col("_v"))).alias("_low"),
            F.max(F.when(_covers("_hi"), F.col("_v"))).alias("_high"),
            F.first("_total").alias("_total"),
            F.first("_lo").alias("_lo"),
            F.first("_top").alias("_top"),
        )
        .select(
            *keys,
            (low + (high - low) * fraction).alias(name),
            F.col("_total").alias("n_values"),
            *([F.col("_top").alias(largest)] if largest else []),
        )
    )


def bracketed_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, *, name: str = "quantile"
) -> DataFrame:
    """The same quantile where most values of a key are distinct.

    A sketch per key, of a fixed size, names two values that should enclose the wanted ranks.
    A second pass counts the values below and inside exactly, and only those inside, some
    hundredths of all, are exchanged. The counts prove the bracket; a key whose ranks lie
    outside it takes the way of ``exact_quantile``. The rows are read up to three times, so
    give a table that is cheap to read.
    """
    keys = list(keys)
    present = F.col(value).isNotNull()
    for key in keys:
        present = present & F.col(key).isNotNull()
    rows = df.filter(present).select(*keys, F.col(value).alias("_v"))
    sketches = rows.groupBy(*keys).agg(F.kll_sketch_agg_bigint("_v").alias("_s"))

    def at(rank: float):
        return F.kll_sketch_get_quantile_bigint("_s", F.lit(min(1.0, max(0.0, rank))))

    brackets = sketches.select(*keys, at(q - BRACKET).alias("_from"), at(q + BRACKET).alias("_to"))
    brackets = settle(brackets, "brackets")
    inside = F.col("_v").between(F.col("_from"), F.col("_to"))
    placed = rows.join(brackets, keys)
    counts = placed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(F.col("_v") < F.col("_from")).alias("_below"),
        F.count_if(inside).alias("_inside"),
    )
    position = (F.col("_total") - 1) * F.lit(float(q))
    counts = counts.withColumns({"_lo": F.floor(position), "_hi": F.ceil(position)})
    proved = (F.col("_lo") >= F.col("_below")) & (F.col("_hi") < F.col("_below") + F.col("_inside"))
    counts = settle(counts.withColumn("_proved", proved), "bracket-counts")
    good = counts.filter("_proved")
    # Ranks inside the bracket, of values that are counted before they are exchanged.
    repeats = placed.filter(inside).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    block = _ranked(repeats.withColumn("_p", F.shiftright("_v", PREFIX_SHIFT)), keys)
    # A rank that is not whole lies between two.
    found = block.join(good, keys).filter(_between("_lo") | _between("_hi"))
    found = found.groupBy(*keys).agg(
        F.max(F.when(_between("_lo"), F.col("_v"))).alias("_low"),
        F.max(F.when(_between("_hi"), F.col("_v"))).alias("_high"),
        F.first("_total").alias("_total"),
        F.first("_lo").alias("_lo"),
    )
    low, high = F.col("_low"), F.col("_high")
    fraction = (F.col("_total") - 1) * F.lit(float(q)) - F.col("_lo")
    exact = found.select(
        *keys, (low + (high - low) * fraction).alias(name), F.col("_total").alias("n_values")
    )
    missed = counts.filter("not _proved").select(*keys)
    if missed.isEmpty():
        return exact
    rest = rows.join(missed, keys, "left_semi")
    return exact.unionByName(exact_quantile(rest, keys, "_v", q, name=name))


def _ranked(repeats: DataFrame, keys: list[str]) -> DataFrame:
    """First rank (``_start``) and the one behind the last (``_end``) of each counted value."""
    in_key = Window.partitionBy(*keys).orderBy("_p")
    before = in_key.rowsBetween(Window.unboundedPreceding, -1)
    sizes = repeats.groupBy(*keys, "_p").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select(*keys, "_p", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_first"))
    in_prefix = Window.partitionBy(*keys, "_p").orderBy("_v")
    up_to = in_prefix.rowsBetween(Window.unboundedPreceding, 0)
    ranked = repeats.join(settle(sizes, "prefix-sizes"), [*keys, "_p"])
    ranked = ranked.withColumn("_end", F.col("_first") + F.sum("_n").over(up_to))
    return ranked.withColumn("_start", F.col("_end") - F.col("_n")).select(
        *keys, "_v", "_start", "_end"
    )


def _between(rank: str):
    place = F.col(rank) - F.col("_below")
    return (place >= F.col("_start")) & (place < F.col("_end"))


def _covers(rank: str):
    return (F.col(rank) >= F.col("_start")) & (F.col(rank) < F.col("_end"))
