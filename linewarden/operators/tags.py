"""Tag changes: routing to lines, broker messages, assembly into batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewarden.functions.clocks import device_us, micros
from linewarden.operators.ordered import SEQ_SHIFT, Running, running
from linewarden.schema import NUMERIC_COLUMNS

# The fields a batch cannot do without.
REQUIRED_FIELDS = NUMERIC_COLUMNS
TRIGGER_FIELD = "batch_id"
CONTEXT_FIELDS = [*REQUIRED_FIELDS, "temperature"]

TAG_COLUMNS = ["seq", "pos", "line_id", "field", "value", "source_us", "is_flush"]


def flatten_tag_maps(tag_maps: DataFrame) -> DataFrame:
    """Per-line maps of node id to field, as rows."""
    return tag_maps.select("line_id", F.explode("nodes").alias("node_id", "field"))


def route(changes: DataFrame, tag_map: DataFrame) -> DataFrame:
    """Changes of mapped nodes with their line and field.

    The map is a dimension table without a hint: Spark broadcasts it if its
    files are small and shuffles both sides otherwise.
    """
    return changes.drop("line_id", "field").join(tag_map, "node_id")


def unmapped(changes: DataFrame, tag_map: DataFrame) -> DataFrame:
    return changes.join(tag_map.select("node_id"), "node_id", "left_anti")


def as_tags(routed: DataFrame) -> DataFrame:
    """Routed changes in the shape that assembly reads."""
    return routed.select(
        "seq",
        F.lit(0).alias("pos"),
        "line_id",
        "field",
        "value",
        micros(F.col("source_time")).alias("source_us"),
        F.lit(False).alias("is_flush"),
    )


# --- broker messages -------------------------------------------------------------


def parse_topics(messages: DataFrame) -> DataFrame:
    """Keep topics ``spBv*/group/type/node[/device]`` and name their parts."""
    parts = F.split("topic", "/")
    return (
        messages.withColumn("_parts", parts)
        .filter((F.size("_parts") >= 4) & F.get("_parts", 0).startswith("spBv"))
        .withColumns({"msgtype": F.get("_parts", 2), "edge_node": F.get("_parts", 3)})
        .drop("_parts")
    )


def deaths(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("msgtype").endswith("DEATH"))


def decode_json(payload: Column) -> Column:
    """A JSON object as struct of line, timestamp and metrics; else null.

    The timestamp is read as a number, and stays null for a text. Any function
    from payload to the same struct can take its place, such as
    ``functions.sparkplug.decode_binary``.
    """
    body = F.from_json(payload, "line_id string, timestamp double, metrics map<string,string>")
    return F.when(F.json_object_keys(payload).isNotNull(), body)


def undecodable(parsed: DataFrame, decode: Callable[[Column], Column] = decode_json) -> DataFrame:
    """Data messages without a readable payload; they stop nothing."""
    data = parsed.filter(~F.col("msgtype").endswith("DEATH"))
    return data.filter(decode(F.col("payload")).isNull())


def message_tags(
    parsed: DataFrame, decode: Callable[[Column], Column] = decode_json
) -> DataFrame:
    """Every metric as a tag change; a death becomes a flush of its node."""
    ingest_us = micros(F.col("ingest_time"))
    data = parsed.filter(~F.col("msgtype").endswith("DEATH")).withColumn(
        "_body", decode(F.col("payload"))
    )
    # A binary payload has no text of a time.
    shown = F.col("payload").cast("string")
    stamp = device_us(F.col("_body.timestamp"), F.get_json_object(shown, "$.timestamp"))
    changes = data.select(
        "seq",
        F.coalesce(F.col("_body.line_id"), F.col("edge_node")).alias("line_id"),
        F.coalesce(stamp, ingest_us).alias("source_us"),
        F.posexplode("_body.metrics").alias("pos", "field", "value"),
        F.lit(False).alias("is_flush"),
    )
    flushes = deaths(parsed).select(
        "seq",
        F.col("edge_node").alias("line_id"),
        F.lit(None).cast("bigint").alias("source_us"),
        F.lit(0).alias("pos"),
        F.lit(None).cast("string").alias("field"),
        F.lit(None).cast("string").alias("value"),
        F.lit(True).alias("is_flush"),
    )
    return changes.select(*TAG_COLUMNS).unionByName(flushes.select(*TAG_COLUMNS))


# --- assembly --------------------------------------------------------------------


def _previous(tags: DataFrame, fields: list[str], shift: int) -> DataFrame:
    """The value of each field before the row; a null replaces an older value."""
    wanted = [
        Running(f"_{f}", F.when(F.col("field") == f, F.struct("value"))) for f in fields
    ]
    stamped = F.when(~F.col("is_flush"), F.col("source_us"))
    wanted.append(Running("event_us", stamped, "max"))
    return running(tags, ["line_id"], "seq", wanted, tie=["pos"], shift=shift)


def _completes(trigger: str) -> Column:
    before = F.col(f"_{trigger}.value")
    changed = (F.col("field") == trigger) & ~before.eqNullSafe(F.col("value"))
    return before.isNotNull() & F.coalesce(F.col("is_flush") | changed, F.lit(False))


def rollovers(tags: DataFrame, trigger: str = TRIGGER_FIELD, shift: int = SEQ_SHIFT) -> DataFrame:
    """Changes of the trigger to a new value, with the value before."""
    own = tags.filter((F.col("field") == trigger) & ~F.col("is_flush"))
    return (
        _previous(own, [trigger], shift)
        .filter(_completes(trigger))
        .select(
            "seq",
            "line_id",
            F.col(f"_{trigger}.value").alias("previous"),
            F.col("value").alias("current"),
        )
    )


def assemble(tags: DataFrame, trigger: str = TRIGGER_FIELD, shift: int = SEQ_SHIFT) -> DataFrame:
    """The batch that each rollover or flush completes, with missing fields.

    A batch takes the latest value of every field as of the rollover. Values
    carry over into the next batch until a newer one replaces them.
    """
    fields = list(dict.fromkeys([*CONTEXT_FIELDS, trigger]))
    done = _previous(tags, fields, shift).filter(_completes(trigger))
    missing = F.array_compact(
        F.array(*[F.when(F.col(f"_{f}").isNull(), F.lit(f)) for f in REQUIRED_FIELDS])
    )
    return done.select(
        "seq",
        "line_id",
        F.col(f"_{trigger}.value").alias("batch_id"),
        "event_us",
        *[F.col(f"_{f}.value").alias(f) for f in CONTEXT_FIELDS],
        "is_flush",
        missing.alias("missing"),
    )


def held_values(tags: DataFrame) -> DataFrame:
    """The last value of each field of a line, and its newest device time.

    All that a stream needs to go on with the assembly behind this table; a row per field,
    added up before the exchange.
    """
    place = F.struct("seq", "pos")
    return (
        tags.filter(~F.col("is_flush") & F.col("field").isNotNull())
        .groupBy("line_id", "field")
        .agg(F.max_by("value", place).alias("value"), F.max("source_us").alias("source_us"))
    )


def complete(batches: DataFrame) -> DataFrame:
    return batches.filter(F.size("missing") == 0).drop("missing")


def incomplete(batches: DataFrame) -> DataFrame:
    """Batches that are discarded, and for want of which fields."""
    return batches.filter(F.size("missing") > 0).select("seq", "line_id", "batch_id", "missing")
