"""Tag routing, broker messages and batch assembly over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions.sparkplug import decode_binary
from linewarden.operators import tags
from linewarden.operators.ledger import event_logs
from linewarden.plans import sql
from linewarden.plans.registry import query
from linewarden.plans.sql import MESSAGES, READINGS, TAG_CHANGES, ctes
from linewarden.session import settle
from linewarden.plans import fixtures

_TAGS = [READINGS, TAG_CHANGES]
_MESSAGES = [READINGS, MESSAGES]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.tag_changes(fixtures.readings(spark, sf_dir))


def _tag_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = fixtures.tag_maps(fixtures.readings(spark, sf_dir))
    return settle(tags.flatten_tag_maps(maps), "tag-map")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.route(_changes(spark, sf_dir), _tag_map(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.parse_topics(fixtures.sparkplug_messages(fixtures.readings(spark, sf_dir)))


@query(ctes(*_TAGS) + "select line_id, node_id, field from tag_map")
def tag_map_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = fixtures.tag_maps(fixtures.readings(spark, sf_dir))
    return tags.flatten_tag_maps(maps)


@query(ctes(*_TAGS) + "select seq, node_id, line_id, field, value from routed")
def tag_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("seq", "node_id", "line_id", "field", "value")


@query(
    ctes(*_TAGS)
    + "select seq, node_id, value from tag_changes where node_id not in (select node_id from tag_map)"
)
def unmapped_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tags.unmapped(_changes(spark, sf_dir), _tag_map(spark, sf_dir))
    return rows.select("seq", "node_id", "value")


@query(ctes(*_MESSAGES) + "select seq, topic, msgtype, edge_node from parsed")
def topic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("seq", "topic", "msgtype", "edge_node")


@query(ctes(*_MESSAGES) + "select seq, edge_node from parsed where msgtype like '%DEATH'")
def dead_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.deaths(_parsed(spark, sf_dir)).select("seq", "edge_node")


@query(
    ctes(*_MESSAGES)
    + """select seq, topic, payload from parsed
where not msgtype like '%DEATH' and not json_valid(payload)"""
)
def undecodable_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.undecodable(_parsed(spark, sf_dir)).select("seq", "topic", "payload")


@query(
    ctes(*_MESSAGES)
    + "select seq, pos, line_id, field, value, source_us, is_flush from message_tags"
)
def sparkplug_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.message_tags(_parsed(spark, sf_dir))


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.parse_topics(fixtures.binary_messages(fixtures.readings(spark, sf_dir)))


@query(
    ctes(*_MESSAGES)
    + "select seq, pos, line_id, field, value, source_us, is_flush from message_tags"
)
def sparkplug_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag changes out of binary payloads, the same as out of JSON."""
    return tags.message_tags(_binary(spark, sf_dir), decode_binary)


@query(
    ctes(*_MESSAGES)
    + """select seq, topic from parsed
where not msgtype like '%DEATH' and not json_valid(payload)"""
)
def undecodable_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.undecodable(_binary(spark, sf_dir), decode_binary).select("seq", "topic")


@query(
    ctes(*_TAGS)
    + """select seq, line_id, previous, current
from (select seq, line_id, value as current,
    lag(value) over (partition by line_id order by seq) as previous,
    row_number() over (partition by line_id order by seq) as n
  from routed where field = 'batch_id' and not is_flush)
where n > 1 and previous is distinct from current"""
)
def batch_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags.rollovers(tags.as_tags(_routed(spark, sf_dir)))


_BATCH = (
    "seq, line_id, batch_id, event_us, planned_min, downtime_min, ideal_cycle_s, "
    "total_count, good_count, temperature"
)


@query(
    ctes(*_TAGS, sql.assembled("routed")) + f"select {_BATCH} from batches where missing = ''"
)
def tag_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = tags.assemble(tags.as_tags(_routed(spark, sf_dir)))
    return tags.complete(batches).drop("is_flush")


@query(
    ctes(*_TAGS, sql.assembled("routed"))
    + """select seq, line_id, batch_id, missing
from batches where missing <> ''"""
)
def incomplete_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = tags.incomplete(tags.assemble(tags.as_tags(_routed(spark, sf_dir))))
    return batches.withColumn("missing", F.array_join("missing", ","))


@query(
    ctes(*_TAGS, sql.assembled("routed"))
    + """select 'batch ' || batch_id || ' of ' || line_id || ' discarded, missing ' || missing as body,
  13 as severity, 'WARN' as severity_text, cast(seq as varchar) as seq
from batches where missing <> ''"""
)
def log_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warning for every discarded batch."""
    body = F.format_string("batch %s of %s discarded, missing %s", "batch_id", "line_id", "missing")
    logs = event_logs(incomplete_batches(spark, sf_dir), body, "warning", ["seq", "line_id"])
    return logs.select("body", "severity", "severity_text", F.col("attrs")["seq"].alias("seq"))


@query(
    ctes(*_TAGS, sql.assembled("routed"))
    + """select line_id, missing, count(*) as n_batches
from batches group by all"""
)
def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = tags.assemble(tags.as_tags(_routed(spark, sf_dir)))
    missing = F.array_join("missing", ",").alias("missing")
    return batches.groupBy("line_id", missing).agg(F.count(F.lit(1)).alias("n_batches"))


@query(
    ctes(*_MESSAGES, sql.assembled("message_tags"))
    + """select seq, line_id, batch_id, is_flush, total_count, good_count,
  missing from batches"""
)
def message_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches out of broker messages, cut at rollovers and at deaths."""
    changes = settle(tags.message_tags(_parsed(spark, sf_dir)), "message-tags")
    batches = tags.assemble(changes)
    return batches.select(
        "seq",
        "line_id",
        "batch_id",
        "is_flush",
        "total_count",
        "good_count",
        F.array_join("missing", ",").alias("missing"),
    )
