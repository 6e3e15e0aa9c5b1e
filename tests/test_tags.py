"""Tag routing and assembly against a loop over the changes."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from linewarden.operators import tags
from linewarden.operators.tags import CONTEXT_FIELDS, REQUIRED_FIELDS

SCHEMA = (
    "seq bigint, pos int, line_id string, field string, value string, source_us bigint, "
    "is_flush boolean"
)


def changes(spark, rows):
    return spark.createDataFrame(
        [(i, 0, line, f, v, us, f is None) for i, (line, f, v, us) in enumerate(rows)], SCHEMA
    )


def loop(rows):
    state, newest, out = {}, {}, []
    for i, (line, field, value, us) in enumerate(rows):
        held = state.setdefault(line, {})
        before = held.get("batch_id")
        if before is not None and (field is None or (field == "batch_id" and before != value)):
            out.append(
                (i, line, before, newest.get(line))
                + tuple(held.get(f) for f in CONTEXT_FIELDS)
                + (tuple(f for f in REQUIRED_FIELDS if f not in held),)
            )
        if field is not None:
            held[field] = value
            newest[line] = max(us, newest.get(line, us))
    return out


def assembled(spark, rows, shift=20):
    got = tags.assemble(changes(spark, rows), shift=shift).orderBy("seq").collect()
    return [
        (r.seq, r.line_id, r.batch_id, r.event_us, *[r[f] for f in CONTEXT_FIELDS], tuple(r.missing))
        for r in got
    ]


def full(line, batch, us):
    return [(line, f, f"{batch}-{f}", us) for f in REQUIRED_FIELDS] + [(line, "batch_id", batch, us)]


def test_first_batch_emits_nothing(spark):
    assert assembled(spark, full("a", "b1", 1)) == []


def test_rollover_emits_the_previous_batch(spark):
    rows = full("a", "b1", 1) + full("a", "b2", 2)
    (only,) = assembled(spark, rows)
    assert only[2] == "b1"
    assert only[4] == "b2-planned_min"  # the counters of b2 came before its id
    assert assembled(spark, rows) == loop(rows)


def test_incomplete_is_discarded(spark):
    rows = [("a", "batch_id", "b1", 1), ("a", "total_count", "5", 2), ("a", "batch_id", "b2", 3)]
    batches = tags.assemble(changes(spark, rows))
    assert tags.complete(batches).count() == 0
    assert set(tags.incomplete(batches).first().missing) == set(REQUIRED_FIELDS) - {"total_count"}


def test_lines_are_independent_and_a_null_replaces(spark):
    rows = full("a", "b1", 1) + full("b", "c1", 2) + [("a", "good_count", None, 3)]
    rows += [("a", "batch_id", "b2", 4)]
    (only,) = assembled(spark, rows)
    assert only[1] == "a" and only[4 + CONTEXT_FIELDS.index("good_count")] is None
    assert only[-1] == ()  # an explicit null is present


@pytest.mark.parametrize("seed", range(3))
def test_random(spark, seed):
    rng, rows = random.Random(seed), []
    for i in range(400):
        field = rng.choice([*CONTEXT_FIELDS, "batch_id", "batch_id", None])
        value = rng.choice(["1", "2", "3", None])
        rows.append((rng.choice("aab"), field, value, i - rng.randint(0, 9)))
    assert assembled(spark, rows, shift=5) == loop(rows)


def test_messages(spark):
    when = datetime(2026, 7, 20)
    rows = [
        (1, "spBv1.0/g/DDATA/n1/d", '{"timestamp": 1500, "metrics": {"b": "x", "a": 2}}'),
        (2, "spBv1.0/g/DDATA/n1", '{"timestamp": "2026-07-20T01:00:00Z", "line_id": "l", "metrics": {"a": 1}}'),
        (3, "spBv1.0/g/DDATA/n1", '{"timestamp": "soon", "metrics": {"a": null}}'),
        (4, "spBv1.0/g/NDEATH/n1", "ignored"),
        (5, "spBv1.0/g/DDATA/n1", "{not json"),
        (6, "spBv1.0/g/DDATA/n1", "[1]"),
        (7, "random/topic", "{}"),
        (8, "spBv1.0/g/DDATA/n1", "{}"),
        (9, "spBv1.0/g/DDATA/n1", '{"timestamp": "1500", "metrics": {"a": "q"}}'),
    ]
    messages = spark.createDataFrame(
        [(s, t, p, when) for s, t, p in rows],
        "seq bigint, topic string, payload string, ingest_time timestamp",
    )
    parsed = tags.parse_topics(messages)
    assert parsed.count() == 8
    assert [r.edge_node for r in tags.deaths(parsed).collect()] == ["n1"]
    assert sorted(r.seq for r in tags.undecodable(parsed).collect()) == [5, 6]
    found = tags.message_tags(parsed).orderBy("seq", "pos").collect()
    ingest = messages.select(F.unix_micros("ingest_time")).first()[0]
    assert [(r.seq, r.line_id, r.field, r.value, r.source_us, r.is_flush) for r in found] == [
        (1, "n1", "b", "x", 1_500_000, False),
        (1, "n1", "a", "2", 1_500_000, False),
        (2, "l", "a", "1", ingest + 3600 * 1_000_000, False),
        (3, "n1", "a", None, ingest, False),
        (4, "n1", None, None, None, True),
        (9, "n1", "a", "q", ingest, False),
    ]


def test_routing(spark):
    maps = spark.createDataFrame([("a", {"n1": "total_count"})], "line_id string, nodes map<string,string>")
    flat = tags.flatten_tag_maps(maps)
    seen = spark.createDataFrame([(1, "n1", "5"), (2, "n2", "6")], "seq bigint, node_id string, value string")
    row = tags.route(seen, flat).collect()
    assert [(r.seq, r.line_id, r.field) for r in row] == [(1, "a", "total_count")]
    assert [r.seq for r in tags.unmapped(seen, flat).collect()] == [2]
