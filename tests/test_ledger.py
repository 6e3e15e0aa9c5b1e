import random

from pyspark.sql import functions as F

from linewarden.operators import facts, ledger, panels, provider_calls
from linewarden.session import new_path
from linewarden.plans import fixtures
from linewarden.sources.records import judge, read_records
from linewarden.sources.sinks import read_ledger, write_ledger, write_logs, write_metric


def _ledger(spark, sf_dir):
    return ledger.stage_ledger(judge(fixtures.readings(spark, sf_dir)))


def test_five_rows_per_line(spark, sf_dir):
    rows = _ledger(spark, sf_dir).collect()
    lines = {r.line_id for r in rows}
    assert len(rows) == 5 * len(lines)
    for r in rows:
        if r.name == "pipeline_run":
            assert r.parent_id.endswith("stream_window") and r.oee is not None
        else:
            assert r.parent_id.endswith(f"{r.line_id}/pipeline_run")
            assert None not in (r.rows_in, r.rows_out, r.rows_dropped, r.null_ratio, r.stale_batch)
        if r.name == "clean":
            assert r.rows_in - r.rows_out == r.rows_dropped
        if r.name == "aggregate":
            assert (r.rows_out, r.rows_dropped) == (1, 0)


def test_sinks(spark, sf_dir):
    path = new_path(spark, "test-ledger")
    rows = _ledger(spark, sf_dir).cache()
    write_ledger(rows, path)
    write_ledger(rows, path)
    assert read_ledger(spark, path).count() == 2 * rows.count()
    write_logs(rows, f"{path}-logs")
    assert spark.read.json(f"{path}-logs").count() == rows.count()
    write_metric(rows.groupBy("name").count(), f"{path}-metric")
    assert spark.read.parquet(f"{path}-metric").count() == 5


def test_log_levels(spark, sf_dir):
    rows = _ledger(spark, sf_dir).withColumn("level", F.lit("warning"))
    logs = ledger.log_records(rows, F.col("level"))
    levels = logs.select("severity", "severity_text").distinct().collect()
    assert [tuple(r) for r in levels] == [(13, "WARN")]
    unknown = ledger.log_records(rows, F.lit("odd")).select("severity").first()
    assert unknown.severity == 9


def test_facts_of_an_empty_ledger(spark, sf_dir):
    empty = _ledger(spark, sf_dir).limit(0)
    assert facts.trend_context(facts.line_facts(empty)).count() == 0


def test_last_row_of_a_stage_wins_and_absent_is_zero(spark, sf_dir):
    rows = _ledger(spark, sf_dir).filter("line_id = 'line_1' and name = 'clean'")
    later = rows.withColumns({"end_ns": F.col("end_ns") + 1, "rows_dropped": F.lit(7).cast("bigint")})
    row = facts.line_facts(rows.unionByName(later)).first()
    assert (row.rows_dropped, row.oee) == (7, 0.0)
    assert list(row.stage_ms) == ["clean"]


def test_zero_fill_and_rule(spark):
    minute = 60_000_000
    series = spark.createDataFrame(
        [("a", 0, 0.9), ("a", 3 * minute, 0.5), ("b", 2000 * minute, 0.7), ("b", 5000 * minute, 1.0)],
        "line_id string, step_us bigint, value double",
    )
    filled = panels.zero_fill(series, ["line_id"])
    assert filled.filter("line_id = 'a'").orderBy("step_us").select("value").collect() == [
        (0.9,), (0.0,), (0.0,), (0.5,)
    ]
    assert filled.filter("line_id = 'b'").count() == 3001
    fired = panels.firing_rule(series, ["line_id"], F.col("value") < 0.65).collect()
    assert sorted(r.eval_start_us // minute for r in fired) == [-1, 0, 1, 2, 3]


def test_zero_fill_keeps_every_row_of_odd_series(spark):
    minute = 60_000_000
    rng = random.Random(5)
    rows = [(None, 0, 1.0), (None, 4 * minute, None), ("n", None, 2.0), ("n", None, 3.0)]
    rows += [("d", m * minute, float(m)) for m in range(2000)]
    rows += [("x", 7 * minute + rng.randrange(4000) * minute // 2, rng.random()) for _ in range(300)]
    wanted = {}
    for key in (None, "n", "d", "x"):
        own = [(s, v) for k, s, v in rows if k == key]
        at = [s for s, _ in own if s is not None]
        found = dict.fromkeys(range(min(at), max(at) + 1, minute), 0.0) if at else {}
        for s in {s for s, _ in own}:
            found[s] = max((v for t, v in own if t == s and v is not None), default=0.0)
        wanted |= {(key, s): v for s, v in found.items()}
    series = spark.createDataFrame(rows, "line_id string, step_us bigint, value double")
    filled = panels.zero_fill(series, ["line_id"]).collect()
    assert {(r.line_id, r.step_us): r.value for r in filled} == wanted
    assert len(filled) == len(wanted)


def test_zero_fill_spreads_its_days_and_keeps_no_steps(spark):
    day = 86_400_000_000
    series = spark.range(2).select(
        F.lit("a").alias("line_id"), (F.col("id") * 400 * day).alias("step_us"), F.lit(1.0).alias("value")
    )
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        filled = panels.zero_fill(series, ["line_id"])
        sizes = filled.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert sum(r["count"] for r in sizes) == 400 * 1440 + 1
    assert max(r["count"] for r in sizes) < 400 * 1440 / 4
    # The steps are made behind the last exchange, so none is held in a hash table.
    plan = filled._jdf.queryExecution().optimizedPlan().toString()
    unfolded = plan.index("Generate inline")
    assert "Aggregate" not in plan[:unfolded] and "Aggregate" in plan[unfolded:]



def test_text_formats_are_read_with_the_raw_schema(spark, tmp_path):
    path = str(tmp_path / "records.csv")
    with open(path, "w") as out:
        out.write("2026-07-20T00:00:00,line_1,b0,60,5,2,ERR,90,\n")
        out.write("2026-07-20T01:00:00,line_1,b1,60,5,2,100,90,70.5\n")
    rows = judge(read_records(spark, path, "csv")).orderBy("ts").collect()
    assert [r.malformed for r in rows] == [True, False]
    assert rows[1].ts_us - rows[0].ts_us == 3_600_000_000
    assert rows[1].temperature == 70.5


def _attempts(spark, rows):
    schema = (
        "call_id bigint, attempt int, provider string, model string, configured boolean, "
        "status int, body string, started_at timestamp, duration_s double"
    )
    full = [(c, a, f"p{a}", f"m{a}", conf, s, b, None, 1.0) for c, a, conf, s, b in rows]
    return spark.createDataFrame(full, schema)


GOOD = '{"choices":[{"message":{"content":" hi "},"finish_reason":"stop"}],"usage":%s}'


def test_calls(spark):
    attempts = _attempts(
        spark,
        [
            (1, 0, True, 500, "x" * 300), (1, 1, True, 200, GOOD % '{"prompt_tokens":12,"completion_tokens":"7"}'),
            (2, 0, False, None, None), (2, 1, True, 200, GOOD % '"none"'),
            (3, 0, True, None, None), (3, 1, True, 200, '{"choices":[]}'),
            (4, 0, False, None, None),
            (5, 0, True, 200, '{"choices":[{"message":{"content":"  "}}]}'),
            (6, 0, True, 200, '{"choices":[{"message":{"content":null}}]}'),
            (7, 0, True, 200, "not json"),
        ],
    )
    outcome = {(r.call_id, r.attempt): r.outcome for r in provider_calls.classify(attempts).collect()}
    assert outcome == {
        (1, 0): "http_error", (1, 1): "ok", (2, 0): "skipped", (2, 1): "ok",
        (3, 0): "transport_error", (3, 1): "bad_shape", (4, 0): "skipped",
        (5, 0): "empty_answer", (6, 0): "empty_answer", (7, 0): "bad_shape",
    }
    served = {r.call_id: r for r in provider_calls.served_by(attempts).collect()}
    assert set(served) == {1, 2}
    assert (served[1].fallback_used, served[1].attempts, served[1].content) == (True, 2, "hi")
    assert (served[1].input_tokens, served[1].output_tokens) == (12, 7)
    assert (served[2].fallback_used, served[2].attempts, served[2].input_tokens) == (False, 2, None)
    failed = {r.call_id: r.message for r in provider_calls.unanswered(attempts).collect()}
    assert failed[3] == (
        "all LLM providers failed: p0 request failed | p1 returned an unexpected response shape"
    )
    assert failed[4] == "no LLM provider is configured"
    shown = provider_calls.classify(attempts).filter("call_id = 1 and attempt = 0").first().error
    assert shown == "p0 returned HTTP 500: " + "x" * 200
    rows = provider_calls.call_rows(provider_calls.served_by(attempts)).collect()
    absent = {r.call_id: "gen_ai.usage.input_tokens" in r.attrs for r in rows}
    assert absent == {1: True, 2: False}


def test_facts_read_any_table_with_the_columns_of_a_ledger(spark, sf_dir, tmp_path):
    """A stored ledger, one with columns of its own, and one read as JSON give the same facts."""
    from linewarden.sources.sinks import LEDGER_SCHEMA, read_ledger, write_ledger

    own = _ledger(spark, sf_dir)
    want = sorted(map(repr, facts.line_facts(own).collect()))
    write_ledger(own, str(tmp_path / "l"))
    stored = read_ledger(spark, str(tmp_path / "l"))
    assert sorted(map(repr, facts.line_facts(stored).collect())) == want
    wider = stored.selectExpr("*", "'x' as site").repartition(5)
    assert sorted(map(repr, facts.line_facts(wider).collect())) == want
    own.write.json(str(tmp_path / "j"))
    text = spark.read.schema(LEDGER_SCHEMA).json(str(tmp_path / "j"))
    assert sorted(map(repr, facts.line_facts(text).collect())) == want and want
