"""Common parts of the check SQL, written for DuckDB.

The SQL orders whole keys with plain window functions and folds with recursion.
That is the straight way to say what a result means, and shares no step with
the Spark jobs.
"""

from __future__ import annotations

from linewarden.plans.fixtures import ATTEMPTS_SQL, READINGS_SQL

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def number(column: str) -> str:
    text = _STRIP.format(column)
    return f"case when regexp_full_match({text}, '{_NUMBER}') then try_cast({text} as double) end"


def blank(column: str) -> str:
    return f"{_STRIP.format(f'coalesce({column}, chr(32))')} = ''"


def floor_div(value: str, width: int | str) -> str:
    return f"((({value}) - ((({value}) % {width}) + {width}) % {width}) // {width})"


def ctes(*parts: str) -> str:
    return "with recursive " + ",\n".join(parts) + "\n"


READINGS = (
    "readings as ("
    + READINGS_SQL.replace("{TSM}", "make_timestamp").replace("{EVENTS}", "events")
    + ")"
)

TYPED = f"""typed as (
  select seq, event_time, ingest_time, epoch_us(event_time) as ts_us,
    epoch_us(ingest_time) as arrival_us, line_id, batch_id, planned_min, downtime_min,
    ideal_cycle_s, {number("total_count")} as total_count, {number("good_count")} as good_count,
    temperature
  from readings)"""

JUDGED = f"""judged as (
  select *, coalesce(
      planned_min is null or downtime_min is null or ideal_cycle_s is null
      or total_count is null or good_count is null or total_count < 0 or good_count < 0
      or good_count > total_count or planned_min <= 0
      or {blank("batch_id")} or {blank("line_id")}, true) as malformed
  from typed)"""

BASE = [READINGS, TYPED, JUDGED]


def origin(width_us: int) -> str:
    return f"""origin as (
  select first_us - first_us % 86400000000
      + (first_us % 86400000000) - (first_us % 86400000000) % {width_us} as o
  from (select arg_min(ts_us, seq) as first_us from judged))"""


def placed(width_us: int, lateness_us: int) -> str:
    return f"""placed as (
  select j.*, {floor_div("ts_us - o", width_us)} as window_index,
    {floor_div(f"ts_us - {lateness_us} - o", width_us)} - 1 as closable,
    o + {floor_div("ts_us - o", width_us)} * {width_us} as window_start_us
  from judged j, origin)"""


# Windows open and close, and each late reading finds the oldest open one.
REGISTRY = """firsts as (
  select window_index, min(seq) as first_seq from placed group by window_index),
closes as (
  select w.window_index, w.first_seq,
    case when min(p.seq) is not null then greatest(w.first_seq, min(p.seq)) end as close_seq
  from firsts w left join placed p on p.closable >= w.window_index
  group by w.window_index, w.first_seq),
registry as (
  select w.window_index, w.first_seq, w.close_seq, min(a.close_seq) as closed_by,
    coalesce(min(a.close_seq) >= w.first_seq, true) as opened
  from closes w left join closes a on a.window_index >= w.window_index
  group by w.window_index, w.first_seq, w.close_seq)"""

FILED = """late_rows as (
  select p.seq, p.window_index from placed p join registry r using (window_index)
  where r.closed_by < p.seq),
targets as (
  select l.seq, min(r.window_index) as target
  from late_rows l join registry r
    on r.opened and r.first_seq < l.seq and (r.close_seq is null or l.seq <= r.close_seq)
  group by l.seq),
filed as (
  select p.*, l.seq is not null as late,
    case when l.seq is null then p.window_index else t.target end as assigned_window
  from placed p left join late_rows l on l.seq = p.seq left join targets t on t.seq = p.seq)"""


def oee(source: str, keys: str, cycle: str = "avg(ideal_cycle_s) filter (not malformed)") -> str:
    """OEE of the clean rows per key, named ``result``."""
    return f"""sums as (
  select {keys},
    coalesce(sum(planned_min) filter (not malformed), 0) as planned_min,
    coalesce(sum(downtime_min) filter (not malformed), 0) as downtime_min,
    coalesce(trunc(sum(total_count) filter (not malformed)), 0) as total_count,
    coalesce(trunc(sum(good_count) filter (not malformed)), 0) as good_count,
    coalesce({cycle}, 0) as cycle_s
  from {source} where line_id is not null group by all),
factors as (
  select *, greatest(planned_min - downtime_min, 0) as run_min,
    case when planned_min > 0
      then greatest(0, least(1, (planned_min - downtime_min) / planned_min)) else 0 end as availability,
    case when planned_min - downtime_min > 0
      then greatest(0, least(1, total_count * cycle_s / 60 / (planned_min - downtime_min)))
      else 0 end as performance,
    case when total_count > 0
      then greatest(0, least(1, good_count / total_count)) else 0 end as quality
  from sums),
result as (
  select * replace (try_cast(total_count as bigint) as total_count,
      try_cast(good_count as bigint) as good_count),
    availability * performance * quality as oee
  from factors)"""


def oee_columns(*keys: str) -> str:
    names = ["availability", "performance", "quality", "oee", "planned_min", "run_min"]
    rounded = [f"round(cast({n} as double), 6) as {n}" for n in names]
    return ", ".join([*keys, *rounded, "total_count", "good_count"])


def gaps(source: str, keys: str) -> str:
    """All gaps of raw and clean rows, one row each, named ``gaps``."""
    return f"""gaps as (
  select {keys}, 'raw' as scope,
    ts_us - lag(ts_us) over (partition by {keys} order by ts_us) as gap_us
  from {source} where line_id is not null
  union all
  select {keys}, 'clean', ts_us - lag(ts_us) over (partition by {keys} order by ts_us)
  from {source} where line_id is not null and not malformed),
stale as (
  select {keys}, scope, count(gap_us) + 1 as n_ts, median(gap_us) as median_gap_us,
    max(gap_us) as max_gap_us,
    count(gap_us) >= 2 and median(gap_us) > 0 and max(gap_us) > 5 * median(gap_us) as stale_batch
  from gaps where gap_us is not null group by {keys}, scope)"""


RUN_WIDTH_US = 480 * 60_000_000
RUNS = [
    *BASE,
    origin(RUN_WIDTH_US),
    placed(RUN_WIDTH_US, 10 * 60_000_000),
    "runs as (select *, window_index as run_index from placed)",
]


def ledger(source: str, run: str) -> str:
    """The five ledger rows per run and line, named ``ledger``."""
    return (
        oee(source, f"{run} as run_index, line_id")
        + ",\n"
        + gaps(f"(select *, {run} as r from {source})", "r, line_id")
        + f""",
extents as (
  select {run} as run_index, line_id, count(*) as raw_rows,
    count(*) filter (not malformed) as clean_rows,
    count(*) filter (temperature is null) as raw_nulls,
    count(*) filter (temperature is null and not malformed) as clean_nulls,
    min(arrival_us) as first_us, max(arrival_us) as last_us,
    coalesce(min(arrival_us) filter (not malformed), max(arrival_us)) as first_clean_us,
    coalesce(max(arrival_us) filter (not malformed), max(arrival_us)) as last_clean_us
  from {source} where line_id is not null group by all),
measured as (
  select e.*, f.availability, f.performance, f.quality, f.oee,
    round_even(raw_nulls / raw_rows, 4) as raw_ratio,
    case when clean_rows > 0 then round_even(clean_nulls / clean_rows, 4) else 0 end as clean_ratio,
    coalesce((select stale_batch from stale s where s.r = e.run_index and s.line_id = e.line_id
      and s.scope = 'raw'), false) as raw_stale,
    coalesce((select stale_batch from stale s where s.r = e.run_index and s.line_id = e.line_id
      and s.scope = 'clean'), false) as clean_stale
  from extents e join result f using (run_index, line_id)),
ledger as (
  select run_index, line_id, 'pipeline_run' as name, first_us * 1000 as start_ns,
    last_us * 1000 as end_ns, cast(null as bigint) as rows_in, cast(null as bigint) as rows_out,
    cast(null as bigint) as rows_dropped, cast(null as double) as null_ratio,
    cast(null as boolean) as stale_batch, cast(null as double) as availability,
    cast(null as double) as performance, cast(null as double) as quality,
    round_even(oee, 4) as oee from measured
  union all
  select run_index, line_id, 'ingest', first_us * 1000, last_us * 1000, raw_rows, raw_rows, 0,
    raw_ratio, raw_stale, null, null, null, null from measured
  union all
  select run_index, line_id, 'clean', first_clean_us * 1000, last_clean_us * 1000, raw_rows,
    clean_rows, raw_rows - clean_rows, clean_ratio, clean_stale, null, null, null, null
  from measured
  union all
  select run_index, line_id, 'transform', first_clean_us * 1000, last_clean_us * 1000,
    clean_rows, clean_rows, 0, clean_ratio, clean_stale, null, null, null, null from measured
  union all
  select run_index, line_id, 'aggregate', last_clean_us * 1000, last_us * 1000, clean_rows, 1, 0,
    clean_ratio, clean_stale, round_even(availability, 4), round_even(performance, 4),
    round_even(quality, 4), round_even(oee, 4) from measured)"""
    )


RUN_LEDGER = [*RUNS, ledger("runs", "run_index")]

FACTS = [
    *RUN_LEDGER,
    """facts as (
  select c.run_index, c.line_id, c.rows_in, c.rows_out, c.rows_dropped, c.null_ratio,
    c.stale_batch, a.availability, a.performance, a.quality, a.oee,
    round_even((a.end_ns - a.start_ns) / 1e6, 2) as ms_aggregate,
    round_even((c.end_ns - c.start_ns) / 1e6, 2) as ms_clean,
    round_even((i.end_ns - i.start_ns) / 1e6, 2) as ms_ingest,
    round_even((t.end_ns - t.start_ns) / 1e6, 2) as ms_transform
  from (select * from ledger where name = 'clean') c
  join (select * from ledger where name = 'aggregate') a using (run_index, line_id)
  join (select * from ledger where name = 'ingest') i using (run_index, line_id)
  join (select * from ledger where name = 'transform') t using (run_index, line_id))""",
]


def spells(threshold_us: int) -> str:
    return f"""spells as (
  select * from (
    select seq, line_id, arrival_us, arrival_us + {threshold_us} as limit_us,
      lead(seq) over (partition by line_id order by seq) as next_seq,
      lead(arrival_us) over (partition by line_id order by seq) as next_us
    from judged)
  where next_us is null or next_us > limit_us),
silences as (
  select s.seq, s.line_id, s.arrival_us, s.next_seq, s.next_us, min(r.seq) as seen_seq,
    min(r.arrival_us) as seen_us
  from spells s join judged r on r.arrival_us > s.limit_us
  group by s.seq, s.line_id, s.arrival_us, s.next_seq, s.next_us
  having s.next_seq is null or min(r.seq) < s.next_seq)"""


def triggers(threshold_us: int) -> str:
    limit = threshold_us / 1e6
    return (
        spells(threshold_us)
        + f""",
triggers as (
  select seq, arrival_us as at_us, 1 as trigger_rank, 'threshold_breach' as kind,
    'breach' as phase, line_id, printf('temperature %.1f > 85.0', temperature) as detail,
    temperature as value
  from judged where temperature > 85
  union all
  select seq, arrival_us, 2, 'malformed_reading', 'malformed', line_id,
    'malformed reading ' || case when {blank("batch_id")} then '<blank batch_id>'
      else trim(batch_id) end || ' rejected at ingest', null
  from judged where malformed
  union all
  select seen_seq, seen_us, 3, 'line_silent', 'silent', line_id,
    printf('no reading for %.1fs (> {limit:.1f}s threshold)', (seen_us - arrival_us) / 1e6),
    (seen_us - arrival_us) / 1e6
  from silences
  union all
  select next_seq, next_us, 0, 'line_silent', 'resumed', line_id, 'line resumed reporting', null
  from silences where next_seq is not null)"""
    )


def folded(cooldown_us: int) -> str:
    """The cooldown as a fold over the triggers of each kind and line."""
    return f"""ordered as (
  select *, coalesce(line_id, '<none>') as line_key, row_number() over (
    partition by kind, line_id order by at_us, seq, trigger_rank) as k
  from triggers),
fold as (
  select kind, line_key, k, at_us as last_us, cast(0 as bigint) as held, true as fired,
    cast(0 as bigint) as suppressed
  from ordered where k = 1
  union all
  select o.kind, o.line_key, o.k,
    case when o.at_us - f.last_us >= {cooldown_us} then o.at_us else f.last_us end,
    case when o.at_us - f.last_us >= {cooldown_us} then 0 else f.held + 1 end,
    o.at_us - f.last_us >= {cooldown_us},
    case when o.at_us - f.last_us >= {cooldown_us} then f.held end
  from fold f join ordered o on o.kind = f.kind and o.line_key = f.line_key and o.k = f.k + 1),
fires as (
  select o.seq, o.at_us, o.trigger_rank, o.kind, o.phase, o.line_id, o.detail, o.value,
    f.suppressed
  from fold f join ordered o using (kind, line_key, k) where f.fired),
held as (
  select o.kind, o.line_id, o.at_us, f.held as suppressed
  from fold f join ordered o using (kind, line_key, k)
  where f.held > 0 and o.k = (select max(k) from ordered x
    where x.kind = o.kind and x.line_key = o.line_key)),
feed as (
  select seq, at_us as fired_us, kind, phase, line_id, detail, value, suppressed from fires
  union all
  select null, at_us, kind, 'pending', line_id,
    cast(suppressed as varchar) || ' further occurrence(s) suppressed by cooldown', null,
    suppressed
  from held)"""


TAG_CHANGES = """tag_changes as (
  select r.seq * 10 + f.k as seq,
    concat('ns=2;s=', r.line_id, '.', f.field) as node_id,
    r.line_id, f.field,
    case f.field when 'planned_min' then cast(cast(r.planned_min as bigint) as string)
      when 'downtime_min' then cast(cast(floor(r.downtime_min) as bigint) as string)
      when 'ideal_cycle_s' then cast(cast(floor(r.ideal_cycle_s) as bigint) as string)
      when 'total_count' then r.total_count
      when 'good_count' then r.good_count
      when 'temperature' then cast(cast(floor(r.temperature) as bigint) as string)
      else r.batch_id end as value,
    epoch_us(r.event_time) as source_us
  from readings r
  cross join (select 1 as k, 'planned_min' as field union all select 2, 'downtime_min'
    union all select 3, 'ideal_cycle_s' union all select 4, 'total_count'
    union all select 5, 'good_count' union all select 6, 'temperature'
    union all select 7, 'batch_id') f
  where r.line_id like 'line_%' and not (r.seq % 300 < 30 and f.field = 'planned_min')),
tag_map as (
  select distinct line_id, field, 'ns=2;s=' || line_id || '.' || field as node_id
  from tag_changes where not (line_id = 'line_3' and field = 'temperature')),
routed as (
  select c.seq, 0 as pos, m.line_id, m.field, c.value, c.source_us, false as is_flush, c.node_id
  from tag_changes c join tag_map m using (node_id))"""

MESSAGES = """messages as (
  select r.seq,
    case when r.seq % 97 = 0 then 'random/topic'
         else concat('spBv1.0/plant1/', case when r.seq % 250 = 249 then 'NDEATH/' else 'DDATA/' end,
                     r.line_id, '/dev1') end as topic,
    case when r.seq % 250 = 249 then '' when r.seq % 101 = 0 then '{not json'
         else concat('{"timestamp":', cast(1784505600000 + r.seq * 60000 as string),
                     ',"line_id":"', r.line_id, '","metrics":{"total_count":"', r.total_count,
                     '","good_count":"', r.good_count, '","batch_id":"', r.batch_id, '"}}') end as payload,
    r.ingest_time
  from readings r
  where r.line_id like 'line_%'),
parsed as (
  select seq, topic, payload, epoch_us(ingest_time) as arrival_us,
    split_part(topic, '/', 3) as msgtype, split_part(topic, '/', 4) as edge_node
  from messages
  where len(string_split(topic, '/')) >= 4 and starts_with(split_part(topic, '/', 1), 'spBv')),
documents as (
  select *, json_extract_string(payload, '$.line_id') as body_line,
    cast(json_extract(payload, '$.timestamp') as bigint) * 1000 as stamp_us,
    json_extract(payload, '$.metrics') as metrics
  from (select * from parsed where not msgtype like '%DEATH' and json_valid(payload))),
message_tags as (
  select seq, cast(u.pos - 1 as int) as pos, coalesce(body_line, edge_node) as line_id, u.field,
    json_extract_string(metrics, '$.' || u.field) as value, stamp_us as source_us,
    false as is_flush
  from documents, lateral (
    select unnest(json_keys(metrics)) as field, generate_subscripts(json_keys(metrics), 1) as pos) u
  union all
  select seq, 0, edge_node, null, null, null, true from parsed where msgtype like '%DEATH')"""


def assembled(source: str) -> str:
    """Batches at rollovers and flushes, by plain windows over each line."""
    fields = [
        "planned_min",
        "downtime_min",
        "ideal_cycle_s",
        "total_count",
        "good_count",
        "temperature",
        "batch_id",
    ]
    before = ", ".join(
        f"""last_value(case when field = '{f}' then {{'v': value}} end ignore nulls) over w as s_{f}"""
        for f in fields
    )
    absent = ", ".join(f"case when s_{f} is null then '{f}' end" for f in fields[:5])
    values = ", ".join(f"s_{f}.v as {f}" for f in fields[:6])
    return f"""state as (
  select seq, line_id, field, value, is_flush, max(source_us) over w as event_us, {before}
  from {source}
  window w as (partition by line_id order by seq, pos
    rows between unbounded preceding and 1 preceding)),
batches as (
  select seq, line_id, s_batch_id.v as batch_id, event_us, {values}, is_flush,
    concat_ws(',', {absent}) as missing
  from state
  where s_batch_id.v is not null
    and (is_flush or (field = 'batch_id' and s_batch_id.v is distinct from value)))"""


ATTEMPTS = (
    "attempts as ("
    + ATTEMPTS_SQL.replace("{ORDERS}", "orders")
    + """),
classified as (
  select *, case when not configured then 'skipped' when status is null then 'transport_error'
      when status <> 200 then 'http_error'
      when not json_valid(body) or json_extract(body, '$.choices[0].message.content') is null
        then 'bad_shape'
      when trim(coalesce(json_extract_string(body, '$.choices[0].message.content'), '')) = ''
        then 'empty_answer'
      else 'ok' end as outcome
  from attempts),
failures as (
  select call_id, attempt, outcome, body, provider || case outcome
      when 'transport_error' then ' request failed'
      when 'http_error' then ' returned HTTP ' || status || ': ' || left(coalesce(body, ''), 200)
      when 'bad_shape' then ' returned an unexpected response shape'
      else ' returned an empty answer' end as error
  from classified where outcome not in ('ok', 'skipped')),
answers as (
  select call_id, attempt, provider, model as request_model,
    coalesce(nullif(json_extract_string(body, '$.model'), ''), model) as response_model,
    case when json_type(body, '$.usage.prompt_tokens') <> 'VARCHAR'
        then cast(trunc(cast(json_extract_string(body, '$.usage.prompt_tokens') as double)) as bigint)
      when regexp_full_match(trim(json_extract_string(body, '$.usage.prompt_tokens')), '[+-]?[0-9]+')
        then cast(trim(json_extract_string(body, '$.usage.prompt_tokens')) as bigint)
      end as input_tokens,
    try_cast(json_extract_string(body, '$.usage.completion_tokens') as bigint) as output_tokens,
    json_extract_string(body, '$.choices[0].finish_reason') as finish_reason,
    trim(json_extract_string(body, '$.choices[0].message.content')) as content,
    epoch_us(started_at) as started_us, try_cast(round(duration_s * 1e9) as bigint) as duration_ns
  from classified where outcome = 'ok'),
served as (
  select a.*, exists (select 1 from failures f where f.call_id = a.call_id
      and f.attempt < a.attempt) as fallback_used, a.attempt + 1 as attempts
  from answers a
  where a.attempt = (select min(attempt) from answers b where b.call_id = a.call_id))"""
)
