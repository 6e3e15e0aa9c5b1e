"""Production-line views derived from the given benchmark tables.

The same SQL text serves Spark and the checking engine; only the function that
makes a timestamp from microseconds has another name there.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linewarden.functions import sparkplug
from linewarden.session import prepare, ship

ship(__name__)

READINGS_SQL = """
select b.seq,
  {TSM}(b.ingest_us - cast(b.lag_s * 1000000 as bigint)) as event_time,
  {TSM}(b.ingest_us) as ingest_time,
  b.line_id, b.batch_id, b.planned_min, b.downtime_min, b.ideal_cycle_s,
  b.total_count, b.good_count, b.temperature
from (
  select event_id as seq,
    1784505600000000 + event_id * 60000000 as ingest_us,
    case when event_id % 3 = 0 then 0
         when event_id % 3 = 1 then 90
         else least(120 + 4 * cast(floor(event_id / cast(3 as double)) as bigint), 1800) end as lag_s,
    case when event_id % 211 = 0 then cast(null as string)
         when event_id % 197 = 0 then '  '
         when event_id % 1009 between 500 and 503 then 'odd'
         else concat('line_', cast(case when event_id % 3 = 2 and event_id % 1000 between 600 and 949 then 1
           else event_id % 3 + 1 end as string)) end as line_id,
    case when event_id % 53 = 0 then '' else concat('b', cast(event_id as string)) end as batch_id,
    case when event_id % 59 = 0 then cast(0 as double) else cast(60 as double) end as planned_min,
    least(value / cast(10 as double), cast(30 as double)) as downtime_min,
    cast(2 as double) + cast(event_id % 3 as double) / cast(2 as double) as ideal_cycle_s,
    case when event_id % 1009 = 500 then '1e300'
         when event_id % 41 = 0 then 'ERR' when event_id % 43 = 0 then '-1'
         else cast(1000 + event_id % 500 as string) end as total_count,
    case when event_id % 47 = 0 then cast(1025 + event_id % 500 as string)
         else cast(950 + event_id % 500 as string) end as good_count,
    case when event_id % 1009 = 501 then cast(1e19 as double)
         when event_id % 7 = 0 then cast(null as double)
         else cast(60 as double) + value / cast(10 as double) end as temperature
  from {EVENTS}
) b
"""

ATTEMPTS_SQL = """
select call_id, attempt, provider, concat(provider, '-model') as model,
  not (provider = 'primary' and call_id % 17 = 0) as configured,
  status,
  case when status = 200 and call_id % 13 = 0 and attempt = 0 then '{"unexpected":"shape"}'
       when status = 200 then concat('{"choices":[{"message":{"content":"answer ', cast(call_id as string),
         '"},"finish_reason":"stop"}],"usage":{"prompt_tokens":',
         case when call_id % 19 = 0 then '" 45 "' when call_id % 23 = 0 then '45.9'
              when call_id % 29 = 0 then '"45.9"' when call_id % 31 = 0 then 'null'
              else cast(100 + call_id % 50 as string) end,
         ',"completion_tokens":', cast(20 + call_id % 30 as string), '}}')
       when status is null then cast(null as string)
       else concat('error ', cast(call_id as string), repeat(' detail', cast(call_id % 40 as int))) end as body,
  started_at, duration_s
from (
  select o_orderkey as call_id, 0 as attempt, 'primary' as provider,
    case when o_orderkey % 11 = 0 then cast(null as int) when o_orderkey % 7 = 0 then 429
         when o_orderkey % 5 = 0 then 500 else 200 end as status,
    o_orderdate as started_at, case when o_orderkey % 1013 = 5 then cast(1e300 as double)
      else o_totalprice / cast(100000 as double) end as duration_s
  from {ORDERS}
  union all
  select o_orderkey, 1, 'fallback', case when o_orderkey % 10 = 0 then 503 else 200 end,
    o_orderdate, o_totalprice / cast(50000 as double)
  from {ORDERS}
  where o_orderkey % 11 = 0 or o_orderkey % 7 = 0 or o_orderkey % 5 = 0 or o_orderkey % 13 = 0 or o_orderkey % 17 = 0
) a
"""

# The tags of a line, counters first and the batch id last.
TAG_FIELDS = [
    "planned_min",
    "downtime_min",
    "ideal_cycle_s",
    "total_count",
    "good_count",
    "temperature",
    "batch_id",
]


def _over(df: DataFrame, token: str, sql: str) -> DataFrame:
    view = f"linewarden_{token.lower()}_input"
    df.createOrReplaceTempView(view)
    return df.sparkSession.sql(
        sql.replace("{TSM}", "timestamp_micros").replace("{" + token + "}", view)
    )


def readings_from(events: DataFrame) -> DataFrame:
    """Readings from an events table, batch or stream."""
    return _over(events, "EVENTS", READINGS_SQL)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings_from(prepare(spark).read.parquet(f"{sf_dir}/events.parquet"))


def call_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = prepare(spark).read.parquet(f"{sf_dir}/orders.parquet")
    return _over(orders, "ORDERS", ATTEMPTS_SQL)


def tag_changes(line_readings: DataFrame) -> DataFrame:
    """Seven tag changes per reading of a named line, as a device sends them."""

    def whole(name: str):
        return F.floor(F.col(name)).cast("bigint").cast("string")

    values = {
        "planned_min": whole("planned_min"),
        "downtime_min": whole("downtime_min"),
        "ideal_cycle_s": whole("ideal_cycle_s"),
        "total_count": F.col("total_count"),
        "good_count": F.col("good_count"),
        "temperature": whole("temperature"),
        "batch_id": F.col("batch_id"),
    }
    tags = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(name).alias("field"), values[name].alias("value"))
            for k, name in enumerate(TAG_FIELDS, start=1)
        ]
    )
    return (
        line_readings.filter(F.col("line_id").like("line_%"))
        .select("seq", "line_id", "event_time", F.inline(tags))
        .filter(~((F.col("seq") % 300 < 30) & (F.col("field") == "planned_min")))
        .select(
            (F.col("seq") * 10 + F.col("k")).alias("seq"),
            F.concat(F.lit("ns=2;s="), "line_id", F.lit("."), "field").alias("node_id"),
            "line_id",
            "field",
            "value",
            F.col("event_time").alias("source_time"),
        )
    )


def tag_maps(line_readings: DataFrame) -> DataFrame:
    """One row per named line with its map of node id to field.

    The thermometer of line_3 is in no map, so its changes stay unmapped.
    """
    fields = F.array(*[F.lit(f) for f in TAG_FIELDS])
    mapped = F.filter(
        fields, lambda f: ~((F.col("line_id") == "line_3") & (f == "temperature"))
    )
    lines = line_readings.filter(F.col("line_id").like("line_%")).select("line_id").distinct()
    return lines.withColumn("_fields", mapped).select(
        "line_id",
        F.map_from_arrays(
            F.transform(
                "_fields", lambda f: F.concat(F.lit("ns=2;s="), "line_id", F.lit("."), f)
            ),
            F.col("_fields"),
        ).alias("nodes"),
    )


def sparkplug_messages(line_readings: DataFrame) -> DataFrame:
    """Broker messages: data, deaths, foreign topics and broken payloads."""
    seq = F.col("seq")
    death = seq % 250 == 249
    topic = F.when(seq % 97 == 0, "random/topic").otherwise(
        F.concat(
            F.lit("spBv1.0/plant1/"),
            F.when(death, "NDEATH/").otherwise("DDATA/"),
            F.col("line_id"),
            F.lit("/dev1"),
        )
    )
    body = F.concat(
        F.lit('{"timestamp":'),
        (F.lit(1784505600000) + seq * 60000).cast("string"),
        F.lit(',"line_id":"'),
        "line_id",
        F.lit('","metrics":{"total_count":"'),
        "total_count",
        F.lit('","good_count":"'),
        "good_count",
        F.lit('","batch_id":"'),
        "batch_id",
        F.lit('"}}'),
    )
    payload = F.when(death, "").when(seq % 101 == 0, "{not json").otherwise(body)
    return line_readings.filter(F.col("line_id").like("line_%")).select(
        "seq", topic.alias("topic"), payload.alias("payload"), "ingest_time"
    )


def binary_messages(line_readings: DataFrame) -> DataFrame:
    """The same messages with binary payloads: whole numbers as such, broken ones cut short."""

    @F.arrow_udf("binary")
    def binary(payloads: pa.Array) -> pa.Array:
        out = []
        for text in payloads.to_pylist():
            try:
                body = json.loads(text or "")
            except ValueError:
                # A field that promises more bytes than follow.
                out.append(b"\x12\x7f" + (text or "").encode())
                continue
            metrics = [
                (k, int(v) if re.fullmatch("-?[0-9]+", v) else v)
                for k, v in body["metrics"].items()
            ]
            out.append(sparkplug.encode(body["timestamp"], metrics))
        return pa.array(out, pa.binary())

    return sparkplug_messages(line_readings).withColumn("payload", binary("payload"))


def log_messages(events: DataFrame, partitions: int = 300) -> DataFrame:
    """Events as messages of a broker's log; seven of them share a millisecond."""
    number = F.col("event_id")
    return events.select(
        (number % partitions).cast("int").alias("partition"),
        F.floor(number / partitions).alias("offset"),
        F.timestamp_millis(F.lit(1784505600000) + F.floor(number / 7)).alias("time"),
        F.concat(F.lit("plant/"), "event_type").alias("topic"),
        F.concat(F.lit("m"), number.cast("string")).alias("payload"),
    )
