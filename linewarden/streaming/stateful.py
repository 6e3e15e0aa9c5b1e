"""Operators that keep state per key: tag assembly, silence watch, alert cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from linewarden.operators.alerts import EVENT_COLUMNS, pending_text
from linewarden.operators.tags import CONTEXT_FIELDS, REQUIRED_FIELDS, TAG_COLUMNS, TRIGGER_FIELD
from linewarden.session import ship

ship(__name__)

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

BATCH_SCHEMA = (
    "seq bigint, line_id string, batch_id string, event_us bigint, "
    + ", ".join(f"{f} string" for f in CONTEXT_FIELDS)
    + ", is_flush boolean, missing array<string>"
)
PACKED_SCHEMA = "line_id string, body binary"
#: Tag changes that are packed together, and batches that a state processor gives out together.
PACK_ROWS, GIVE_ROWS = 1 << 17, 1 << 16
#: Device time of a line that has none yet.
NO_TIME = np.iinfo(np.int64).min
ALERT_SCHEMA = "line_id string, phase string, at_ms bigint, quiet_s double"


def use_state_store(spark: SparkSession) -> None:
    """State processors keep several variables, which needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tag changes as a binary table for each line, of some rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= PACK_ROWS:
            yield _lines(held)
            held, n = [], 0
    if n:
        yield _lines(held)


def _lines(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches)
    names, codes = _codes(rows["line_id"])
    order = np.argsort(codes, kind="stable")
    rows = rows.drop_columns(["line_id"]).take(pa.array(order)).combine_chunks()
    ends = np.searchsorted(codes[order], np.arange(len(names) + 1))
    options = pa.ipc.IpcWriteOptions(compression="lz4")
    bodies = []
    for begin, end in zip(ends[:-1], ends[1:], strict=True):
        part = rows.slice(begin, end - begin)
        field = pc.dictionary_encode(part["field"].combine_chunks())
        part = part.set_column(part.schema.get_field_index("field"), "field", field)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema, options=options) as out:
            out.write_table(part)
        bodies.append(sink.getvalue().to_pybytes())
    return pa.record_batch({"line_id": pa.array(names, pa.string()), "body": pa.array(bodies, pa.binary())})


def _unpacked(body: bytes) -> pa.Table:
    rows = pa.ipc.open_stream(body).read_all()
    kinds = {"seq": pa.int64(), "pos": pa.int64(), "source_us": pa.int64()}
    columns = {c: rows[c].cast(kind) for c, kind in kinds.items()}
    # One text may pass 2 GB over all rows of a line.
    columns["value"] = rows["value"].cast(pa.large_string())
    return pa.table({**columns, "field": rows["field"], "is_flush": rows["is_flush"]})


def _codes(column: pa.ChunkedArray) -> tuple[list, np.ndarray]:
    """The different values of a column, null included, and the number of each row's."""
    if pa.types.is_dictionary(column.type):
        column = column.unify_dictionaries().combine_chunks()
    else:
        column = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    names = column.dictionary.to_pylist()
    return names, pc.fill_null(column.indices, -1).to_numpy(zero_copy_only=False).astype(np.int32)


def _flags(column: pa.ChunkedArray) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy()


class TagAssembly(StatefulProcessor):
    """Latest value per field of a line; a new trigger value ends a batch."""

    def __init__(
        self,
        trigger: str = TRIGGER_FIELD,
        context: tuple[str, ...] = tuple(CONTEXT_FIELDS),
        required: tuple[str, ...] = tuple(REQUIRED_FIELDS),
    ) -> None:
        self.trigger, self.context, self.required = trigger, context, required

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getMapState("values", "field string", "value string")
        self.newest = handle.getValueState("newest", "us bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """What ``operators.tags.held_values`` found in the table before the stream."""
        for field, value in zip(initialState["field"], initialState["value"], strict=True):
            self.values.updateValue((field,), (None if pd.isna(value) else value,))
        newest = initialState["source_us"].max()
        if not pd.isna(newest):
            self.newest.update((int(newest),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        tags = pa.concat_tables([_unpacked(b) for frame in rows for b in frame["body"]])
        held = {k[0]: v[0] for k, v in self.values.iterator()}
        newest = self.newest.get()[0] if self.newest.exists() else NO_TIME
        # A null number sorts last.
        last = [pc.fill_null(tags[c], np.iinfo(np.int64).max).to_numpy() for c in ("pos", "seq")]
        order = np.lexsort(last)
        del last
        flush = _flags(tags["is_flush"])[order]
        names, codes = _codes(tags["field"])
        codes = np.where(flush, -1, codes[order])
        stamp = pc.fill_null(tags["source_us"], NO_TIME).to_numpy()[order]
        stamp[flush] = NO_TIME
        newest_at = np.maximum.accumulate(np.concatenate([[newest], stamp]))
        del stamp
        places = {f: np.flatnonzero(codes == i) for i, f in enumerate(names) if f is not None}
        none = np.zeros(0, np.int64)

        def values(at: np.ndarray) -> np.ndarray:
            return tags["value"].take(pa.array(order[at])).to_pandas().to_numpy(object)

        def before(name: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The value of a field before each place, and whether there is one."""
            own = places.get(name, none)
            found = np.searchsorted(own, at) - 1
            value = np.full(len(at), held.get(name), object)
            value[found >= 0] = values(own[found[found >= 0]])
            value[pd.isna(value)] = None
            return value, (found >= 0) | (name in held)

        def batches(at: np.ndarray) -> pd.DataFrame:
            current, _ = before(self.trigger, at)
            changed = values(at)
            changed[pd.isna(changed)] = None
            ends = (flush[at] | (changed != current)) & np.array([c is not None for c in current])
            at, current = at[ends], current[ends]
            found = {f: before(f, at) for f in dict.fromkeys([*self.context, *self.required])}
            lacks = [[f for f in self.required if not found[f][1][i]] for i in range(len(at))]
            event_us = newest_at[at]
            return pd.DataFrame(
                {
                    "seq": tags["seq"].take(pa.array(order[at])).to_pandas(),
                    "line_id": pd.Series([key[0]] * len(at), dtype=object),
                    "batch_id": current,
                    "event_us": pd.Series(event_us, dtype="Int64").mask(event_us == NO_TIME),
                    **{f: found[f][0] for f in self.context},
                    "is_flush": flush[at],
                    "missing": pd.Series(lacks, dtype=object),
                }
            )

        # All that can end a batch, a part at a time.
        ends = np.flatnonzero(flush | np.isin(np.arange(len(codes)), places.get(self.trigger, none)))
        for begin in range(0, len(ends), GIVE_ROWS):
            yield batches(ends[begin : begin + GIVE_ROWS])
        for name, own in places.items():
            if len(own):
                (value,) = values(own[-1:])
                self.values.updateValue((name,), (None if pd.isna(value) else value,))
        if newest_at[-1] != NO_TIME:
            self.newest.update((int(newest_at[-1]),))
        # The worker lives on for other lines.
        del tags, order, flush, codes, newest_at, places, ends
        pa.default_memory_pool().release_unused()

    def close(self) -> None:
        pass


class SilenceWatch(StatefulProcessor):
    """A timer per line that the next reading moves on; its firing is silence.

    Timers run on processing time, so a feed that stops altogether is noticed
    as well, and a line fires once until it reports again.
    """

    def __init__(self, threshold_s: float) -> None:
        self.threshold_ms = int(threshold_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at_ms bigint")
        self.silent = handle.getValueState("silent", "since_ms bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        for _ in rows:
            pass
        now = timerValues.getCurrentProcessingTimeInMs()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.threshold_ms)
        self.seen.update((now,))
        if self.silent.exists():
            self.silent.clear()
            yield _alert(key[0], "resumed", now, None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentProcessingTimeInMs()
        last = self.seen.get()[0]
        self.silent.update((last,))
        yield _alert(key[0], "silent", now, (now - last) / 1000.0)

    def close(self) -> None:
        pass


class SilenceByEvents(StatefulProcessor):
    """Silence and recovery by the clock of the events: a replay gives the same rows.

    A gap between two readings of a line is a silence if it is longer than the threshold,
    whichever batches they come in. A line that reports no more is silent once the newest
    reading of any line is past its limit.
    """

    def __init__(self, threshold_us: int) -> None:
        self.threshold_us = threshold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at_us bigint, is_silent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        at = np.sort(np.concatenate([frame["at_us"].to_numpy() for frame in rows]))
        was_silent = False
        if self.seen.exists():
            last, was_silent = self.seen.get()
            at = np.insert(at, 0, last)
        gap = np.flatnonzero(np.diff(at) > self.threshold_us)
        # A silence that a timer has told already only ends here.
        fired = gap[1:] if was_silent and len(gap) else gap
        self.seen.update((int(at.max()), False))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        limit_us = int(at.max()) + self.threshold_us
        self.handle.registerTimer(limit_us // 1000 + 1)
        yield self._rows(key[0], at[fired] + self.threshold_us, at[gap + 1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, _ = self.seen.get()
        self.seen.update((last, True))
        yield self._rows(key[0], np.array([last + self.threshold_us]), np.zeros(0, np.int64))

    def _rows(self, line_id: str, silent: np.ndarray, resumed: np.ndarray) -> pd.DataFrame:
        phases = ["silent"] * len(silent) + ["resumed"] * len(resumed)
        at = np.concatenate([silent, resumed]).astype(np.int64)
        names = pd.Series([line_id] * len(at), dtype=object)
        return pd.DataFrame(
            {"line_id": names, "phase": pd.Series(phases, dtype=object), "at_us": at}
        )

    def close(self) -> None:
        pass


class AlertCooldown(StatefulProcessor):
    """Lets an alert pass once per cooldown and counts what it holds back."""

    def __init__(self, cooldown_us: int) -> None:
        self.cooldown_us = cooldown_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.gate = handle.getValueState("gate", "last_us bigint, held bigint, seen_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        frame = pd.concat(list(rows)).sort_values(["at_us", "seq", "trigger_rank"])
        times = frame["at_us"].to_numpy()
        last, held, seen = self.gate.get() if self.gate.exists() else (None, 0, None)
        at = 0 if last is None else int(np.searchsorted(times, last + self.cooldown_us))
        held += at
        fires, counts = [], []
        while at < len(times):
            fires.append(at)
            counts.append(held)
            last = int(times[at])
            following = int(np.searchsorted(times, last + self.cooldown_us))
            held, at = max(following, at + 1) - at - 1, max(following, at + 1)
        newest = int(times[-1])
        self.gate.update((last, held, newest if seen is None else max(seen, newest)))
        yield frame.iloc[fires].assign(suppressed=counts)

    def close(self) -> None:
        pass


def _alert(line_id: str, phase: str, at_ms: int, quiet_s: float | None) -> pd.DataFrame:
    return pd.DataFrame(
        {"line_id": [line_id], "phase": [phase], "at_ms": [at_ms], "quiet_s": [quiet_s]}
    ).astype({"quiet_s": "float64"})


def assemble_stream(
    tags: DataFrame, trigger: str = TRIGGER_FIELD, held: DataFrame | None = None
) -> DataFrame:
    """Batches from a stream of tag changes, as ``operators.tags.assemble``.

    Rows are packed into binary tables before the exchange, and stay columns in the state's task. A line's rows of one micro-batch are sorted together, so bound the batch
    at the source. ``held`` is what ``operators.tags.held_values`` found in a table before the
    stream, which then goes on where the table ends.
    """
    use_state_store(tags.sparkSession)
    packed = tags.select(*TAG_COLUMNS).mapInArrow(_packed, PACKED_SCHEMA)
    return packed.groupBy("line_id").transformWithStateInPandas(
        statefulProcessor=TagAssembly(trigger),
        outputStructType=BATCH_SCHEMA,
        outputMode="Append",
        timeMode="None",
        initialState=None if held is None else held.groupBy("line_id"),
    )


def watch_silence(readings: DataFrame, threshold_s: float) -> DataFrame:
    """Silence and recovery of each line, by the clock of the cluster."""
    use_state_store(readings.sparkSession)
    return (
        readings.select("line_id")
        .groupBy("line_id")
        .transformWithStateInPandas(
            statefulProcessor=SilenceWatch(threshold_s),
            outputStructType=ALERT_SCHEMA,
            outputMode="Append",
            timeMode="ProcessingTime",
        )
    )


def watch_silence_by_events(
    readings: DataFrame, threshold_s: float, clock: str = "ingest_time"
) -> DataFrame:
    """``line_id``, ``phase`` and ``at_us`` of each silence and recovery, by a column of the readings.

    Rows without a line belong to none. The clock must not fall from batch to batch.
    """
    use_state_store(readings.sparkSession)
    arrivals = readings.filter("line_id is not null").select(
        "line_id", F.col(clock).alias("at"), F.unix_micros(clock).alias("at_us")
    )
    return (
        arrivals.withWatermark("at", "0 seconds")
        .groupBy("line_id")
        .transformWithStateInPandas(
            statefulProcessor=SilenceByEvents(int(round(threshold_s * 1_000_000))),
            outputStructType="line_id string, phase string, at_us bigint",
            outputMode="Append",
            timeMode="EventTime",
        )
    )


def cool_down(alerts: DataFrame, cooldown_us: int) -> DataFrame:
    """Alerts of a stream after the cooldown per kind and line.

    Like the operator over a table, each alert carries the count suppressed
    since the one before. What is held at the end is in ``held_alerts``.
    """
    use_state_store(alerts.sparkSession)
    columns = alerts.select(*EVENT_COLUMNS)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns.schema.fields)
    return columns.groupBy("kind", "line_id").transformWithStateInPandas(
        statefulProcessor=AlertCooldown(cooldown_us),
        outputStructType=f"{schema}, suppressed bigint",
        outputMode="Append",
        timeMode="None",
    )


def held_alerts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the cooldown of a stopped stream still holds, from its checkpoint."""
    state = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("stateVarName", "gate")
        .load()
    )
    return state.select(
        "key.kind",
        "key.line_id",
        F.col("value.last_us").alias("last_us"),
        F.col("value.seen_us").alias("seen_us"),
        F.col("value.held").alias("suppressed"),
    ).filter("suppressed > 0")


def pending_alerts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Held alerts as rows like those of ``cool_down``, of phase ``pending``."""
    return held_alerts(spark, checkpoint).select(
        F.lit(None).cast("bigint").alias("seq"),
        F.col("seen_us").alias("at_us"),
        F.lit(None).cast("int").alias("trigger_rank"),
        "kind",
        F.lit("pending").alias("phase"),
        "line_id",
        pending_text(F.col("suppressed")).alias("detail"),
        F.lit(None).cast("double").alias("value"),
        "suppressed",
    )
