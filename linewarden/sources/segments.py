"""A broker's log as files, read as a stream by partition and offset.

A segment is one parquet file of consecutive messages of one partition, named
``<partition>-<first offset>-<messages>.parquet``; so a listing of the folder tells how far
every partition reaches, and no file is opened for it. A position of the stream is the next
offset of each partition. Files are reached through Arrow's file systems, on whatever
store the path names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
)

from linewarden.session import ship

ship(__name__)

FORMAT = "log_segments"
SCHEMA = "partition int, offset bigint, time timestamp, topic string, payload string"
COLUMNS = ["offset", "time", "topic", "payload"]
NAME = re.compile(r"^([0-9]+)-([0-9]+)-([0-9]+)[.]parquet$")
#: Messages of a segment that ``land_segments`` writes, as a power of two.
SEGMENT_BITS = 16
#: Messages of one task, unless a single segment has more.
PER_TASK = 1 << 20


def listing(path: str) -> list[tuple[int, int, int, str]]:
    """partition, first offset, messages and file name of every segment."""
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    found = files.get_file_info(pyarrow.fs.FileSelector(root, allow_not_found=True))
    out = []
    for info in found:
        named = NAME.match(info.base_name)
        if named:
            out.append((*map(int, named.groups()), info.base_name))
    return sorted(out)


def ends(segments: list[tuple[int, int, int, str]]) -> dict[str, int]:
    """The next offset of each partition; behind a missing segment nothing is there yet."""
    out: dict[str, int] = {}
    for partition, first, n, _ in segments:
        key = str(partition)
        if first <= out.get(key, 0):
            out[key] = max(out.get(key, 0), first + n)
    return out


class Stretch(InputPartition):
    """Pieces of segments for one task: partition, file, and offsets from and before."""

    def __init__(self, pieces: list[tuple[int, str, int, int]]):
        self.pieces = pieces


def stretches(path: str, start: dict[str, int], end: dict[str, int]) -> list[Stretch]:
    """The messages between two positions, dealt to tasks of about ``PER_TASK``."""
    out: list[Stretch] = []
    held: list[tuple[int, str, int, int]] = []
    size = 0
    for partition, first, n, name in listing(path):
        low = max(first, start.get(str(partition), 0))
        high = min(first + n, end.get(str(partition), 0))
        if low < high:
            held.append((partition, name, low, high))
            size += high - low
        if size >= PER_TASK:
            out.append(Stretch(held))
            held, size = [], 0
    return [*out, Stretch(held)] if held else out


def messages(path: str, stretch: Stretch) -> Iterator[pa.RecordBatch]:
    files, root = pyarrow.fs.FileSystem.from_uri(path)
    for partition, name, low, high in stretch.pieces:
        with files.open_input_file(f"{root}/{name}") as source:
            for batch in pq.ParquetFile(source).iter_batches(columns=COLUMNS):
                offset = batch.column("offset")
                inside = pc.and_(pc.greater_equal(offset, low), pc.less(offset, high))
                batch = batch.filter(inside)
                number = pa.array([partition] * batch.num_rows, pa.int32())
                time = batch.column("time").cast(pa.timestamp("us", "UTC"))
                rest = [batch.column("topic"), batch.column("payload")]
                yield pa.RecordBatch.from_arrays(
                    [number, batch.column("offset"), time, *rest], names=["partition", *COLUMNS]
                )


class SegmentStream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return ends(listing(self.path))

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return stretches(self.path, start, end)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return messages(self.path, partition)


class SegmentTable(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Stretch]:
        return stretches(self.path, {}, ends(listing(self.path)))

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        return messages(self.path, partition)


class LogSegments(DataSource):
    """``format("log_segments").load(path)``, as a table or a stream."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentTable:
        return SegmentTable(self.options["path"])

    def streamReader(self, schema) -> SegmentStream:
        return SegmentStream(self.options["path"])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the messages of a log: ``SCHEMA``."""
    spark.dataSource.register(LogSegments)
    return spark.readStream.format(FORMAT).load(path)


def segment_table(spark: SparkSession, path: str) -> DataFrame:
    """All messages that the log holds now."""
    spark.dataSource.register(LogSegments)
    return spark.read.format(FORMAT).load(path)


def land_segments(messages: DataFrame, path: str) -> int:
    """Write messages (``SCHEMA``) as segments, each by one task; returns how many.

    A segment has at most ``2 ** SEGMENT_BITS`` messages. A task that runs again writes the
    same file.
    """

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        files, root = pyarrow.fs.FileSystem.from_uri(path)
        files.create_dir(root)
        partition, first = table["partition"][0].as_py(), table["offset"][0].as_py()
        name = f"{partition}-{first}-{table.num_rows}.parquet"
        # Under another name first, as a reader may list the folder meanwhile.
        with files.open_output_stream(f"{root}/_{name}") as sink:
            pq.write_table(table.select(COLUMNS), sink)
        files.move(f"{root}/_{name}", f"{root}/{name}")
        return pa.table({"name": [name]})

    columns = ["partition", *COLUMNS]
    grouped = messages.select(*columns).groupBy(
        "partition", F.shiftright("offset", SEGMENT_BITS)
    )
    return grouped.applyInArrow(write, "name string").count()
