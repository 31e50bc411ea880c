"""A topic as a partitioned log of segment files, and a stream source over it that admits rows by count, age or rate.

A segment is a Parquet file partition=P/<first offset>-<end offset>.parquet with the columns key, value and offset, so what
there is to read shows in a listing, and batch readers see an ordinary table. Segments are written by append(): rows go to
partitions by the hash of their key, in the order given, and a task that runs again writes the same names. One writer at a time.

The source (format "topic_log") plans batches of at most `max_rows` messages, dealt evenly over the partitions that have some.
With `min_rows` and `max_age_s` a batch waits until that many are there or the oldest is that old. With `rate` it releases so
many a second, from a token bucket that holds BURST_S seconds' worth. start and end bound the offsets of one partition (end counts).
What it has planned is noted in `progress` before Spark hears of it; after a restart the last plan comes first again, so a batch
never exceeds its bound and nothing is left out. Files are reached by pyarrow's file systems: local paths, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

BURST_S = 5.0
MESSAGE = "key string, value string, partition int, offset bigint"
SEGMENT = pa.schema([("key", pa.string()), ("value", pa.string()), ("offset", pa.int64())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass(frozen=True)
class Segment:
    partition: int
    start: int
    end: int  # one beyond its last offset
    path: str
    at: float  # when it was written


def segments(path: str) -> list[Segment]:
    """All segments of a topic, by partition and offset."""
    files, root = opened(path)
    out = []
    for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
        name = f.base_name.removesuffix(".parquet")
        folder = f.path.rsplit("/", 2)[-2]
        if f.is_file and folder.startswith("partition=") and name.replace("-", "").isdigit():
            start, end = map(int, name.split("-"))
            out.append(Segment(int(folder.removeprefix("partition=")), start, end, f.path, f.mtime.timestamp()))
    return sorted(out, key=lambda s: (s.partition, s.start))


def ends(found: list[Segment]) -> dict[int, int]:
    out: dict[int, int] = {}
    for s in found:
        out[s.partition] = max(out.get(s.partition, 0), s.end)
    return out


def append(messages: DataFrame, path: str, partitions: int, segment_rows: int = 100_000) -> DataFrame:
    """Write messages (key, value); returns what was written (partition, start, n). Rows of a partition keep the order they have
    in messages' partitions."""
    first = ends(segments(path))
    seat = F.monotonically_increasing_id()
    rows = messages.select("key", "value", F.pmod(F.xxhash64(F.coalesce("key", F.lit(""))), F.lit(partitions)).cast("int").alias("partition"), seat.alias("seat"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = opened(path)
        now, held, n, at, out = None, [], 0, 0, []

        def close() -> None:
            nonlocal held, n, at
            t = pa.Table.from_batches(held)
            table = pa.table({"key": t.column("key"), "value": t.column("value"), "offset": pa.array(range(at, at + n), pa.int64())}, schema=SEGMENT)
            files.create_dir(f"{root}/partition={now}", recursive=True)
            pq.write_table(table, f"{root}/partition={now}/{at:020d}-{at + n:020d}.parquet", filesystem=files)
            out.append((now, at, n))
            held, at, n = [], at + n, 0

        for b in batches:
            parts, a = b.column("partition").to_pylist(), 0
            while a < len(parts):
                if parts[a] != now:
                    if n:
                        close()
                    now, at = parts[a], first.get(parts[a], 0)
                z = a
                while z < len(parts) and parts[z] == now and n < segment_rows:
                    z, n = z + 1, n + 1
                held.append(b.slice(a, z - a))
                a = z
                if n >= segment_rows:
                    close()
        if n:
            close()
        cols = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["partition", "start", "n"])

    dealt = rows.repartition(partitions, "partition").sortWithinPartitions("partition", "seat")
    spark = messages.sparkSession
    return spark.createDataFrame(dealt.mapInArrow(write, "partition int, start bigint, n bigint").collect(), "partition int, start bigint, n bigint")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The whole log as a table; filters on partition and offset reach the files."""
    return spark.read.schema(MESSAGE).parquet(path).select("key", "value", "partition", "offset")


class Slice(InputPartition):
    def __init__(self, path: str, partition: int, start: int, end: int) -> None:
        self.path, self.partition, self.start, self.end = path, partition, start, end


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        o = options
        self.path, self.progress = o["path"], o["progress"]
        self.max_rows = int(o.get("max_rows", 0)) or None
        self.min_rows, self.max_age_s = int(o.get("min_rows", 1)), float(o.get("max_age_s", 0))
        self.rate = float(o.get("rate", 0)) or None
        self.only = int(o["partition"]) if "partition" in o else None
        self.first, self.last = int(o.get("start", 0)), int(o["end"]) + 1 if "end" in o else None
        self.planned: dict[int, int] | None = None
        self.tokens, self.filled = 0.0, None

    def _clip(self, found: list[Segment]) -> list[Segment]:
        return [s for s in found if self.only is None or s.partition == self.only]

    def initialOffset(self) -> dict:
        return {} if self.only is None else {str(self.only): self.first}

    def _noted(self) -> dict[int, int] | None:
        files, at = opened(self.progress)
        if files.get_file_info(at).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(at) as f:
            return {int(k): v for k, v in json.loads(f.read()).items()}

    def _note(self, plan: dict[int, int]) -> None:
        files, at = opened(self.progress)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(f"{at}.new") as f:
            f.write(json.dumps(plan).encode())
        files.move(f"{at}.new", at)

    def latestOffset(self) -> dict:
        if self.planned is None:
            noted = self._noted()
            self.planned = noted or {int(k): v for k, v in self.initialOffset().items()}
            if noted:  # Spark may not have heard of it
                return {str(k): v for k, v in self.planned.items()}
        found = self._clip(segments(self.path))
        waiting = {p: min(e, self.last or e) - self.planned.get(p, self.first) for p, e in ends(found).items()}
        waiting = {p: n for p, n in waiting.items() if n > 0}
        room = self._room(sum(waiting.values()), found)
        plan = dict(self.planned)
        for k, (p, n) in enumerate(sorted(waiting.items(), key=lambda x: x[1])):  # what small partitions leave goes to larger ones
            take = min(n, -(-room // (len(waiting) - k)))
            plan[p] = plan.get(p, self.first) + take
            room -= take
        if plan != self.planned:
            self._note(plan)
            self.planned = plan
        return {str(k): v for k, v in plan.items()}

    def _room(self, there: int, found: list[Segment]) -> int:
        """How many messages may be planned now."""
        now = time.time()
        oldest = min((s.at for s in found if s.end > self.planned.get(s.partition, self.first)), default=now)
        if there < self.min_rows and now - oldest < self.max_age_s:
            return 0
        room = min(there, self.max_rows or there)
        if self.rate:
            mono = time.monotonic()
            self.tokens = min(BURST_S * self.rate, self.tokens + (mono - self.filled) * self.rate) if self.filled is not None else 0.0
            self.filled = mono
            room = min(room, int(self.tokens))
            self.tokens -= room
        return room

    def partitions(self, start: dict, end: dict) -> Sequence[Slice]:
        out = []
        for s in self._clip(segments(self.path)):
            a, z = max(s.start, start.get(str(s.partition), self.first)), min(s.end, end.get(str(s.partition), 0))
            if a < z:
                out.append(Slice(s.path, s.partition, a, z))
        if back := [p for p, n in start.items() if end.get(p, 0) < n]:
            raise ValueError(f"the plan of partitions {back} is behind what was read: {self.progress} doesn't belong to this checkpoint")
        return out

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, _ = opened(self.path)
        with pq.ParquetFile(files.open_input_file(partition.path)) as f:
            for b in f.iter_batches(10_000, columns=["key", "value", "offset"]):
                o = b.column("offset").to_numpy()
                a, z = o.searchsorted(partition.start), o.searchsorted(partition.end)
                if a < z:
                    some = b.slice(a, z - a)
                    yield pa.RecordBatch.from_arrays([some.column("key"), some.column("value"), pa.array([partition.partition] * (z - a), pa.int32()), some.column("offset")], ["key", "value", "partition", "offset"])


class TopicLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "topic_log"

    def schema(self) -> str:
        return MESSAGE

    def streamReader(self, schema) -> LogReader:
        return LogReader(dict(self.options))


def stream(spark: SparkSession, path: str, progress: str, **options: object) -> DataFrame:
    """The log as a stream (key, value, partition, offset). progress: a file for this stream's plans, beside its checkpoint. options:
    max_rows, min_rows, max_age_s, rate, partition, start, end."""
    spark.dataSource.register(TopicLog)
    return spark.readStream.format("topic_log").option("path", path).option("progress", progress).options(**{k: v for k, v in options.items() if v is not None}).load()


def reached(query: StreamingQuery) -> dict[str, int]:
    """Where a query over a log has come to: the end offset of each partition."""
    p = query.lastProgress
    return (json.loads(p.json)["sources"][0]["endOffset"] if p else None) or {}
