"""Bytes appended to log files, as a Spark data source whose offsets are (file, byte).

The same listing serves both uses: a stream that goes on where its checkpoint ends, and a batch read of what was
appended after a snapshot of the file sizes. A split reads its own range of bytes, so one huge log is read by many tasks.
"""

from __future__ import annotations

import ast
import fnmatch
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.logs import LogMarks, log_health

SCHEMA = "file string, start bigint, value string"
#: bytes that one task reads
SPLIT_BYTES = 32 << 20
#: lines handed to Spark at once
BATCH_LINES = 4096
#: step of the search for the last line end
TAIL_BYTES = 1 << 16


@dataclass
class Range(InputPartition):
    """Lines of a file that begin in [start, end); ``low`` is where the first unread line begins."""

    file: str
    low: int
    start: int
    end: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or a URI that pyarrow knows (file, hdfs, s3, gs)."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _sizes(path: str, pattern: str) -> dict[str, int]:
    """Size of every matching file below a folder, by its path below it."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    files = (f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern))
    return {f.path[len(root) :].lstrip("/"): f.size for f in files}


def _line_end(store: fs.FileSystem, path: str, low: int, size: int) -> int:
    """Place after the last line end in [low, size), or ``low``."""
    with store.open_input_file(path) as f:
        at = size
        while at > low:
            begin = max(low, at - TAIL_BYTES)
            f.seek(begin)
            cut = f.read(at - begin).rfind(b"\n")
            if cut >= 0:
                return begin + cut + 1
            at = begin
    return low


def decode(line: bytes) -> str:
    """UTF-8, else GBK, as logs of either encoding turn up; what is neither is replaced."""
    try:
        return line.decode("utf-8")
    except UnicodeDecodeError:
        return line.decode("gbk", "replace")


class _Files:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict[str, str]):
        if "path" not in options:
            raise ValueError("the path option is required")
        self.path, self.pattern = options["path"], options.get("pattern", "*")
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)

    def ends(self, since: dict[str, int], whole_lines: bool) -> dict[str, int]:
        """Where each file ends, with ``whole_lines`` after its last line end; only files that changed are opened."""
        store, root = _store(self.path)
        out = {}
        for name, size in sorted(_sizes(self.path, self.pattern).items()):
            low = since.get(name, 0)
            low = low if low <= size else 0  # the file was cut and written anew
            out[name] = _line_end(store, f"{root}/{name}", low, size) if whole_lines and size > low else size
        return out

    def ranges(self, since: dict[str, int], until: dict[str, int]) -> list[Range]:
        out = []
        for name, end in sorted(until.items()):
            low = since.get(name, 0)
            low = low if low <= end else 0
            out += [Range(name, low, at, min(at + self.split, end)) for at in range(low, end, self.split)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing to read: Spark runs one task all the same
            return
        store, root = _store(self.path)
        files, starts, values = [], [], []
        with io.BufferedReader(store.open_input_file(f"{root}/{part.file}"), 1 << 20) as f:
            at = part.start
            if at > part.low:  # the line that runs over the border belongs to the split before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            f.seek(at)
            while at < part.end and (line := f.readline()):
                files.append(part.file)
                starts.append(at)
                values.append(decode(line.rstrip(b"\r\n")))
                at += len(line)
                if len(values) == BATCH_LINES:
                    yield _batch(files, starts, values)
                    files, starts, values = [], [], []
        if values:
            yield _batch(files, starts, values)


def _batch(files: list[str], starts: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(starts, pa.int64()), pa.array(values, pa.string())], names=["file", "start", "value"])


class _Batch(_Files, DataSourceReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.since = json.loads(options.get("since") or "{}")

    def partitions(self) -> list[Range]:
        return self.ranges(self.since, self.ends(self.since, whole_lines=False))


class _Stream(_Files, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.at: dict[str, int] = json.loads(options.get("since") or "{}")
        self.first = dict(self.at)

    def initialOffset(self) -> dict[str, int]:
        return self.first

    def latestOffset(self) -> dict[str, int]:
        self.at = self.ends(self.at, whole_lines=True)
        return self.at

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        return self.ranges(start, end)

    def commit(self, end: dict[str, int]) -> None:
        pass


class AppendedLog(DataSource):
    """Format ``appended_log``: lines (file, start, value) of files below ``path``.

    Options: ``pattern`` of file names (default all), ``since`` (JSON of file to byte: a snapshot), ``splitBytes``.
    Offsets hold one number per file. A file that is shorter than its offset was written anew and is read from its
    beginning. The stream takes whole lines and leaves an unfinished last line until its end is written; the batch
    takes it too. Lines end with LF or CRLF and are UTF-8 or GBK.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def snapshot_offsets(path: str, pattern: str = "*") -> dict[str, int]:
    """Bytes of every log now; a later read takes what comes after."""
    return _sizes(path, pattern)


def read_appended(spark: SparkSession, path: str, since: dict[str, int] | None = None, pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Lines appended after a snapshot; files that it does not know are read whole."""
    spark.dataSource.register(AppendedLog)
    options = {"pattern": pattern, "since": json.dumps(since or {}), "splitBytes": split_bytes}
    return spark.read.format("appended_log").options(**options).load(path)


def read_appended_stream(spark: SparkSession, path: str, since: dict[str, int] | None = None, pattern: str = "*", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The same as a stream; its checkpoint takes the place of the snapshot after the first batch."""
    spark.dataSource.register(AppendedLog)
    options = {"pattern": pattern, "since": json.dumps(since or {}), "splitBytes": split_bytes}
    return spark.readStream.format("appended_log").options(**options).load(path)


def appended_health_stream(spark: SparkSession, path: str, out: str, checkpoint: str, pattern: str = "*", marks: LogMarks = LogMarks()):
    """Count the lines appended since the last run, per file, and stop.

    A batch overwrites its own folder, so one that is replayed after a failure counts once: its byte ranges come from
    the checkpoint and hold the same lines again. Read the sum with ``logs.log_health_total``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        log_health(batch, ["file"], marks).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    goal = _Stream({"path": path, "pattern": pattern}).latestOffset()
    for _ in range(2):  # a run takes one batch, and one that failed before comes first
        query = (
            read_appended_stream(spark, path, pattern=pattern)
            .writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        last = query.lastProgress
        reached = ast.literal_eval(str(last["sources"][0]["endOffset"])) if last else {}
        if all(reached.get(name, 0) >= end for name, end in goal.items()):
            break
    return query


def health_by_file(spark: SparkSession, out: str) -> DataFrame:
    """Counts of all batches so far, per file."""
    counts = [c for c in spark.read.parquet(out).columns if c not in ("file", "batch")]
    return spark.read.parquet(out).groupBy("file").agg(*[F.sum(c).alias(c) for c in counts])
