"""A streaming source of feeds whose messages are landed in segments: files of lines, which it frees once they are processed.

    spark.dataSource.register(Segments)
    raw = spark.readStream.format("feed_segments").option("path", root).load()      # feed, segment, line, value

Below the root each feed has a folder of its own (sources.live.Lander writes there), with segments in it or in lanes, folders
below it, of whichever writer.  Within a folder segments are read in the order of their names, and a writer never lands a name
before one that is there; the names of live.Lander are times.  Names with a dot or an underscore in front aren't there yet.

Offsets hold the last segment of each folder.  A micro-batch is planned from two of them, so that after a failure the same segments are
read again, and a restarted query goes on after the last batch that it committed: no message is lost and none comes twice.
When a batch is committed, before the next one is planned, its segments are deleted (option `free`, true by default), so the backlog is
what is in the folders.

Options: path; free; per_trigger, segments of a folder that a micro-batch takes at most (all by default), for back-pressure; per_task,
segments that a task reads at most (64).  Each folder's segments are read by tasks of their own.  With trigger(availableNow) and per_trigger
a run takes one such batch.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# workers need not import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

COLUMNS = "feed string, segment string, line bigint, value string"
#: Lines of an Arrow batch.
LINES = 10_000


def _folder(path: str):  # noqa: ANN202
    """The file system of a path and the path within it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (FileSystem.from_uri(f"file://{path}"))


def backlog(path: str) -> dict[str, list[str]]:
    """Names of the segments in each folder, in order, by the folder's path below the root."""
    from pyarrow.fs import FileSelector, FileType

    fs, root = _folder(path)
    found: dict[str, list[str]] = {}
    for info in fs.get_file_info(FileSelector(root, allow_not_found=True, recursive=True)):
        parts = info.path[len(root) :].strip("/").split("/")
        if info.type == FileType.File and len(parts) > 1 and not any(p[0] in "._" for p in parts):
            found.setdefault("/".join(parts[:-1]), []).append(parts[-1])
    return {lane: sorted(names) for lane, names in sorted(found.items())}


@dataclass
class Share(InputPartition):
    """Segments of a folder that a task reads."""

    lane: str
    names: list[str]


class SegmentReader(DataSourceStreamReader):
    def __init__(self, path: str, free: bool = True, per_trigger: int = 0, per_task: int = 64) -> None:
        if per_trigger < 0 or per_task < 1:
            raise ValueError("per_trigger must not be negative, per_task be positive")
        self.path, self.free, self.per_trigger, self.per_task = path, free, per_trigger, per_task
        self.at: dict[str, str] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        out = dict(self.at)
        for lane, names in backlog(self.path).items():
            if new := [n for n in names if n > self.at.get(lane, "")]:
                # what is freed is gone, so of a query that starts again the first new segment is the first that is there
                out[lane] = new[self.per_trigger - 1 if 0 < self.per_trigger < len(new) and (self.free or self.at) else -1]
        return out

    def _between(self, start: dict, end: dict) -> dict[str, list[str]]:
        names = backlog(self.path)
        return {lane: [n for n in names.get(lane, []) if start.get(lane, "") < n <= last] for lane, last in end.items()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        return [Share(lane, names[i : i + self.per_task]) for lane, names in self._between(start, end).items() for i in range(0, len(names), self.per_task)]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        import io

        fs, root = _folder(self.path)
        feed = partition.lane.split("/")[0]
        for name in partition.names:
            segment = f"{partition.lane}/{name}"
            with fs.open_input_stream(f"{root}/{segment}") as raw, io.BufferedReader(raw, 1 << 20) as lines:
                held: list[tuple[str, str, int, str]] = []
                for i, line in enumerate(lines):
                    if text := line.rstrip(b"\r\n").decode("utf-8", "replace"):
                        held.append((feed, segment, i, text))
                    if len(held) == LINES:
                        yield self._batch(held)
                        held = []
                if held:
                    yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple[str, str, int, str]]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in COLUMNS.split(", ")])

    def commit(self, end: dict) -> None:
        if not self.free:
            return
        fs, root = _folder(self.path)
        for lane, names in self._between({}, end).items():
            for name in names:
                fs.delete_file(f"{root}/{lane}/{name}")


class Segments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_segments"

    def schema(self) -> str:
        return COLUMNS

    def streamReader(self, schema: object) -> SegmentReader:  # noqa: N802
        get = self.options.get
        if not get("path"):
            raise ValueError("path, the folder of the feeds, is missing")
        return SegmentReader(get("path"), str(get("free", "true")).lower() == "true", int(get("per_trigger", 0)), int(get("per_task", 64)))


def segments(spark: SparkSession, path: str, **options: str | int | bool) -> DataFrame:
    """The stream of all feeds' messages: feed, segment, line, value."""
    spark.dataSource.register(Segments)
    reader = spark.readStream.format("feed_segments").option("path", path)
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load()
