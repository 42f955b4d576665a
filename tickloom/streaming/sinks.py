"""A sink that pushes what a stream emits to receivers, once each, and counters of a stream.

    spark.dataSource.register(Push)
    candles.writeStream.format("push").option("path", inbox).option("checkpointLocation", ...).start()

Tasks write what they have to deliver to files of their own, whose names aren't repeated by another attempt.  On commit the
driver lists the files of the attempts that succeeded in one small file named by the micro-batch, written aside and renamed: a batch is delivered
when that file is there, whole or not at all, and a batch that is run again is passed over if it is.  Attempts that failed and
batches that were aborted leave nothing that is listed; their files are deleted on abort, or by sweep().

A receiver reads an inbox in the order of batches, from the one after its last: deliveries().  It calls back where it runs, on the driver
or in a task, and remembers the last batch with whatever it has done; so each row takes effect once.
"""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

# workers need not import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Why parsers reject.
REASONS = ("malformed", "not_trade", "missing_field", "bad_number", "bad_time")


def _folder(path: str):  # noqa: ANN202
    """The file system of a path and the path within it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Delivered(WriterCommitMessage):
    """What a task has written; no name if it had no rows."""

    name: str | None
    rows: int


class PushWriter(DataSourceStreamWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, check: Callable[[Row], None] | None = None) -> None:
        self.path, self.columns, self.check = path, schema.fieldNames(), check

    def write(self, iterator: Iterator[Row]) -> Delivered:
        fs, root = _folder(self.path)
        fs.create_dir(f"{root}/data", recursive=True)
        name, n, out = f"{uuid.uuid4().hex}.jsonl", 0, None
        try:
            for row in iterator:
                if out is None:
                    out = fs.open_output_stream(f"{root}/data/{name}")
                if self.check:
                    self.check(row)
                out.write((json.dumps({c: row[c] for c in self.columns}, default=str) + "\n").encode())
                n += 1
        finally:
            if out is not None:
                out.close()
        return Delivered(name if n else None, n)

    def commit(self, messages: list[Delivered | None], batchId: int) -> None:  # noqa: N803
        from pyarrow.fs import FileType

        fs, root = _folder(self.path)
        fs.create_dir(f"{root}/batches", recursive=True)
        final = f"{root}/batches/{batchId:012d}.json"
        names = [m.name for m in messages if m and m.name]
        if fs.get_file_info(final).type == FileType.File:
            # delivered before the query stopped; what this attempt wrote isn't listed
            self._drop(names)
            return
        aside = f"{root}/batches/.{uuid.uuid4().hex}"
        with fs.open_output_stream(aside) as out:
            out.write(json.dumps({"batch": batchId, "files": names, "rows": sum(m.rows for m in messages if m)}).encode())
        fs.move(aside, final)

    def abort(self, messages: list[Delivered | None], batchId: int) -> None:  # noqa: N803
        self._drop([m.name for m in messages if m and m.name])

    def _drop(self, names: list[str]) -> None:
        fs, root = _folder(self.path)
        for name in names:
            fs.delete_file(f"{root}/data/{name}")


class Push(DataSource):
    @classmethod
    def name(cls) -> str:
        return "push"

    def streamWriter(self, schema: StructType, overwrite: bool) -> PushWriter:  # noqa: N802
        if not self.options.get("path"):
            raise ValueError("path, the inbox, is missing")
        return PushWriter(self.options["path"], schema, overwrite)


def deliveries(path: str, after: int = -1) -> Iterator[tuple[int, Iterator[dict]]]:
    """(batch, its rows) of each batch that is delivered, in order, from the one after `after`."""
    from pyarrow.fs import FileSelector

    fs, root = _folder(path)
    files = sorted(x.path for x in fs.get_file_info(FileSelector(f"{root}/batches", allow_not_found=True)) if x.base_name[0] != ".")

    def rows(names: list[str]) -> Iterator[dict]:
        import io

        for name in names:
            with fs.open_input_stream(f"{root}/data/{name}") as raw, io.BufferedReader(raw) as lines:
                yield from map(json.loads, lines)

    for file in files:
        with fs.open_input_stream(file) as f:
            listed = json.loads(f.read())
        if listed["batch"] > after:
            yield listed["batch"], rows(listed["files"])


def delivered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that are delivered, read by tasks; the driver holds the files' names."""
    fs, root = _folder(path)
    from pyarrow.fs import FileSelector

    names: list[str] = []
    for info in fs.get_file_info(FileSelector(f"{root}/batches", allow_not_found=True)):
        if info.base_name[0] != ".":
            with fs.open_input_stream(info.path) as f:
                names += [f"{path.rstrip('/')}/data/{n}" for n in json.loads(f.read())["files"]]
    return spark.read.schema(schema).json(names) if names else spark.createDataFrame([], schema)


def sweep(path: str) -> int:
    """Deletes files that no batch lists, of attempts that were lost; only while no query writes there. Their number."""
    from pyarrow.fs import FileSelector

    fs, root = _folder(path)
    listed: set[str] = set()
    for info in fs.get_file_info(FileSelector(f"{root}/batches", allow_not_found=True)):
        if info.base_name[0] != ".":
            with fs.open_input_stream(info.path) as f:
                listed |= set(json.loads(f.read())["files"])
    lost = [x.path for x in fs.get_file_info(FileSelector(f"{root}/data", allow_not_found=True)) if x.base_name not in listed]
    for p in lost:
        fs.delete_file(p)
    return len(lost)


def _outcomes() -> list[Column]:
    """Counts of parsed messages: rows, trades, and rejects by reason."""
    reasons = [F.count_if(F.col("reject") == x).alias(x) for x in REASONS]
    return [F.count(F.lit(1)).alias("rows"), F.count_if(F.col("reject").isNull()).alias("trades"), *reasons]


def observed(parsed: DataFrame, name: str | Observation = "feeds") -> DataFrame:
    """Parsed messages (a row a trade or reject) as they are, their outcomes counted in the tasks: for Counters, or in batch for an Observation."""
    return parsed.observe(name, *_outcomes())


class Counters(StreamingQueryListener):
    """Sums of what micro-batches observe under a name, and of the rows that they read: add it by spark.streams.addListener.

    A micro-batch that failed isn't told of, so one that is run again counts once.
    """

    def __init__(self, name: str = "feeds") -> None:
        self.name, self.totals, self.input_rows, self.ended = name, {}, 0, 0
        self._told: set[tuple[str, int]] = set()

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        progress = event.progress
        row, told = progress.observedMetrics.get(self.name), (str(progress.runId), progress.batchId)
        # a batch without data is told of with its number, and with the last counts
        if row is None or told in self._told:
            return
        self._told.add(told)
        self.input_rows += progress.numInputRows
        for key, value in row.asDict().items():
            self.totals[key] = self.totals.get(key, 0) + value

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        self.ended += 1

    def wait(self, runs: int = 1, seconds: float = 60) -> None:
        """Until so many queries have ended; listeners are told some time after."""
        until = time.monotonic() + seconds
        while self.ended < runs and time.monotonic() < until:
            time.sleep(0.05)
