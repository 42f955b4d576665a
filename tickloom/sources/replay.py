"""Captures of JSON objects one after another, each over as many lines as it likes, read in parallel within a file.

An object begins at the first brace of a line outside of any other and ends with the line at whose end its braces balance.
Where one begins depends on all lines before it, but on little of them: whether an object is open, and how deep.  So a file is cut
into Spark's own splits, and

1. each split says what it makes of every state that it could begin in: `fresh`, the state it ends in if no object is open at its start, and
   `hits`, the same for each depth that its lines' ends bring back to zero; any other depth only grows by `total`;
2. a prefix scan over a file's splits, small rows, gives each the state it begins in, and whether what is open at its end is ever closed;
3. each split cuts its objects.  Whole ones are handed on where they are; of those that run over the ends of splits the
   fragments, one or two a split, are shuffled and joined.

Files that can't be split (compressed ones) are one split each.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# workers need not import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of objects that are handed on together.
BATCH = 1 << 20
#: A file's splits in order, each with its summary: null is no open object, a number the depth of one.
SUMMARY = "file long, start long, total long, fresh long, depths array<long>, ends array<long>"
_STATE = "file long, start long, state long, origin long, closes boolean"


def split_objects(lines: Iterable[str]) -> Iterator[str]:
    """Text of each object: from the first brace of a line until braces balance at a line's end.

    Braces within strings count, two objects on one line are one text, and an object that the input ends in is
    left out.
    """
    return (text for kind, text in cut(lines) if kind == "whole")


def cut(lines: Iterable[str], depth: int | None = None) -> Iterator[tuple[str, str]]:
    """(kind, text) of the objects of a split that begins within an object of that depth (None: within none).

    kind: whole; head, the rest of the object that was open; tail, what there is of the object that is open at the end; through, if that
    is the one that was open at the beginning.
    """
    parts: list[str] = []
    kind = "whole" if depth is None else "head"
    for line in lines:
        if depth is None:
            at = line.find("{")
            if at < 0:
                continue
            line, depth = line[at:], 0
        parts.append(line)
        depth += line.count("{") - line.count("}")
        if depth == 0:
            yield kind, "\n".join(parts) + "\n"
            parts, depth, kind = [], None, "whole"
    if depth is not None:
        yield ("through" if kind == "head" else "tail"), "".join(f"{p}\n" for p in parts)


def summary(lines: Iterable[str]) -> tuple[int, int | None, dict[int, int | None]]:
    """(total, fresh, hits) of a split; hits: by the depth that it begins in."""
    sums, first = [], []
    total = 0
    for line in lines:
        more, less = line.count("{"), line.count("}")
        # other lines neither open nor close anything
        if more or less:
            total += more - less
            sums.append(total)
            first.append(more - (less - line.count("}", 0, line.find("{"))) if more else None)
    # from the end: what an object that is open before a line comes to, and what no open object does
    closing: dict[int, int | None] = {}
    state: int | None = None
    for now, own in zip(reversed(sums), reversed(first), strict=True):
        # a depth of zero at this line's end is followed by `state`, whatever came before
        after = state
        if own:
            # an object begins here; it closes where the sum has fallen by its depth
            state = closing.get(now - own, total - now + own)
        closing[now] = after
    return total, state, {-value: end for value, end in closing.items()}


def _splits(spark: SparkSession, path: str) -> DataFrame:
    """file (hashed), start and value of each line; a split's lines come in order, in one task."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[str]]]:
    """(file, start, lines) of each split of a task."""
    from itertools import groupby

    def rows() -> Iterator[tuple[int, int, str]]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "start", "value")), strict=True)

    for (file, start), lines in groupby(rows(), key=lambda x: x[:2]):
        yield file, start, (x[2] for x in lines)


def summaries(lines: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, values in _parts(batches):
            total, fresh, hits = summary(values)
            row = [file], [start], [total], [fresh], [list(hits)], [list(hits.values())]
            kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["file", "start", "total", "fresh", "depths", "ends"])

    return lines.mapInArrow(run, SUMMARY)


def scan(splits: list[dict]) -> list[tuple[int, int, int | None, int | None, bool]]:
    """(file, start, state, origin, closes) of a file's splits, of their summaries in order.

    origin: the split in which the object began that is open at a split's start.  closes: whether the one that is open at its end is closed later.
    """
    state, origin = None, None
    out = []
    for x in splits:
        hits = dict(zip(x["depths"], x["ends"], strict=True))
        out.append([x["file"], x["start"], state, origin, False])
        if state is None or state in hits:
            state = x["fresh"] if state is None else hits[state]
            origin = None if state is None else x["start"]
        else:
            state += x["total"]
    # of the object that the file ends in nothing is kept
    for row in out[::-1]:
        row[4] = origin is None or row[1] < origin
    return [tuple(r) for r in out]


def _states(found: DataFrame) -> DataFrame:
    """A row for each split, from a scan of each file's summaries, whose number is that of the file's splits."""

    def run(table: pa.Table) -> pa.Table:
        rows = scan(table.sort_by("start").to_pylist())
        kinds = [("file", pa.int64()), ("start", pa.int64()), ("state", pa.int64()), ("origin", pa.int64()), ("closes", pa.bool_())]
        return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds)})

    return found.groupBy("file").applyInArrow(run, _STATE)


def _cut(lines: DataFrame, states: dict[tuple[int, int], tuple], whole: bool) -> DataFrame:
    """value of each whole object, or file, origin, start and value of the fragments of others."""
    shared = lines.sparkSession.sparkContext.broadcast(states)
    schema = pa.schema([("file", pa.int64()), ("origin", pa.int64()), ("start", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, values in _parts(batches):
            if (file, start) not in shared.value:
                raise RuntimeError("the splits aren't those that were scanned: read the captures again")
            state, origin, closes = shared.value[file, start]
            held, size = [], 0
            for kind, text in cut(values, state):
                if (kind == "whole") != whole or kind in ("tail", "through") and not closes:
                    continue
                held.append((file, start if kind == "tail" else origin, start, text))
                size += len(text)
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return lines.mapInArrow(run, "file long, origin long, start long, value string")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """`value`: the text of each object in the files at path.

    The scan of the splits runs at once, over all files; the driver holds a row of five numbers for each split, as it does a
    task.  Should splits change until the objects are read (by other settings, or files that grow), reading fails.
    Captures of one object a line are better read by feeds.landed.
    """
    lines = _splits(spark, path)
    found = _states(summaries(lines)).collect()
    states = {(r.file, r.start): (r.state, r.origin, r.closes) for r in found}
    pieces = _cut(lines, states, False).groupBy("file", "origin").agg(F.sort_array(F.collect_list(F.struct("start", "value"))).alias("x"))
    return _cut(lines, states, True).select("value").unionByName(pieces.select(F.array_join("x.value", "").alias("value")))
