"""Shared pieces: table access, the shared folder, bounded samples, byte-level views of Arrow text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass takes; its temporaries are some 60 times as large.
CHUNK_BYTES = 1 << 20

#: Rows up to which a (long, long) side is broadcast: 16 bytes a row, 8 MB. Beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stage_out(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and rereads it: lineage ends there and a lost executor costs no recompute."""
    path = f"{shared_dir(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stage(spark: SparkSession, df: DataFrame) -> None:
    """Deletes the files of a staged table that no later step reads."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = hadoop(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows in the actions within: wide rows then take bounded memory in a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_or_shuffled(side: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint if the counted rows stay within BROADCAST_ROWS, else the side as it is (shuffle join)."""
    return F.broadcast(side) if rows <= BROADCAST_ROWS else side


def not_broadcast(side: DataFrame, rows: int) -> DataFrame:
    """The side, merged if its rows exceed a tenth of BROADCAST_ROWS.

    Spark goes by sizes of files, in which ids take a few bytes, and the driver holds every broadcast until it is cleaned up: in loops they add up.
    """
    return side.hint("merge") if rows > BROADCAST_ROWS // 10 else side


def pack(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others within one column `rest`, so that no name can clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(*names, (F.struct(*others) if others else F.lit(None).cast("string")).alias("rest"))


def unpack(docs: DataFrame, *names: str) -> list[Column]:
    """The columns of docs in their order, of a frame made from pack(docs, *names)."""
    return [F.col(c) if c in names else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids whose crc32 (as text) is a multiple of five, and for null ids, which are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int], max_bytes: int) -> list[tuple[bytes, int]]:
    """At most per_class[y] texts of class y, in hash order of doc_id, never held-out ones.

    The bound is per_class rows and max_bytes a text (longer texts are passed over as training
    rows, not cut), so what the driver receives is bounded whatever the input.  Candidates are drawn
    twice over, so that texts passed over are replaced.
    """
    own = labels.where(~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("y"))
    order = F.xxhash64("doc_id")
    drawn = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(order, "doc_id").limit(2 * per_class[y])
        drawn = part if drawn is None else drawn.unionByName(part)
    rows = (
        docs.where(F.octet_length("text") <= max_bytes)
        .select("doc_id", F.col("text").cast("binary").alias("text"))
        .join(F.broadcast(drawn.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
        .select("doc_id", "text", "y", order.alias("o"))
    )
    # one scan; at most twice per_class texts arrive, of which each class's first ones in hash order are used
    found = rows.orderBy("o", "doc_id", "text").limit(2 * sum(per_class)).collect()
    return [(bytes(r.text), int(r.y)) for y in (0, 1) for r in [r for r in found if r.y == y][: per_class[y]]]


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; nulls are empty."""
    a = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if offsets is not None and len(a) else np.zeros(len(a) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer(b"".join(texts), np.uint8), off


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about limit bytes, one row at least."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multipliers (published splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x5851F42D4C957F2D


def word_spans(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of maximal runs of bytes with inside[byte]; rows split runs."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    is_in = inside[data]
    first = is_in.copy()
    first[1:] &= ~is_in[:-1]
    last = is_in.copy()
    last[:-1] &= ~is_in[1:]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = is_in[heads]
    tails = off[1:][off[:-1] < off[1:]] - 1
    last[tails] = is_in[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, off)


class WordHasher:
    """64-bit hashes of byte spans, from one running sum over a chunk. One a task; its tables grow on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * self.up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each size consecutive words, by position of the first; rows aren't regarded."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total = total * np.uint64(0x9E3779B97F4A7C15 | 1) + words[j : j + n]
        total ^= total >> np.uint64(29)
    return mix(total + np.uint64(size))


def segment_sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i+1]], 0 for empty segments."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:], dtype=np.float64)
    return total[off[1:]] - total[off[:-1]]
