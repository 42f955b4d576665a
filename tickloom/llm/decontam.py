"""Benchmark decontamination by a broadcast hash set of the benchmark's word n-grams.

Words are runs of ASCII letters and digits and of non-ASCII characters, ASCII lower-cased.  A window is
WINDOW consecutive words of an item; an item of fewer words, but not none, is one window.  Documents
are scanned once: hashes of their word windows are looked up in the sorted set, and every hit is verified
word for word before it counts.  A document word inside any verified window is hit; documents or the
hit spans can then be removed.

The set is broadcast only while its items can have no more than SET_WORDS words in all.  The hashes of a larger
benchmark go into a Bloom filter of BITS bits, which is broadcast in its place: documents are still scanned once,
windows that pass the filter are joined with the benchmark's windows by all their words, and the spans that are
so verified return to their rows.  A benchmark beyond some BITS / 10 windows makes the filter let more pass, never less.

Null and empty texts have no words and no hits; items without words have no window.  Repeated items
count by item_id; items with a null id are named by the empty string.  Repeated documents are each
judged on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, WordHasher, byte_view, chunks, joined, mix, pack, stage_out, unpack, window_hashes, word_spans

WINDOW = 10
#: Words in the items of a broadcast set at most; a window takes some 500 bytes in a worker.
SET_WORDS = 200_000
#: Of the Bloom filter, 32 MB, and bits that a window sets; hashes that reach the driver in one row.
BITS, SET_BITS, HASHES_A_ROW = 1 << 28, 4, 1 << 16

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
INSIDE = WORD[LOWER]


def item_windows(text: bytes, window: int, hasher: WordHasher) -> Iterator[tuple[int, int, bytes]]:
    """(words, hash, the words joined by blanks) of each window of an item."""
    data, off = joined([text])
    starts, ends, _ = word_spans(data, off, INSIDE)
    if len(starts):
        size = min(window, len(starts))
        low = LOWER[data]
        hashes = window_hashes(hasher(low, starts, ends), size)
        parts = [low[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        for i, h in enumerate(hashes.tolist()):
            yield size, h, b" ".join(parts[i : i + size])


def _places(first: np.ndarray, size: int, at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(row, place of the window among all words) of those windows at `at` that lie within a row."""
    for i in at.tolist():
        row = int(np.searchsorted(first, i, "right")) - 1
        if i + size <= first[row + 1]:
            yield row, i


class NgramSet:
    """Windows of the items: by length, sorted hashes with the windows' words and items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        hasher = WordHasher()
        # by length and hash, the windows that have it; few hashes have more than one
        found: dict[int, dict[int, dict[bytes, set[str]]]] = {}
        for name, text in items:
            for size, h, words in item_windows(text, window, hasher):
                found.setdefault(size, {}).setdefault(h, {}).setdefault(words, set()).add(name)
        self.hashes = {size: np.array(sorted(v), np.uint64) for size, v in found.items()}
        self.windows = {size: [v[h] for h in sorted(v)] for size, v in found.items()}

    def hits(self, data: np.ndarray, off: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, list[tuple[int, int, int, set[str]]]]:
        """(words of each row, verified hits as (row, first word, words, items))."""
        starts, ends, first = word_spans(data, off, INSIDE)
        out: list[tuple[int, int, int, set[str]]] = []
        if len(starts):
            low = LOWER[data]
            hashes = hasher(low, starts, ends)
            for size, known in self.hashes.items():
                mine = window_hashes(hashes, size)
                if not len(mine):
                    continue
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                for row, i in _places(first, size, np.flatnonzero(known[at] == mine)):
                    items = self.windows[size][at[i]].get(_joined(low, starts, ends, i, size))
                    if items is not None:
                        out.append((row, i - int(first[row]), size, items))
        return np.diff(first), out


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, size: int) -> bytes:
    return b" ".join(low[a:b].tobytes() for a, b in zip(starts[at : at + size], ends[at : at + size], strict=True))


class Bloom:
    def __init__(self, sizes: list[int], bits: int) -> None:
        self.sizes, self.bits = sizes, np.zeros(bits // 8, np.uint8)

    def _at(self, hashes: np.ndarray, k: int) -> np.ndarray:
        return mix(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(8 * len(self.bits))

    def add(self, hashes: np.ndarray) -> None:
        for k in range(SET_BITS):
            at = self._at(hashes, k)
            np.bitwise_or.at(self.bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that pass."""
        left = np.arange(len(hashes))
        for k in range(SET_BITS):
            at = self._at(hashes[left], k)
            left = left[self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
        return left


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def scan(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int | None = None) -> DataFrame:
    """Every row of docs with _n_words, _hits (word spans, united) and _items (sorted); docs has none of these (see pack)."""
    items = _items(benchmark)
    # no text has more words than half its bytes and one
    size = items.agg(F.sum(F.floor(F.octet_length("text") / 2) + 1)).first()[0] or 0
    if size <= (SET_WORDS if most is None else most):
        return _scan(spark, docs, [(r.item_id, bytes(r.text)) for r in items.collect()], window)
    return _filtered(spark, docs, items, window)


def _windows(items: DataFrame, window: int) -> DataFrame:
    """words (of a window), h, size and the items that have it, one row a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = list(item_windows(text, window, hasher))
                for lo in range(0, len(found), 10_000):
                    sizes, hashes, words = zip(*found[lo : lo + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(words, pa.binary()), pa.array([name] * len(words))], ["size", "h", "words", "item"])

    return items.mapInArrow(run, "size int, h long, words binary, item string").groupBy("size", "h", "words").agg(F.collect_set("item").alias("items"))


def _filtered(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    known = stage_out(spark, _windows(items, window), "windows")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([h[lo : lo + HASHES_A_ROW].tobytes() for lo in range(0, len(h), HASHES_A_ROW)], pa.binary())], ["h"])

    bloom = Bloom([r.size for r in known.select("size").distinct().collect()], BITS)
    # one row at a time
    for r in known.select("h").mapInArrow(packed, "h binary").toLocalIterator():
        bloom.add(np.frombuffer(r.h, np.uint64))
    shared = spark.sparkContext.broadcast(bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bloom = WordHasher(), shared.value
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            words, found = [], [[] for _ in range(len(off) - 1)]
            for lo, _, d, o in chunks(data, off):
                starts, ends, first = word_spans(d, o, INSIDE)
                words.append(np.diff(first))
                low = LOWER[d]
                hashes = hasher(low, starts, ends)
                for size in bloom.sizes:
                    mine = window_hashes(hashes, size)
                    for row, i in _places(first, size, bloom.may_have(mine)):
                        found[lo + row].append({"start": i - int(first[row]), "size": size, "h": int(mine[i : i + 1].view(np.int64)[0]), "words": _joined(low, starts, ends, i, size)})
            extra = [pa.array(np.concatenate([*words, np.zeros(0, np.int64)])), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int32()), ("h", pa.int64()), ("words", pa.binary())])))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_n_words", "_found"])

    struct = T.StructType([T.StructField("start", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("words", T.BinaryType())])
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_words", T.LongType()), T.StructField("_found", T.ArrayType(struct))])
    # one scan; rows are named in the written copy
    rows = stage_out(spark, docs.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "rows")
    each = rows.where(F.size("_found") > 0).select("_row", F.explode("_found").alias("_f")).select("_row", "_f.*")
    hits = each.join(known, ["size", "h", "words"]).groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct("start", F.col("size").alias("words")))).alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"),
    )
    out = rows.drop("_found").join(stage_out(spark, hits, "hits"), "_row", "left")
    none = lambda c, like: F.coalesce(c, F.array().cast(hits.schema[like].dataType)).alias(like)
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), "_n_words", none("_hits", "_hits"), none("_items", "_items"))


def _scan(spark: SparkSession, docs: DataFrame, items: list[tuple[str, bytes]], window: int) -> DataFrame:
    shared = spark.sparkContext.broadcast(NgramSet(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(), shared.value
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            n = len(off) - 1
            words = np.zeros(n, np.int64)
            hits: list[list[dict]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            for lo, hi, d, o in chunks(data, off):
                words[lo:hi], found = known.hits(d, o, hasher)
                for row, at, size, names in found:
                    hits[lo + row].append({"start": at, "words": size})
                    items[lo + row] |= names
            kind = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int32())]))
            extra = [pa.array(words), pa.array(hits, kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "_n_words", "_hits", "_items"])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("words", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_words", T.LongType()), T.StructField("_hits", spans), T.StructField("_items", T.ArrayType(T.StringType()))])
    return docs.mapInArrow(run, schema)


def n_hit() -> F.Column:
    """Words inside any of the spans in _hits: positions, each once."""
    positions = F.flatten(F.transform("_hits", lambda h: F.sequence(h["start"], h["start"] + h["words"] - 1)))
    return F.size(F.array_distinct(positions)).cast("long")


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row."""
    found = scan(spark, docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("_hits") > 0).alias("contaminated"),
    )


def remove_documents(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows without a verified window, with the columns of docs."""
    return scan(spark, pack(docs, "text"), benchmark, window).where(F.size("_hits") == 0).select(*unpack(docs, "text"))


def remove_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """All rows, with the words of verified windows cut out of text, from the first word's start to the last one's end."""
    found = scan(spark, pack(docs, "text"), benchmark, window).select("text", "rest", "_hits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("_hits").to_pylist()):
                if not spans:
                    continue
                raw = texts[i].encode()
                data, off = joined([raw])
                starts, ends, _ = word_spans(data, off, INSIDE)
                keep = np.ones(len(raw), bool)
                for s in spans:
                    keep[starts[s["start"]] : ends[s["start"] + s["words"] - 1]] = False
                texts[i] = data[keep].tobytes().decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], ["text", "rest"])

    return found.mapInArrow(run, found.drop("_hits").schema).select(*unpack(docs, "text"))
