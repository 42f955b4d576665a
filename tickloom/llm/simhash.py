"""Near-duplicate detection with SimHash fingerprints, found by multi-index hashing.

A document's words are runs of other characters than ASCII white space, A-Z lower-cased.  Its shingles are all runs of
SHINGLE words, repeats included, joined by single blanks; of fewer words the whole sequence is one, without words there is
none and the fingerprint is zero, which links like any other.  A bit of the fingerprint is set if it is in over half of the
shingles' XXH64 hashes (seed 42).  Fingerprints link at RADIUS = 4 or fewer differing bits.

1. Every document is scanned once, in pieces, for its fingerprint.  Equal fingerprints are one class from there on.
2. Multi-index hashing: fingerprints are two segments of 32 bits.  Of a pair within 4 bits, the first segments differ in at
   most 2, or else the second ones in at most 1.  Each fingerprint is entered in a table under every key of the small ball
   of radius 1 around each of its segments, 33 keys a segment.  Two first segments within 2 bits share a key, halfway; a second segment
   within 1 bit of another is a key of its.  Keys are counted; one of two fingerprints is a pair, those of more are gathered as lists, and
   members are verified by their complete distance.  A pair that shares several keys is taken once.
3. A key with more than PAIRED fingerprints doesn't give its pairs, since those would be all pairs of a family: its members are
   compared in a task and each is linked to the least one that it reaches there, a row a member.
4. A key with more than SMALL fingerprints isn't compared at all.  Its members go by
   whole balls: two fingerprints are within 4 bits exactly if their balls of radius 2 (2,081 points) share a point.  So every
   point links its members to the least of them: rows in proportion to members, no pairs, and nothing passed over.
5. Links of a fingerprint to lesser ones become links of those and it to the least of them, twice over, which leaves a few a member.
   They join components, which are named by their smallest doc_id.

Random keys: of D fingerprints a key holds 33 D / 2^32 by chance, so SMALL is far above chance up to some 10^10 of them.

Null texts have no words.  Rows with a null id take part in linking; their component is the smallest id that is there, null
if there is none.  Rows that repeat an id are linked by each one's own text.  Other columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_rows, byte_view, drop_stage, not_broadcast, stage_out
from .setsketch import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a key up to which they are compared, and up to which all pairs found are links.
SMALL, PAIRED = 256, 16
#: Shingles whose bits are counted at once, 64 bytes each.
PIECE = 1 << 15
_LOW = (1 << 32) - 1


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    n = len(words) - size + 1
    counts = np.zeros(64, np.int64)
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        spans = zip(starts[lo:hi].tolist(), ends[lo + size - 1 : hi + size - 1].tolist(), strict=True)
        counts += bit_counts(np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64))
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            found = np.array([fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def ball(bits: int, radius: int) -> list[int]:
    """All words of so many bits with at most radius of them set."""
    return [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(bits), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _literals(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def _high(fp: str) -> Column:
    return F.shiftrightunsigned(F.col(fp), 32)


def _low(fp: str) -> Column:
    """The second segment as a key: marked by the bit above it."""
    return F.col(fp).bitwiseAND(F.lit(_LOW)).bitwiseOR(F.lit(1 << 32))


def _entries(unique: DataFrame) -> DataFrame:
    """fp under each key z of the balls of radius 1 around its segments."""
    around = lambda segment: F.transform(_literals(ball(32, 1)), lambda m: segment.bitwiseXOR(m))
    return unique.select("fp", F.explode(F.concat(around(_high("fp")), around(_low("fp")))).alias("z"))


def star(near: np.ndarray) -> np.ndarray:
    """The least place that each place reaches, of a symmetric matrix of which places are near each other (each is to itself)."""
    label = np.arange(len(near))
    while True:
        least = np.where(near, label, len(near)).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def linked(fps: np.ndarray, paired: int = PAIRED) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b: links of a key's fingerprints; their pairs within RADIUS bits, or of more than `paired` fingerprints a link a member to the least that it reaches."""
    fps = np.sort(fps)
    near = np.bitwise_count((fps[:, None] ^ fps).view(np.uint64)) <= RADIUS
    if len(fps) <= paired:
        a, b = np.nonzero(np.triu(near, 1))
    else:
        a, b = star(near), np.arange(len(fps))
        a, b = a[a < b], b[a < b]
    return fps[a], fps[b]


def _compared(lists: DataFrame) -> DataFrame:
    """a, b of the links of each list (column fps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("fps")
            values, off = column.values.to_numpy(), column.offsets.to_numpy()
            found = [linked(values[lo:hi]) for lo, hi in zip(off[:-1], off[1:], strict=True)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])

    return lists.select("fps").mapInArrow(run, "a long, b long")


def links(spark: SparkSession, unique: DataFrame, small: int = SMALL) -> DataFrame:
    """a, b, a < b: pairs of fingerprints (column fp, each once) within RADIUS bits, or reached by such, whose components are those of all pairs within them."""
    entries = _entries(unique)
    keys = entries.groupBy("z").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    keys = stage_out(spark, keys.withColumnRenamed("z", "_z"), "keys")
    two = keys.where((F.col("n") == 2) & (F.lit(small) >= 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    more = keys.where(F.col("n") > min(small, 2)).select("_z", "n")
    rows = more.count()
    side = F.broadcast(more) if rows <= BROADCAST_ROWS else more.hint("merge")
    members = entries.join(side, F.col("z") == F.col("_z"))
    members = stage_out(spark, members.select("z", "n", "fp"), "members")
    lists = members.where(F.col("n") <= small).groupBy("z").agg(F.collect_list("fp").alias("fps"))
    found = two.unionByName(_compared(lists))
    dense = stage_out(spark, members.where(F.col("n") > small).select("fp").distinct(), "dense")
    if not dense.isEmpty():
        points = dense.select("fp", F.explode(F.transform(_literals(ball(64, RADIUS // 2)), lambda m: F.col("fp").bitwiseXOR(m))).alias("point"))
        least = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).where("a < most").select(F.col("point").alias("_point"), "a")
        # Spark takes points for no larger than what they are made from and would broadcast them
        found = found.unionByName(points.join(least.hint("merge"), F.col("point") == F.col("_point")).where("a < fp").select("a", F.col("fp").alias("b")))
    return found.distinct()


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a < b) with the same components, of which a family has a few a member: what b is linked to is linked to the least of it instead."""
    near = edges.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("x"))
    return near.select(F.col("m").alias("a"), F.explode(F.concat("x", F.array("b"))).alias("b")).where("a < b").distinct()


def similar_documents(spark: SparkSession, docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of each row."""
    with arrow_rows(spark, 1000):
        every = stage_out(spark, fingerprints(docs), "fingerprints")
    unique = stage_out(spark, every.groupBy("fp").agg(F.min("doc_id").alias("first")), "unique")
    joined = components(spark, stage_out(spark, contracted(contracted(links(spark, unique.select("fp"), small))), "links"))
    rows = unique.count()
    placed = unique.join(not_broadcast(joined.withColumnRenamed("id", "fp"), rows), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    placed = stage_out(spark, placed, "placed")
    names = placed.groupBy("label").agg(F.min("first").alias("component_id"))
    named = not_broadcast(placed.join(not_broadcast(names, rows), "label").select("fp", "component_id"), rows)
    drop_stage(spark, unique)
    return every.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
