"""Sharding by bytes: Karmarkar-Karp differencing over indivisible groups of equal texts.

Each group is a partial partition that has its bytes in one shard and none in the others.  The two
partial partitions of largest spread are combined again and again, the fullest shards of one with the
emptiest of the other, until one is left; going back over the combinations gives each group its shard.
Tasks difference their own groups first, GROUPS_A_PART at a time, which leaves one vector of sums a part;
parts are differenced in tasks again until at most MAX_PARTS are left, and the driver ends it.

A group of a third of all rows stays whole (that is the contract of a group), but no task handles it
whole: its bytes come from a pre-aggregated sum, and rows find their shard by a join that Spark can split.
Places in a shard come from counts by shard and bucket, dealt by hash of the row, with at most MAX_BUCKETS buckets a shard.

Null texts have no bytes and group with empty ones; repeated rows each get a place of their own.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage_out

GROUPS_A_PART = 20_000
#: Parts that the driver differences at most, and parts of a task in the steps before.
MAX_PARTS, PARTS_A_TASK = 4096, 1000
ROWS_A_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 20_000, 64, 4096


def difference(parts: list[list[int]]) -> list[list[int]]:
    """Karmarkar-Karp: for each partial partition, the shard that each of its entries goes to.

    parts: sums by shard, all of one length.  Ties go by position, so the outcome is determined.
    """
    if not parts:
        return []
    k = len(parts[0])
    # a node's sums are kept in falling order; slots[node][j]: the own entry that is j-th
    sums: list[list[int]] = []
    slots: list[list[int]] = []
    for p in parts:
        order = sorted(range(k), key=lambda j: -p[j])
        sums.append([p[j] for j in order])
        slots.append(order)
    heap = [(s[-1] - s[0], i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges: list[tuple[int, int, list[int]]] = []  # children, order of the combined entries
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = [x + y for x, y in zip(sums[a], reversed(sums[b]), strict=True)]
        order = sorted(range(k), key=total.__getitem__, reverse=True)
        merges.append((a, b, order))
        sums[a] = sums[b] = []
        sums.append([total[j] for j in order])
        heapq.heappush(heap, (sums[-1][-1] - sums[-1][0], len(sums) - 1))
    # back over the combinations: shard of each node's j-th entry
    shard: dict[int, list[int]] = {len(sums) - 1: list(range(k))}
    for node in range(len(sums) - 1, len(parts) - 1, -1):
        a, b, order = merges[node - len(parts)]
        own = shard.pop(node)
        of_total = [0] * k
        for j, e in enumerate(order):
            of_total[e] = own[j]
        shard[a], shard[b] = of_total, of_total[::-1]
    out = []
    for i in range(len(parts)):
        entry = [0] * k
        for j, e in enumerate(slots[i]):
            entry[e] = shard[i][j]
        out.append(entry)
    return out


def _combined(sums: DataFrame, groups: int, shards: int) -> DataFrame:
    """part, entry, bytes with up, up_entry: parts are dealt into groups, each differenced in one task."""

    def together(t: pa.Table) -> pa.Table:
        own: dict[int, list[int]] = {}
        for p, e, b in zip(t["part"].to_pylist(), t["entry"].to_pylist(), t["bytes"].to_pylist(), strict=True):
            own.setdefault(p, [0] * shards)[e] = b
        ids = sorted(own)
        rows = [(p, e, own[p][e], s) for p, entries in zip(ids, difference([own[p] for p in ids]), strict=True) for e, s in enumerate(entries)]
        up = t["up"][0].as_py()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
        return pa.table([pa.array(x, k) for x, k in zip(zip(*((p, e, b, up, s) for p, e, b, s in rows), strict=True), kinds, strict=True)], ["part", "entry", "bytes", "up", "up_entry"])

    dealt = sums.withColumn("up", F.pmod(F.xxhash64("part"), F.lit(groups)))
    return dealt.groupBy("up").applyInArrow(together, "part long, entry int, bytes long, up long, up_entry int")


def shard_by_bytes(spark: SparkSession, docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage_out(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "rows")
    # texts with equal hashes stay together; should different ones share a hash, they are one group
    groups = rows.groupBy("h").agg(F.sum("size").alias("bytes"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, nth = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            h, size = t.column("h").to_numpy(), t.column("bytes").to_numpy()
            order = np.lexsort((h, -size))
            h, size = h[order], size[order]
            entries = np.array([e[0] for e in difference([[x] + [0] * (shards - 1) for x in size.tolist()])], np.int32)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), (task << 32) + nth)), pa.array(h), pa.array(size), pa.array(entries)], ["part", "h", "bytes", "entry"])

        for batch in batches:
            for lo in range(0, batch.num_rows, GROUPS_A_PART):
                piece = batch.slice(lo, GROUPS_A_PART)
                if held and sum(b.num_rows for b in held) + piece.num_rows > GROUPS_A_PART:
                    yield flush()
                    held, nth = [], nth + 1
                held.append(piece)
        if held:
            yield flush()

    placed = stage_out(spark, groups.mapInArrow(own, "part long, h long, bytes long, entry int"), "parts")
    # parts are combined in tasks until the driver can take the rest: a row for each part and entry
    held = placed.select("h", "part", "entry")
    sums = placed.groupBy("part", "entry").agg(F.sum("bytes").alias("bytes"))
    while (parts := sums.select("part").distinct().count()) > MAX_PARTS:
        step = stage_out(spark, _combined(sums, -(-parts // PARTS_A_TASK), shards), "combined")
        held = held.join(step.select("part", "entry", "up", "up_entry"), ["part", "entry"]).select("h", F.col("up").alias("part"), F.col("up_entry").alias("entry"))
        sums = step.groupBy(F.col("up").alias("part"), F.col("up_entry").alias("entry")).agg(F.sum("bytes").alias("bytes"))
    last: dict[int, list[int]] = {}
    for r in sums.orderBy("part", "entry").collect():
        last.setdefault(r.part, [0] * shards)[r.entry] = r.bytes
    ids = sorted(last)
    final = difference([last[p] for p in ids])
    lookup = spark.createDataFrame([(p, e, s) for p, entries in zip(ids, final, strict=True) for e, s in enumerate(entries)], "part long, entry int, shard int")
    of_group = held.join(F.broadcast(lookup), ["part", "entry"]).select("h", "shard")
    n = rows.count()
    buckets = min(MAX_BUCKETS, max(MIN_BUCKETS, n // (shards * ROWS_A_BUCKET)))
    # rows that repeat id and text are dealt too
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(buckets)).cast("int")
    dealt = stage_out(spark, rows.join(of_group, "h").select("doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")), "dealt")
    # at most shards * MAX_BUCKETS rows
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return dealt.withColumn("place", place).join(F.broadcast(starts), ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("place") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
