"""Exact dedup through minimal perfect hashes over the digests of earlier rows.

The history is a table of distinct digests with the row that won each.  It is dealt into buckets by
digest; each bucket gets a minimal perfect hash (hash and displace: keys are thrown into groups, and
each group, largest first, gets the smallest seed that puts its keys into free slots).  A slot holds the
whole digest and the winner's locator, so a lookup is one slot and one comparison of bytes: nonmembers land
in some slot too, and fail the comparison.

Within one table a half of the rows, by hash of id, makes the history, and the other half arrives:

1. Arriving rows look up.  Members raise their slot's winner and count, so a task gives back one row a slot
   however many copies it has seen; nonmembers are handed on and grouped separately.
2. Slots and groups together tell each text's winner and copies.  Those of two copies or more are a
   history again, in which every row looks up its winner; whatever isn't in it is single.

Against another corpus, the history is that corpus's digests, whose winners stay, and the nonmembers are
grouped among themselves.

Hot digests: rows that look up are dealt by bucket, and those of a bucket that counts more than HOT times what a
task should get by a salt too, each salt with its own copy of the bucket's index.  So no task gets many more than
HOT * ROWS_A_TASK rows whatever the copies; the table of salts has at most MAX_BUCKETS rows.

Null texts count as empty.  Of equal texts the largest doc_id stays; rows that repeat both id and text
share its verdict.  A null doc_id never wins against another; if all ids are null, keep_id is null and
the rows count as kept.  A history that repeats a digest is reduced to its largest winner.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_view, mix, small_or_shuffled, stage_out

#: Rows that look up in one task, and digests in one bucket's hash.
ROWS_A_TASK, KEYS_A_BUCKET = 100_000, 20_000
MAX_BUCKETS, HOT = 65_536, 4
GROUP = 4  # mean keys that share a seed


class MinimalPerfectHash:
    """Slots 0..n-1 for n distinct keys of 32 bytes."""

    def __init__(self, digests: np.ndarray) -> None:
        """digests: [n, 4] unsigned 64-bit words, none twice: two equal ones never part, whatever the seed."""
        n = self.n = len(digests)
        order = np.lexsort(digests.T[::-1])
        if (digests[order[1:]] == digests[order[:-1]]).all(1).any():
            raise ValueError("a digest is repeated")
        self.groups = max(1, -(-n // GROUP))
        self.seeds = np.zeros(self.groups, np.uint32)
        if n < 2:
            return
        group = self._group(digests)
        order = np.argsort(group, kind="stable")
        at = np.searchsorted(group[order], np.arange(self.groups + 1))
        size = np.diff(at)
        taken = np.zeros(n, bool)
        tries = np.arange(1, 65, dtype=np.uint64)
        for g in np.argsort(-size, kind="stable"):
            if size[g] < 2:
                break
            keys = digests[order[at[g] : at[g + 1]]]
            base = np.uint64(0)
            while True:
                slot = self._slot(keys[None, :, :], (base + tries)[:, None])  # one row a seed
                free = ~taken[slot].any(1)
                ranked = np.sort(slot[free], 1)
                good = np.flatnonzero(free)[(ranked[:, 1:] != ranked[:, :-1]).all(1)]
                if len(good):
                    self.seeds[g] = base + tries[good[0]]
                    taken[slot[good[0]]] = True
                    break
                base += np.uint64(64)
        # keys alone in their group take the slots left over: the high bit says that the seed is the slot
        single = np.flatnonzero(size == 1)
        self.seeds[single] = np.flatnonzero(~taken)[: len(single)].astype(np.uint32) | np.uint32(0x80000000)

    def _group(self, digests: np.ndarray) -> np.ndarray:
        return (digests[:, 1] % np.uint64(self.groups)).astype(np.int64)

    def _slot(self, digests: np.ndarray, seed: np.ndarray | np.uint64) -> np.ndarray:
        return (mix(digests[..., 2] + mix(digests[..., 3] ^ seed * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        if self.n < 2:
            return np.zeros(len(digests), np.int64)
        seed = self.seeds[self._group(digests)]
        direct = seed >> np.uint32(31) == 1
        return np.where(direct, seed & np.uint32(0x7FFFFFFF), self._slot(digests, seed.astype(np.uint64)))


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256))


def _words(digests: pa.ChunkedArray) -> np.ndarray:
    data, _ = byte_view(digests.combine_chunks())
    return data.view(">u8").reshape(-1, 4).astype(np.uint64)


def _bucket(n: int) -> Column:
    """By the digest's first four bytes."""
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def history_of(docs: DataFrame) -> DataFrame:
    """digest, winner, copies of each distinct text, pre-aggregated before the shuffle."""
    return _grouped(docs.select(digest().alias("digest"), F.col("doc_id").cast("long").alias("winner"), F.lit(1).cast("long").alias("copies")))


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("winner").alias("winner"), F.sum("copies").alias("copies"))


class _Slots:
    """A bucket's index: what each slot of its hash holds."""

    def __init__(self, known: pa.Table) -> None:
        self.n = known.num_rows
        if self.n:
            words = _words(known["digest"])
            order = np.lexsort(words.T[::-1])
            words = words[order]
            self.hash = MinimalPerfectHash(words)
            slot = self.hash.slots(words)
            self.digest, self.place = np.empty_like(words), np.empty(self.n, np.int64)
            self.digest[slot] = words
            self.place[slot] = order  # the row of `known` that a slot locates

    def find(self, digests: pa.ChunkedArray) -> np.ndarray:
        """The row of `known` with each digest, every byte of it compared; -1 for nonmembers."""
        if not self.n or not len(digests):
            return np.full(len(digests), -1)
        asked = _words(digests)
        at = self.hash.slots(asked)
        return np.where((self.digest[at] == asked).all(1), self.place[at], -1)


def _met(spark: SparkSession, rows: DataFrame, history: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """run(rows, history) of each bucket and salt. Both are read twice and should be written tables; no digest is twice in history."""
    n = int(min(MAX_BUCKETS, max(64, -(-history.count() // KEYS_A_BUCKET), -(-rows.count() // ROWS_A_TASK))))
    rows, history = rows.withColumn("bucket", _bucket(n)), history.withColumn("bucket", _bucket(n))
    # at most MAX_BUCKETS rows
    salts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT * ROWS_A_TASK)
    salts = F.broadcast(salts.select("bucket", F.ceil(F.col("n") / ROWS_A_TASK).cast("int").alias("fan")))
    fan = F.coalesce("fan", F.lit(1))
    rows = rows.join(salts, "bucket", "left").withColumn("salt", F.pmod(F.monotonically_increasing_id(), fan).cast("int")).drop("fan")
    history = history.join(salts, "bucket", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("fan")
    return rows.groupBy("bucket", "salt").cogroup(history.groupBy("bucket", "salt")).applyInArrow(run, schema)


def folded(spark: SparkSession, rows: DataFrame, history: DataFrame) -> DataFrame:
    """digest, winner, copies, member: of rows (doc_id, digest) in the history, their largest id and count by task; of others each row's."""

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        at = _Slots(known).find(mine["digest"])
        hit = np.flatnonzero(at >= 0)
        ids, named = mine["doc_id"].fill_null(0).to_numpy(), mine["doc_id"].is_valid().to_numpy()
        count = np.bincount(at[hit], minlength=known.num_rows)
        best, has = np.full(known.num_rows, np.iinfo(np.int64).min), np.zeros(known.num_rows, bool)
        some = hit[named[hit]]
        np.maximum.at(best, at[some], ids[some])
        has[at[some]] = True
        slots, rest = np.flatnonzero(count), np.flatnonzero(at < 0)
        seen = pa.table([known["digest"].take(pa.array(slots)), pa.array(best[slots], mask=~has[slots]), pa.array(count[slots]), pa.array(np.ones(len(slots), bool))], ["digest", "winner", "copies", "member"])
        new = pa.table([mine["digest"].take(pa.array(rest)), mine["doc_id"].take(pa.array(rest)), pa.array(np.ones(len(rest), np.int64)), pa.array(np.zeros(len(rest), bool))], ["digest", "winner", "copies", "member"])
        return pa.concat_tables([seen, new])

    return _met(spark, rows, history.select("digest"), run, "digest binary, winner long, copies long, member boolean")


def lookup(spark: SparkSession, rows: DataFrame, history: DataFrame) -> DataFrame:
    """rows (doc_id, digest) with winner, copies, old of the history, null for digests that aren't in it."""

    def run(mine: pa.Table, known: pa.Table) -> pa.Table:
        at = pa.array(_Slots(known).find(mine["digest"]))
        at = pc.if_else(pc.less(at, 0), None, at)
        return pa.table([mine["doc_id"], mine["digest"], *(known[c].take(at) for c in ("winner", "copies", "old"))], ["doc_id", "digest", "winner", "copies", "old"])

    return _met(spark, rows, history.select("digest", "winner", "copies", "old"), run, "doc_id long, digest binary, winner long, copies long, old boolean")


def exact_dedup(spark: SparkSession, docs: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row.

    history: digest, winner, copies of another corpus (see history_of), whose winners stay whatever their
    ids; without it a half of the table's own rows is the history of the other half.
    """
    rows = stage_out(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest")), "digests")
    early = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    one = rows.select("digest", F.col("doc_id").alias("winner"), F.lit(1).cast("long").alias("copies"))
    known = stage_out(spark, _grouped(one.where(F.pmod(F.xxhash64("winner"), F.lit(2)) == 0) if history is None else history.select("digest", "winner", "copies")), "history")
    arrived = stage_out(spark, folded(spark, rows.where(~early) if history is None else rows, known), "arrived")
    new = _grouped(arrived.where("not member"))
    if history is None:
        old = _grouped(known.unionByName(arrived.where("member").drop("member")))
        index = old.unionByName(new).withColumn("old", F.lit(False))
    else:
        index = known.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    found = lookup(spark, rows, stage_out(spark, index.where("copies > 1 or old"), "index"))
    keep = F.when(F.col("copies").isNull(), F.col("doc_id")).otherwise(F.col("winner"))
    kept = ~F.coalesce("old", F.lit(False)) & F.col("doc_id").eqNullSafe(keep)
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def stay(spark: SparkSession, docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """Rows of docs but those that verdict drops, and of the identical rows that it names once one row.

    verdict: a written table of _id, _digest, once (false: dropped), no pair twice; ids are compared null-safe.
    """
    n, m = verdict.agg(F.count(F.lit(1)), F.count_if("once")).first()
    # 48 bytes a row, three times what the bound is for
    side = small_or_shuffled(verdict.select("_id", "_digest"), 3 * n)
    rest = docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["_id"]) & (digest() == side["_digest"]), "left_anti")
    if not m:
        return rest
    side = small_or_shuffled(verdict.where("once").select("_id", "_digest"), 3 * m)
    several = docs.join(side, docs["doc_id"].cast("long").eqNullSafe(side["_id"]) & (digest() == side["_digest"]), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = several.select(F.col("doc_id").alias("_id"), digest().alias("_digest"), row.alias("_row")).groupBy("_id", "_digest").agg(F.first("_row").alias("_row"))
    return rest.unionByName(one.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns]))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of docs that stay, one of each text, by id and text: the verdict on one text is no other's."""
    found = exact_dedup(spark, docs).groupBy(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_digest")).agg(F.first("kept").alias("once"), F.count(F.lit(1)).alias("n"))
    return stay(spark, docs, stage_out(spark, found.where("not once or n > 1").select("_id", "_digest", "once"), "verdict"))
