"""How filters interact: what each would remove at each place of each order, and by how much others make it redundant.

One scan gives every document the mask of the filters that it fails.  Everything else is a function of how many
documents of a part (a language) have each of the 32 masks, how many of those are good and how many toxic:

1. masks are counted by part;
2. a subset-zeta transform turns the counts into the survivors of every set of filters: with sub(X) the sum of the
   counts of all masks within X, a set T of filters leaves sub(all but T);
3. a step of an order is the difference of two neighbouring sets, before and after its filter; so are the good and
   the toxic documents that it loses, and its share (Shapley's, unscaled) is the sum of its differences over all orders.

Words are maximal runs of other characters than ASCII white space.  A document fails

    A  with fewer than 100 words
    B  if fewer than 80 % of its words are distinct (case counts)
    C  if more than 10 % of its code points are A-Z
    D  with any of # $ % & * |
    E  if a document of a smaller doc_id has the same text, whatever its part

Texts are the same if their SHA-256 is.  Copies are counted by text and part before they meet, so a text that a third
of all documents have costs each task a row a part.

Null texts are empty, a null language is the part ''.  Null ids come after all others and are equal to each other; rows
that repeat an id and its text don't make each other fail E.  A document's labels are those of its doc_id: 1 if any row of
labels says so.  Other columns are left aside, an empty table has no parts and so no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import stage_out

FILTERS = "ABCDE"
# fixed values: the filters' bounds
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
OUT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def _mask(fails: dict[str, Column]) -> Column:
    bits = [F.when(c, 1 << FILTERS.index(name)).otherwise(0) for name, c in fails.items()]
    return sum(bits[1:], bits[0])


def failures(docs: DataFrame) -> DataFrame:
    """id, part, digest of the text, and the mask of A to D, of each row of docs."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), ""))
    rows = rows.withColumns({"n": F.size("words"), "distinct": F.size(F.array_distinct("words"))})
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    fails = {
        "A": F.col("n") < MIN_WORDS,
        "B": F.col("distinct").cast("long") * 100 < F.col("n").cast("long") * DISTINCT_PERCENT,
        "C": upper.cast("long") * 100 > F.length("text").cast("long") * UPPER_PERCENT,
        "D": F.col("text").rlike(SYMBOLS),
    }
    return rows.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), _mask(fails).cast("int").alias("mask"))


def mask_counts(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (all five filters), and how many documents have it: n, good, toxic. At most 32 rows a part."""
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).cast("int")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = stage_out(spark, failures(docs), "failures").join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # rows that repeat an id and its text are one place of the order of ids
    kind = ("digest", "part", "mask", "good", "toxic")
    placed = rows.groupBy("id", *kind).agg(F.count(F.lit(1)).alias("n"))
    copies = placed.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("at_first"))
    # a text has one mask of A to D, so a digest is left with at most four rows a part
    earliest = F.min("first").over(Window.partitionBy("digest"))
    original = copies.withColumn("same", F.when(F.col("first") == earliest, F.col("at_first")).otherwise(0))
    last = 1 << FILTERS.index("E")
    both = F.array(F.struct(F.col("mask").alias("m"), F.col("same").alias("k")), F.struct((F.col("mask") + last).alias("m"), (F.col("n") - F.col("same")).alias("k")))
    each = original.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.k > 0")
    return each.groupBy("part", F.col("x.m").alias("mask")).agg(F.sum("x.k").alias("n"), F.sum(F.expr("x.k * good")).alias("good"), F.sum(F.expr("x.k * toxic")).alias("toxic"))


def subset_sums(counts: np.ndarray) -> np.ndarray:
    """The zeta transform over subsets: out[X] is the sum of counts[M] of all M within X. counts: 2^k rows."""
    out = counts.copy()
    bit = 1
    while bit < len(out):
        inside = np.flatnonzero(np.arange(len(out)) & bit)
        out[inside] += out[inside ^ bit]
        bit <<= 1
    return out


def survivors(counts: np.ndarray) -> np.ndarray:
    """out[T]: what is left by the set T of filters, of counts by mask."""
    return subset_sums(counts)[np.arange(len(counts))[::-1]]


def steps(counts: np.ndarray, filters: str = FILTERS) -> list[tuple]:
    """filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of all orders of the filters.

    counts: documents, good and toxic ones, by mask.
    """
    left = survivors(counts)
    every = len(counts) - 1
    share = dict.fromkeys(filters, 0)
    found = []
    for order in permutations(filters):
        before = 0
        for place, name in enumerate(order, 1):
            bit = 1 << filters.index(name)
            removed, good, toxic = (int(x) for x in left[before] - left[before | bit])
            share[name] += removed
            failing, alone = int(left[0, 0] - left[bit, 0]), int(left[every ^ bit, 0] - left[every, 0])
            found.append(("".join(order), place, int(left[before | bit, 0]), removed, failing - removed, alone, good, toxic, name))
            before |= bit
    return [(*x[:-1], share[x[-1]]) for x in found]


def filter_interactions(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step; see the module for the columns' meaning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in OUT.split(", ")]
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist(), strict=True):
                counts = np.zeros((1 << len(FILTERS), 3), np.int64)
                for x in masks:
                    counts[x["mask"]] += (x["n"], x["good"], x["toxic"])
                columns = list(zip(*steps(counts), strict=True))
                kinds = [pa.string(), pa.int32()] + [pa.int64()] * (len(names) - 3)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(columns[0])), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    counted = mask_counts(spark, docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return counted.mapInArrow(run, OUT)
