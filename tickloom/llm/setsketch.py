"""Near-duplicate detection with SetSketch registers, banded, estimated by likelihood and verified.

A document is its set of distinct word shingles.  A register keeps, on an exponential scale and
truncated, the minimum of exponentially distributed hashes of the set: K = floor(1 - log_b(min)).
Registers of a union are the maxima of the registers, so sketches merge; equal registers are
likelier the more alike two sets are.

Shingles are compared by 64-bit hashes and whole sets by 128-bit digests of those, never by their words.

1. Every document is scanned once: set size, 128-bit digest of the set, registers.
2. Equal sets are one class, represented by its smallest doc_id.
3. Classes that agree in a band of BAND registers share a bucket.
4. In a bucket of at most SMALL classes every pair is a candidate whose sizes allow the similarity.
5. A larger bucket is banded again, finer, by what its sets don't have in common (below).
6. The joint likelihood of two sketches estimates a candidate's similarity; those far below the
   threshold are left, the others are verified on the full sets of 64-bit shingle hashes.
7. Verified links join components.

Large buckets.  Thousands of copies of one text share its shingles, so finer keys from those would part
nobody.  A bucket's core is what most of some LEADERS of its classes have, and a class's difference D is
what it has besides the core or lacks of it.  With sizes n and threshold percent, a pair is linked exactly if
(100 + percent) |Dx ^ Dy| <= (100 - percent) (nx + ny).  With the slack s = (100 - percent) n - (100 + percent) |D|:

* If sx + sy >= 0 the pair is linked whatever the differences are.  The class of most slack is so linked
  with every class of s >= -(most slack): proven on full sets, one link a class.
* All other pairs need at least t = -(sx + sy) / (2 (100 + percent)) > 0 elements of their differences in common.
  Of two sets that share t elements, the first |D| - t + 1 of each, in any order common to both, share one.
  Elements beyond the core come first, since they are rare, and a class meets, by each of its first elements,
  the classes of no more slack than its own.  (bucket, element) is the finer key: of at most SMALL classes on
  either side pairs are candidates; a larger one is a bucket again, with a core of its own.

So a family costs rows in proportion to its members' differences and pairs that share rare ones, not all its
pairs, and no pair that shares a bucket is passed over.  Finer buckets of the same members are one.  The
core decides only how much work is left, never what is linked.  After LEVELS levels all pairs of a bucket that is still large
are candidates: that is exact, without a bound on their number, and no input is known to get there.

At the threshold of 0.8 a pair shares no band with probability (1 - 0.8^4)^24 = 3e-6; the estimate's
cut is MARGIN = 0.125 below the threshold, five standard deviations.

Skew: sets are collapsed by pre-aggregation; rows of large buckets are dealt by bucket and by a salt in
proportion to the bucket's counted rows.

Null and empty texts and texts without words have an empty set: they are linked with nothing.  Fewer
words than a shingle are one shingle.  Sets are linked whatever their rows' ids: a class has a key of its own,
and ids only name the components, so different texts that repeat an id are different documents.  A row with a
null id can't be named in a component: its component_id is null and it is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exactdedup
from .common import LOWER, WordHasher, arrow_rows, byte_view, chunks, drop_stage, mix, not_broadcast, small_or_shuffled, stage_out, window_hashes, word_spans

#: Registers of a sketch; the first BANDS * BAND of them are banded, all serve the estimate.
REGISTERS, BANDS, BAND = 256, 24, 4
BASE, RATE = 1.02, 20.0
LIMIT = 4094  # largest register
MARGIN = 0.125
#: Classes of a bucket whose pairs are all candidates, and the expected number of those that make a larger one's core.
SMALL, LEADERS = 16, 24
#: Levels of finer buckets, and rows of a bucket that are dealt to one salt.
LEVELS, ROWS_A_SALT = 6, 500

INSIDE = np.ones(256, bool)
INSIDE[[9, 10, 11, 12, 13, 32]] = False
MULTIPLIERS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int, hasher: WordHasher) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low = LOWER[data]
    starts, ends, first = word_spans(data, off, INSIDE)
    words = hasher(low, starts, ends)
    all_windows = window_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            h = np.sort(all_windows[a : b - size + 1])
            fresh = np.empty(len(h), bool)
            fresh[0] = True
            np.not_equal(h[1:], h[:-1], out=fresh[1:])
            out.append(h[fresh])
        elif b > a:
            out.append(window_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(minima: np.ndarray) -> np.ndarray:
    """Register values of minima of uniform 64-bit hashes."""
    share = np.clip((minima.astype(np.float64) + 1) / 2.0**64, 2.0**-64, 1 - 2.0**-53)
    e = -np.log1p(-share) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """[sets, REGISTERS]; an empty set's registers are 0."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        values = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        minima = np.empty((REGISTERS, len(full)), np.uint64)
        for j, m in enumerate(MULTIPLIERS):
            h = values * m
            h ^= h >> np.uint64(32)
            np.minimum.reduceat(h * np.uint64(0x9E3779B97F4A7C15), at, out=minima[j])
        out[full] = registers(minima.T)
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity of pairs of sketches with known set sizes, row by row.

    With u, v the sizes' shares, a register of a exceeds b's with probability p(u - vJ), is below it with
    p(v - uJ), where p(x) = -log_b(1 - x (b - 1) / b).  The log-likelihood is concave in J.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    total = np.maximum(size_a + size_b, 1).astype(np.float64)
    u, v = size_a / total, size_b / total
    top = np.minimum(u / np.maximum(v, 1e-12), v / np.maximum(u, 1e-12))

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def value(j: np.ndarray) -> np.ndarray:
        up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))

    lo, hi = np.zeros(len(a)), top.copy()
    for _ in range(30):
        x, y = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        left = value(x) > value(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def _scan(docs: DataFrame, size: int, texts: bool) -> DataFrame:
    """doc_id, digest (of the text, null unless asked for), n, k1, k2 (digest of the set), sketch, bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            for lo, hi, d, o in chunks(data, off):
                sets = shingle_sets(d, o, size, hasher)
                n = np.array([len(s) for s in sets], np.int64)
                k1, k2 = _digests(sets)
                k = sketches(sets)
                bands = band_keys(k)
                raw = pa.array([r.tobytes() for r in k], pa.binary())
                values = pa.ListArray.from_arrays(np.arange(0, bands.size + 1, BANDS, dtype=np.int32), pa.array(bands.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "digest")), pa.array(n), pa.array(k1), pa.array(k2), raw, values], ["doc_id", "digest", "n", "k1", "k2", "sketch", "bands"])

    digest = exactdedup.digest() if texts else F.lit(None).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), digest.alias("digest")).mapInArrow(run, "doc_id long, digest binary, n long, k1 long, k2 long, sketch binary, bands array<long>")


def band_keys(k: np.ndarray) -> np.ndarray:
    """[sets, bands] hashes of each band's registers and its number."""
    wide = k[:, : BANDS * BAND].astype(np.uint64).reshape(len(k), BANDS, BAND)
    h = np.arange(1, wide.shape[1] + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(BAND):
        h = mix(h + wide[:, :, j])
    return np.ascontiguousarray(h).view(np.int64)


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    k2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
    return k1, k2


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """key and its set as packed 64-bit integers, of the rows whose set has the digest k1, k2 that they come with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            for lo, hi, d, o in chunks(data, off):
                sets = shingle_sets(d, o, size, hasher)
                k1, k2 = _digests(sets)
                key, w1, w2 = (batch.column(c).slice(lo, hi - lo) for c in ("key", "k1", "k2"))
                own = pa.array((k1 == w1.to_numpy()) & (k2 == w2.to_numpy()))
                yield pa.RecordBatch.from_arrays([key, pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "set"]).filter(own)

    return docs.select("key", "k1", "k2", "text").mapInArrow(run, "key long, set binary")


def _packed(column: pa.Array, kind: str) -> list[np.ndarray]:
    data, off = byte_view(column)
    return [data[a:b].view(kind) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _estimated(pairs: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimated similarity is at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(byte_view(batch.column(c))[0].tobytes(), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
                j = similarity(a, b, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
                yield batch.select(["a", "b"]).filter(pa.array(j >= least))

    return pairs.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(_packed(batch.column("set_a"), np.uint64), _packed(batch.column("set_b"), np.uint64), strict=True):
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "a long, b long")


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id that each end of an edge reaches, by neighbours' minima and jumps.

    Each round takes the least label among neighbours, then the label's own label; labels only fall.  No side of a join
    is broadcast where there are many ids.
    """
    both = stage_out(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage_out(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
    rows = labels.count()
    while True:
        near = both.join(not_broadcast(labels.select(F.col("id").alias("b"), "label"), rows), "b").groupBy("a").agg(F.min("label").alias("m"))
        hooked = labels.join(not_broadcast(near.withColumnRenamed("a", "id"), rows), "id").select("id", F.least("label", "m").alias("hook"), F.col("label").alias("old"))
        # a label's members take the least hook of any member: trees hook onto each other as wholes
        best = hooked.groupBy(F.col("old").alias("_old")).agg(F.min("hook").alias("best"))
        moved = stage_out(spark, hooked.join(not_broadcast(best, rows), F.col("old") == F.col("_old")).select("id", F.least("hook", "best").alias("label"), "old"), "moved")
        jump = moved.select(F.col("id").alias("_id"), F.col("label").alias("_next"))
        new = stage_out(spark, moved.join(not_broadcast(jump, rows), moved["label"] == F.col("_id"), "left").select("id", F.least("label", F.coalesce("_next", "label")).alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _ratio(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes allow the similarity: the smaller is at least percent of the larger."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _fan(g: Column) -> Column:
    return F.ceil(g / ROWS_A_SALT).cast("int")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (band, id, g) with the salt that they are dealt by, besides their bucket."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), _fan(F.col("g"))).cast("int"))


def _beside(rows: DataFrame, side: DataFrame) -> DataFrame:
    """Dealt rows with the columns of side, which has a row a bucket and its g."""
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0), _fan(F.col("g")) - 1))).drop("g")
    return rows.join(copies, ["band", "salt"])


def _once(rows: DataFrame) -> DataFrame:
    """Rows of buckets (band, id, g), of buckets of the same members one."""
    who = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"who{k}") for k in (1, 2)]
    kept = rows.groupBy("band").agg(F.first("g").alias("g"), *who).groupBy("g", "who1", "who2").agg(F.min("band").alias("_b"))
    return rows.join(kept.select("_b"), F.col("band") == F.col("_b"), "left_semi")


def _lists(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's numbers; null is empty."""
    values, off = column.values.to_numpy(), column.offsets.to_numpy()
    for i, full in enumerate(column.is_valid().to_pylist()):
        yield values[off[i] : off[i + 1]] if full else values[:0]


def _elements(rows: DataFrame) -> DataFrame:
    """band and element of every element of the rows' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, s in zip(batch.column("band").to_pylist(), _packed(batch.column("set"), np.int64), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), band)), pa.array(s)], ["band", "element"])

    return rows.select("band", "set").mapInArrow(run, "band long, element long")


def _differences(rows: DataFrame, percent: int) -> DataFrame:
    """band, g, salt, id, n, s (slack) and d (the difference: what is beyond the core, then what it lacks, each in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, slack = [np.zeros(0, np.int64)], []
            for own, core in zip(_packed(batch.column("set"), np.int64), _lists(batch.column("core")), strict=True):
                parts.append(np.concatenate([np.setdiff1d(own, core, True), np.setdiff1d(core, own, True)]))
                slack.append((100 - percent) * len(own) - (100 + percent) * len(parts[-1]))
            ends = np.cumsum([len(p) for p in parts]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("band", "g", "salt", "id", "n")), pa.array(slack, pa.int64()), lists], ["band", "g", "salt", "id", "n", "s", "d"])

    return rows.select("band", "g", "salt", "id", "n", "set", "core").mapInArrow(run, "band long, g long, salt int, id long, n long, s long, d array<long>")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """a, b of every pair of a bucket whose sizes allow the similarity."""
    right = rows.select(F.col("band").alias("_band"), F.col("id").alias("_id"), F.col("n").alias("_n"))
    met = (F.col("band") == F.col("_band")) & (F.col("id") < F.col("_id")) & _ratio(F.col("n"), F.col("_n"), percent)
    return rows.join(right, met).select(F.col("id").alias("a"), F.col("_id").alias("b"))


def _finer(spark: SparkSession, rows: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proven links, candidates, and rows of finer buckets that are large, of large buckets' rows (band, id, n, g)."""
    unit = 2 * (100 + percent)
    sets = sets.withColumnRenamed("key", "id")
    chance = F.pmod(F.xxhash64("id", "band"), F.lit(1 << 30)) / float(1 << 30)
    leaders = stage_out(spark, rows.where(chance * F.col("g") < LEADERS).join(sets, "id").select("band", "set"), "leaders")
    often = _elements(leaders).groupBy("band", "element").agg(F.count(F.lit(1)).alias("times"))
    led = leaders.groupBy("band").agg(F.count(F.lit(1)).alias("led"))
    core = often.join(led, "band").where("2 * times > led").groupBy("band").agg(F.sort_array(F.collect_list("element")).alias("core"))
    # without a core, or by chance without a leader, a bucket's differences are its whole sets
    cores = stage_out(spark, rows.groupBy("band").agg(F.first("g").alias("g")).join(core, "band", "left"), "cores")
    with arrow_rows(spark, 500):
        differing = stage_out(spark, _differences(_beside(_dealt(rows.select("band", "id", "n", "g")).join(sets, "id"), cores), percent), "differences")
    best = differing.groupBy("band").agg(F.first("g").alias("g"), F.max(F.struct("s", (-F.col("id")).alias("o"))).alias("best"), F.min("s").alias("least"))
    best = stage_out(spark, best.select("band", "g", F.col("best.s").alias("most"), (-F.col("best.o")).alias("hub"), "least"), "best")
    placed = _beside(differing, best).withColumn("near", F.expr("s + most >= 0"))
    proven = placed.where("near and id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
    # the first elements by which a class meets those of no more slack that aren't linked to the same hub, and those by which it is met
    size = F.size("d").cast("long")
    meets = size + 1 + F.floor(F.when(F.col("near"), F.col("s") - F.col("most") - 1).otherwise(2 * F.col("s")) / unit)
    met = F.when(F.col("near"), 0).otherwise(F.least(size, size + 1 + F.floor((F.col("s") + F.col("most")) / unit)))
    # where all are linked to the hub nothing is left
    going = placed.where("least + most < 0").select("band", "id", "n", "s", size.alias("size"), meets.alias("meets"), met.alias("met"), "d")
    first = F.slice("d", F.lit(1), F.greatest(F.least(F.greatest("meets", "met"), "size"), F.lit(0)).cast("int"))
    each = going.select("band", "id", "n", "s", "size", "meets", "met", F.posexplode(first).alias("at", "element"))
    each = stage_out(spark, each.select(F.xxhash64("band", "element").alias("band"), "id", "n", "s", "size", F.expr("at < meets").alias("meets"), F.expr("at < met").alias("met")), "elements")
    kinds = each.groupBy("band").agg(F.count(F.lit(1)).alias("g"), F.count_if("meets").alias("l"), F.count_if("met").alias("r")).where("g > 1 and l > 0 and r > 0")
    kinds = stage_out(spark, kinds.select("band", "g", (F.least("l", "r") <= SMALL).alias("small")), "finer")
    # by buckets, of at most SMALL classes on a side, so that pairs are in proportion to rows
    few = each.join(kinds.where("small").select("band"), "band")
    right = few.where("met").select(*[F.col(c).alias(f"{c}_r") for c in ("band", "id", "n", "s", "size")])
    after = (F.col("s") > F.col("s_r")) | (F.col("s") == F.col("s_r")) & (F.col("id") < F.col("id_r"))
    enough = -(F.col("s") + F.col("s_r")) <= unit * F.least("size", "size_r")
    candidates = few.where("meets").join(right, (F.col("band") == F.col("band_r")) & after & enough & _ratio(F.col("n"), F.col("n_r"), percent)).select(F.least("id", "id_r").alias("a"), F.greatest("id", "id_r").alias("b"))
    many = each.select("band", "id", "n").join(kinds.where("not small").select("band", "g"), "band")
    return proven.distinct(), candidates.distinct(), _once(many)


def _candidates(spark: SparkSession, reps: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(pairs to estimate and verify, proven links) of classes that share a band."""
    banded = reps.select(F.col("key").alias("id"), "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    buckets = stage_out(spark, banded.join(shared, "band"), "buckets")
    pairs = [_pairs(buckets.where(F.col("g") <= SMALL).select("band", "id", "n"), percent).distinct()]
    proven = [buckets.where("false").select(F.col("id").alias("a"), F.col("id").alias("b"))]
    large = stage_out(spark, _once(buckets.where(F.col("g") > SMALL)), "large")
    sets = None
    for level in range(LEVELS + 1):
        if large.isEmpty():
            break
        if level == LEVELS:
            pairs.append(_pairs(large, percent).distinct())
            break
        sets = _with_sets(spark, large.select(F.col("id").alias("key")), classes, texts, shingle) if sets is None else sets
        links, found, large = _finer(spark, large, sets, percent)
        proven.append(stage_out(spark, links, "proven"))
        pairs.append(stage_out(spark, found, "candidates"))
        large = stage_out(spark, large, "large")
    return reduce(DataFrame.unionByName, pairs).distinct(), reduce(DataFrame.unionByName, proven)


def _with_sets(spark: SparkSession, keys: DataFrame, classes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """key and packed set of each key in keys, from one scan of texts."""
    ends = stage_out(spark, keys.distinct().join(classes.select("key", F.col("rep").alias("doc_id"), "k1", "k2"), "key"), "ends")
    # rows of ends are twice as wide as those that the bound is for
    wanted = texts.join(small_or_shuffled(ends, 2 * ends.count()), "doc_id")
    with arrow_rows(spark, 1000):
        # identical rows bring a set several times
        return stage_out(spark, _sets(wanted, shingle).groupBy("key").agg(F.first("set").alias("set")), "sets")


def _components(spark: SparkSession, docs: DataFrame, shingle: int, percent: int, digests: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, link (key of the component, null if none), digest of each row."""
    with arrow_rows(spark, 1000):
        sketched = stage_out(spark, _scan(docs, shingle, digests), "sketches")
    members = stage_out(spark, sketched.select("doc_id", "digest", "n", "k1", "k2"), "members")
    # equal sets are one class; sizes are in the key, so that no count is needed
    classes = members.where("doc_id is not null and n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"))
    # keys are written, so they stay the same whenever they are read
    classes = stage_out(spark, classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    own = classes.select(F.col("rep").alias("doc_id"), F.col("n").alias("_n"), F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "key")
    reps = sketched.where("doc_id is not null and n > 0").join(own, "doc_id").where("n = _n and k1 = _k1 and k2 = _k2")
    # one row a class even where rows repeat an id
    reps = stage_out(spark, reps.groupBy("key", "n").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "reps")
    drop_stage(spark, sketched)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    pairs, proven = _candidates(spark, reps, classes, texts, shingle, percent)
    side = reps.select("key", "n", "sketch")
    pairs = pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
    with arrow_rows(spark, 2000):
        likely = stage_out(spark, _estimated(pairs, percent / 100 - MARGIN), "likely")
    links = proven
    if not likely.isEmpty():
        sets = _with_sets(spark, likely.select(F.col("a").alias("key")).union(likely.select("b")), classes, texts, shingle)
        full = likely.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        with arrow_rows(spark, 200):
            links = links.unionByName(stage_out(spark, _verified(full, percent), "verified"))
        drop_stage(spark, sets)

    of_class = classes.select("n", "k1", "k2", "rep", "key")
    of_class = of_class.join(components(spark, links).withColumnRenamed("id", "key"), "key", "left").withColumn("link", F.coalesce("label", "key"))
    # a component is named by its smallest id
    names = of_class.where("label is not null").groupBy("link").agg(F.min("rep").alias("name"))
    of_class = of_class.join(names, "link", "left").select("n", "k1", "k2", "link", F.coalesce("name", "rep").alias("label"))
    out = members.join(of_class, ["n", "k1", "k2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("label")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "link", "digest")


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    return _components(spark, docs, shingle, percent).drop("link", "digest")


def keep_representatives(spark: SparkSession, docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs that stay, one of each component, by id and text; rows with a null id all stay."""
    found = _components(spark, docs, shingle, percent, True).where("doc_id is not null")
    found = found.groupBy("doc_id", "digest").agg(F.first("kept").alias("kept"), F.first("link").alias("link"), F.count(F.lit(1)).alias("n"))
    found = stage_out(spark, found, "found")
    # where texts that repeat an id are linked with each other, the one of the least digest stays
    several = found.where("kept and link is not null").groupBy("link").agg(F.min("digest").alias("_least"), F.max("digest").alias("_most")).where("_least <> _most").select(F.col("link").alias("_link"), "_least")
    found = found.join(several, F.col("link") == F.col("_link"), "left").withColumn("once", F.col("kept") & F.coalesce(F.col("digest") == F.col("_least"), F.lit(True)))
    verdict = found.where("not once or n > 1").select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "once")
    return exactdedup.stay(spark, docs, stage_out(spark, verdict, "verdict"))
