"""How far each source of a language lies from the language's other sources, and by which terms.

Terms are runs of letters: A-Z lower-cased, a-z and all characters beyond ASCII.  A language keeps the V terms that at
least MIN_DOCS of its documents have.  A group (language, source), and the language itself, gives each kept term the share
p = 1 + floor(SCALE * (count + 1) / (N + V)), N its occurrences of kept terms.  A share p lies floor((p - q)^2 / q) from a share q.

1. First pass: distinct terms of each document are counted by language, in the tasks, then over all: exact document frequencies.
2. Second pass: an Aho-Corasick automaton of kept terms, each padded by delimiters on both sides, runs over every whole text,
   whose other characters are delimiters, and recounts occurrences by group.  It holds the head: the kept terms of highest
   frequency, HEAD_TERMS of them or HEAD_BYTES at most, whatever the corpus.  What it leaves of a text, mostly rare
   words, is dealt by the word's CRC to blocks; each block's kept terms make an automaton of their own, which runs over the block's
   words.  Blocks are cut by BLOCK_BYTES of distinct terms, and a block's words by WORDS_BYTES, so that their number grows and
   their size doesn't.  Groups and terms go by numbers from here on; terms are numbered in their order.
3. Postings: of each kept term the groups that have it, with their shares.  Absent terms all have a group's share of count 0.
4. Pairs of groups: were all terms absent from both, their sum is V times one value.  Terms of either group correct that, by the
   group's histogram of shares; terms of both correct it again, from the postings, summed by pair within tasks.  So work is in
   proportion to postings, not to vocabulary times pairs.
5. Ranks: of all other sources, and of the first TOP terms that the group has a larger share of than its language.

Arithmetic is exact: products of counts are decimals, and sums of 64-bit differences are taken modulo 2^64, whose results fit,
since shares sum to little more than SCALE, so that a sum of squares over q is below SCALE^2 by a factor of (1 + V / SCALE)^2.

Null text, language and source are ''.  Each row is a document, so rows that repeat an id count each.  A group without
terms has N = 0; a language without kept terms has V = 0, all distances 0 and no terms.  Other columns are left aside.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, byte_view, drop_stage, small_or_shuffled, stage_out

MIN_DOCS, TOP, SCALE = 3, 200, 10**9
#: Of the automaton that every task has, and of terms that go into it.
HEAD_TERMS, HEAD_BYTES, LONGEST = 100_000, 1_000_000, 64
#: Bytes of distinct terms of a block.
BLOCK_BYTES = 4_000_000
#: Bytes of words of a block that a task searches, and that a task holds before it hands them on.
WORDS_BYTES, WAITING = 8 << 20, 32 << 20
#: Bytes of text that are searched at once, terms and counts held before they are handed on, and pairs evaluated at once.
PIECE, HELD, CODES, PAIRS = 1 << 20, 300_000, 1 << 20, 1 << 20
#: Letters as they count, everything else a delimiter.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _texts(column: pa.Array) -> list[bytes]:
    """Texts with delimiters in place of all that isn't a term."""
    data, off = byte_view(column)
    raw = data.tobytes().translate(TABLE)
    return [raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term, n: in how many rows of the language each term is. docs: lang, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                if counter:
                    arrays = [pa.array([lang] * len(counter)), pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, ["lang", "term", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text")), strict=True):
                held.setdefault(lang, Counter()).update(set(text.split()))
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    found = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    return found.groupBy("lang", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"))


def automaton(terms: list[bytes]):  # noqa: ANN201
    """Of the terms, padded by delimiters, each with its place in the list; None without terms. Bytes stand for characters."""
    import ahocorasick

    if not terms:
        return None
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term.decode('latin-1')} ", i)
    found.make_automaton()
    return found


def search(found, text: bytes) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """Pieces of text, which begins and ends with a delimiter: where each begins, the piece, and of each match the place of the
    delimiter after it, in the piece, and the term's number. Pieces share the delimiter that they are cut at."""
    at = 0
    while at < len(text) - 1:
        end = text.find(b" ", min(at + PIECE, len(text) - 1))
        piece = text[at : end + 1]
        flat = np.fromiter(chain.from_iterable(found.iter(piece.decode("latin-1"))), np.int64) if found else np.zeros(0, np.int64)
        yield at, piece, flat[0::2], flat[1::2]
        at = end


def left_over(piece: bytes, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Words of a piece that no match ends with, and where they begin."""
    blank = np.frombuffer(piece, np.uint8) == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    stops = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    matched = np.zeros(len(piece), bool)
    matched[ends] = True
    rest = ~matched[stops]
    starts, stops = starts[rest], stops[rest]
    return [piece[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], starts


class Tally:
    """Counts of (group, term) numbers, folded as they come."""

    def __init__(self, terms: int) -> None:
        self.terms, self.codes, self.counts, self.new, self.waiting = max(terms, 1), np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        self.known: dict[int, int] = {}

    def add(self, groups: np.ndarray, terms: np.ndarray) -> None:
        self.new.append(groups * self.terms + terms)
        self.waiting += len(terms)
        if self.waiting > 1 << 21:
            self.fold()

    def full(self) -> bool:
        return len(self.codes) > CODES

    def fold(self) -> None:
        codes = np.concatenate([self.codes, *self.new])
        counts = np.concatenate([self.counts, np.ones(self.waiting, np.int64)])
        self.codes, where = np.unique(codes, return_inverse=True)
        self.counts = np.zeros(len(self.codes), np.int64)
        np.add.at(self.counts, where, counts)
        self.new, self.waiting = [], 0

    def out(self, ids: np.ndarray) -> dict[str, pa.Array]:
        """Groups, terms by their ids, and counts; what was held is gone then."""
        self.fold()
        place = {"g": pa.array(self.groups(self.codes // self.terms)), "t": pa.array(ids[self.codes % self.terms]), "n": pa.array(self.counts)}
        self.codes = self.counts = np.zeros(0, np.int64)
        return place

    def numbers(self, groups: np.ndarray) -> np.ndarray:
        """Small numbers for groups' ids."""
        found, where = np.unique(groups, return_inverse=True)
        return np.array([self.known.setdefault(g, len(self.known)) for g in found.tolist()], np.int64)[where]

    def groups(self, numbers: np.ndarray) -> np.ndarray:
        return np.array(list(self.known) or [0], np.int64)[numbers]


_COUNTED = "g long, t long, n long, block int, words binary"


def _counted(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch of _COUNTED, columns that aren't given null."""
    kinds = {"g": pa.int64(), "t": pa.int64(), "n": pa.int64(), "block": pa.int32(), "words": pa.binary()}
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(len(columns["g"]), k)) for c, k in kinds.items()], list(kinds))


def _head_counts(spark: SparkSession, docs: DataFrame, ids: np.ndarray, head: list[bytes], blocks: int) -> DataFrame:
    """Rows of counts of the head's terms (t of ids), and rows of the words that it leaves, by block. docs: g, text."""
    shared = spark.sparkContext.broadcast({"ids": ids, "terms": head})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        held = shared.value
        # a worker keeps a broadcast's value from task to task, and so the automaton
        found = held["found"] if "found" in held else held.setdefault("found", automaton(held["terms"]))
        ids, tally = held["ids"], Tally(len(held["terms"]))
        rest: dict[tuple[int, int], list[bytes]] = {}
        size = 0

        def spilt() -> Iterator[pa.RecordBatch]:
            if rest:
                columns = {"g": pa.array([g for g, _ in rest], pa.int64()), "block": pa.array([b for _, b in rest], pa.int32())}
                yield _counted(columns | {"words": pa.array([b" ".join(x) for x in rest.values()], pa.binary())})
                rest.clear()

        for batch in batches:
            texts = _texts(batch.column("text"))
            own = batch.column("g").to_numpy()
            numbered = tally.numbers(own)
            begins = np.cumsum([1, *(len(t) + 1 for t in texts[:-1])])
            for at, piece, ends, numbers in search(found, b" " + b" ".join(texts) + b" "):
                # a match belongs to the row that the letter before its last delimiter is in
                tally.add(numbered[np.searchsorted(begins, at + ends - 1, "right") - 1], numbers)
                if blocks:
                    words, starts = left_over(piece, ends)
                    for g, w in zip(own[np.searchsorted(begins, at + starts, "right") - 1].tolist(), words, strict=True):
                        rest.setdefault((g, crc32(w) % blocks), []).append(w)
                    size += sum(map(len, words)) + 60 * len(words)
                    if size > WAITING:
                        yield from spilt()
                        size = 0
            if tally.full():
                yield _counted(tally.out(ids))
        yield from spilt()
        yield _counted(tally.out(ids))

    return docs.select("g", "text").mapInArrow(run, _COUNTED)


def _block_counts(rest: DataFrame, tail: DataFrame, blocks: int) -> DataFrame:
    """Counts of the tail's terms (block, t, term) in the words that were left (block, g, words).

    A block whose words are many is searched by several tasks, each with all the block's terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, terms, found, tally = None, [], [], None, Tally(0)
        for batch in batches:
            for b, salt, t, term, g, words in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "t", "term", "g", "words")), strict=True):
                if (b, salt) != block:
                    if found:
                        yield _counted(tally.out(np.array(ids)))
                    block, ids, terms, found = (b, salt), [], [], None
                if term is not None:
                    ids.append(t)
                    terms.append(term)
                    continue
                if terms and found is None:
                    found, tally = automaton(terms), Tally(len(terms))
                for _, _, ends, numbers in search(found, b" " + words + b" "):
                    tally.add(tally.numbers(np.full(len(ends), g)), numbers)
                if found and tally.full():
                    yield _counted(tally.out(np.array(ids)))
        if found:
            yield _counted(tally.out(np.array(ids)))

    size = rest.agg(F.sum(F.octet_length("words").cast("long"))).first()[0] or 0
    salts = max(1, -(-size // (blocks * WORDS_BYTES)))
    none = F.lit(None)
    terms = tail.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "t", "term", none.cast("long").alias("g"), none.cast("binary").alias("words"))
    rows = terms.unionByName(rest.select("block", (F.monotonically_increasing_id() % salts).alias("salt"), none.cast("long").alias("t"), none.cast("binary").alias("term"), "g", "words"))
    # a block's terms come before its words
    dealt = rows.repartition(blocks * salts, "block", "salt").sortWithinPartitions("block", "salt", F.col("term").isNull())
    return dealt.mapInArrow(run, _COUNTED)


def _head_from(kept: DataFrame, others: int) -> tuple[int, int]:
    """The least frequency of the head's terms, and the number of blocks for all others; from a histogram by quarter octaves.

    others: bytes of terms that aren't kept.
    """
    level = F.floor(F.log2("n") * 4)
    size = F.octet_length("term").cast("long")
    bins = kept.groupBy(level.alias("level"), (size <= LONGEST).alias("fits")).agg(F.count(F.lit(1)).alias("terms"), F.sum(size).alias("bytes"), F.min("n").alias("least")).collect()
    terms = held = 0
    least = 1 << 62
    for x in sorted((x for x in bins if x.fits), key=lambda x: -x.level):
        if terms + x.terms > HEAD_TERMS or held + x.bytes > HEAD_BYTES:
            break
        terms, held, least = terms + x.terms, held + x.bytes, x.least
    left = sum(x.bytes for x in bins) - held
    return least, -(-(left + others) // BLOCK_BYTES) if left else 0


def occurrences(spark: SparkSession, docs: DataFrame, kept: DataFrame, others: int) -> DataFrame:
    """g, t, n of every kept term in every group, and of terms that another language keeps. docs: g, text; kept: t, term, n."""
    least, blocks = _head_from(kept, others)
    in_head = (F.col("n") >= least) & (F.octet_length("term") <= LONGEST)
    # at most HEAD_TERMS of HEAD_BYTES in all
    head = kept.where(in_head).select("t", F.col("term").cast("binary")).distinct().collect()
    with arrow_rows(spark, 500):
        first = stage_out(spark, _head_counts(spark, docs, np.array([r[0] for r in head], np.int64), [bytes(r[1]) for r in head], blocks), "head")
    counts = first.where("block is null")
    if blocks:
        # a term that is in the head for one language is in no words that were left
        tail = kept.where(~in_head).select("t", F.col("term").cast("binary").alias("term")).distinct()
        tail = tail.select((F.crc32("term") % blocks).cast("int").alias("block"), "t", "term")
        with arrow_rows(spark, 500):
            counts = counts.unionByName(stage_out(spark, _block_counts(first.where("block is not null"), tail, blocks), "tail"))
    return counts.groupBy("g", "t").agg(F.sum("n").alias("n"))


def _numbered(groups: DataFrame) -> tuple[Column, Column]:
    """64-bit ids of languages and of groups; by the first seed that gives each its own."""
    for seed in range(100):
        lang, group = F.xxhash64(F.lit(seed), "lang"), F.xxhash64(F.lit(seed), "lang", "source")
        met = groups.agg(F.countDistinct("lang"), F.countDistinct(lang), F.count(F.lit(1)), F.countDistinct(group)).first()
        if met[0] == met[1] and met[2] == met[3]:
            return lang, group
    raise ValueError("no seed parts the groups")


def _share(count: Column) -> Column:
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(F.col("total") + F.col("v")))


def _far(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(postings: DataFrame) -> DataFrame:
    """l, i, j, value: what terms of both groups i and j change in their distance, summed by pair in the tasks. postings: l, at (structs i, p, z)."""

    def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, (codes, sums) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), lang)), pa.array(codes >> 32), pa.array(codes & 0xFFFFFFFF), pa.array(sums)], ["l", "i", "j", "value"])
            held.clear()

        for batch in batches:
            langs = batch.column("l").dictionary_encode()
            lists = batch.column("at")
            off = lists.offsets.to_numpy()
            i, p, z = (lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("i", "p", "z"))
            sizes = np.diff(off)
            term = np.repeat(np.arange(len(sizes)), sizes)
            # each entry meets all entries of its term
            entries = np.arange(off[0], off[-1])
            meets = np.cumsum(sizes[term])
            lang_of = langs.indices.to_numpy()
            for number, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(lang_of[term] == number)
                while len(own):
                    done = meets[own[0] - 1] if own[0] else 0
                    take = max(1, int(np.searchsorted(meets[own] - done, PAIRS, "right")))
                    part, own = own[:take], own[take:]
                    n = sizes[term[part]]
                    left = np.repeat(entries[part], n)
                    right = np.repeat(off[:-1][term[part]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    left, right = left[left != right], right[left != right]
                    value = far(p[left], p[right]) - far(p[left], z[right]) - far(z[left], p[right]) + far(z[left], z[right])
                    before = held.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    codes, where = np.unique(np.concatenate([before[0], i[left] << 32 | i[right]]), return_inverse=True)
                    sums = np.zeros(len(codes), np.int64)
                    np.add.at(sums, where, np.concatenate([before[1], value]))
                    held[lang] = codes, sums
                    if len(codes) > CODES:
                        yield from out()
        yield from out()

    return postings.mapInArrow(run, "l long, i long, j long, value long")


def source_divergence(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank."""
    docs = _rows(docs)
    groups = stage_out(spark, docs.select("lang", "source").distinct(), "groups")
    lang_id, group_id = _numbered(groups)
    with arrow_rows(spark, 500):
        frequencies = stage_out(spark, document_frequencies(docs), "frequencies")
    kept = frequencies.where(F.col("n") >= MIN_DOCS)
    others = frequencies.where(F.col("n") < MIN_DOCS).agg(F.sum(F.octet_length("term").cast("long"))).first()[0] or 0
    # terms are numbered in their order, so that all that follows orders numbers
    numbers = stage_out(spark, kept.select("term").distinct().orderBy("term").withColumn("t", F.monotonically_increasing_id()), "numbers")
    kept = stage_out(spark, kept.join(numbers, "term").select(lang_id.alias("l"), "t", "term", "n"), "kept")
    drop_stage(spark, frequencies)
    found = occurrences(spark, docs.select(group_id.alias("g"), "text"), kept, others)

    n_groups = groups.count()
    numbered = groups.select("lang", "source", lang_id.alias("l"), group_id.alias("g"))
    found = found.join(small_or_shuffled(numbered.select("g", "l"), n_groups), "g")
    # a term that the automaton found in another language than those that keep it goes here
    found = stage_out(spark, found.join(kept.select("l", "t"), ["l", "t"], "left_semi"), "found")

    vocabulary = kept.groupBy("l").agg(F.count(F.lit(1)).alias("v"))
    groups = numbered.join(found.groupBy("g").agg(F.sum("n").alias("total")), "g", "left").join(vocabulary, "l", "left")
    place = F.row_number().over(Window.partitionBy("l").orderBy("source")).cast("long")
    groups = groups.select("l", "g", "lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v")], place.alias("i"))
    # z: the share of a term that isn't there
    groups = stage_out(spark, groups.withColumn("z", F.when(F.col("v") > 0, _share(F.lit(0)))), "shares")
    langs = groups.groupBy("l").agg(F.sum("total").alias("total"), F.first("v").alias("v"))

    entries = found.join(small_or_shuffled(groups.select("g", "i", "z", "total", "v"), n_groups), "g").select("l", "t", "n", "i", "z", _share(F.col("n")).alias("p"))
    postings = entries.groupBy("l", "t").agg(F.sum("n").alias("n"), F.collect_list(F.struct("i", "p", "z")).alias("at"))
    postings = stage_out(spark, postings, "postings")
    drop_stage(spark, found)

    # terms: what a group has a larger share of than its language
    shares = postings.join(small_or_shuffled(langs, n_groups), "l").select("l", "t", _share(F.col("n")).alias("q"), "at")
    above = shares.select("l", "t", "q", F.explode(F.filter("at", lambda x: x["p"] > F.col("q"))).alias("x"))
    above = above.select("l", F.col("x.i").alias("i"), "t", _far(F.col("x.p"), F.col("q")).alias("value"))
    first = Window.partitionBy("l", "i").orderBy(F.desc("value"), "t")
    terms = above.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TOP).join(numbers.withColumnRenamed("term", "item"), "t")
    terms = terms.join(small_or_shuffled(groups.select("l", "i", "lang", "source"), n_groups), ["l", "i"]).withColumn("part", F.lit("term"))

    # pairs: all terms absent from both, corrected by those of either group, then by those of both
    other = groups.select("l", F.col("source").alias("item"), F.col("i").alias("j"), F.col("z").alias("y"))
    pairs = groups.join(small_or_shuffled(other, n_groups), "l").where("i <> j")
    base = pairs.select("l", "i", "j", "lang", "source", "item", F.coalesce(F.col("v") * _far(F.col("z"), F.col("y")), F.lit(0)).alias("value"))
    same = postings.select("l", F.explode("at").alias("x")).groupBy("l", "x.i", "x.p", "x.z").agg(F.count(F.lit(1)).alias("k"))
    met = stage_out(spark, same, "same").join(small_or_shuffled(other, n_groups), "l").where("i <> j")
    absent = _far(F.col("z"), F.col("y"))
    forth = met.groupBy("l", "i", "j").agg(F.sum((F.col("k") * (_far(F.col("p"), F.col("y")) - absent)).cast("decimal(38,0)")).alias("value"))
    absent = _far(F.col("y"), F.col("z"))
    back = met.groupBy("l", F.col("j").alias("i"), F.col("i").alias("j")).agg(F.sum((F.col("k") * (_far(F.col("y"), F.col("p")) - absent)).cast("decimal(38,0)")).alias("value"))
    changes = forth.unionByName(back).unionByName(_both(postings.select("l", "at")).withColumn("value", F.col("value").cast("decimal(38,0)")))
    changes = changes.groupBy("l", "i", "j").agg(F.sum("value").alias("change"))
    pairs = base.join(changes, ["l", "i", "j"], "left").withColumn("value", (F.col("value").cast("decimal(38,0)") + F.coalesce("change", F.lit(0))).cast("long"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumns({"rank": F.row_number().over(order), "part": F.lit("pair")})
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(terms.select(*columns))
