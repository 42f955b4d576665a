"""Line dedup by winnowing, in DataFrame functions only: repeated runs of lines go, wherever they begin and end within a line.

A run is a stretch of consecutive words of a document, MIN_WORDS of them or more.  A word is deleted if it lies in
a run that also occurs earlier, in the order of (doc_id, word): in an earlier document, or earlier in its own.  A
word goes with the white space before it, so a line that goes whole goes with its line break.  Lines are hashed word
by word, so that a run is found that begins or ends inside a line, or whose lines are broken elsewhere.

Every run of MIN_WORDS words or more is the union of its windows of MIN_WORDS words, so extending matches
both ways until they end is deleting the windows that match.

1. Winnowing: a window selects the leftmost least of its pairs of words by a quantised hash: one pair in 32 is of the first
   kind, one in 8 of the second, and so on (RATES), the others of the last; single words are too unequal in frequency.  The choice depends on the window's content
   alone, so equal windows select equal places, guaranteed.  The fingerprint is the hash of the GRAM words from there.
   Consecutive windows that select the same place are a stretch: about one place in fourteen stays.
2. Fingerprints are counted; those of two stretches or more go on.
3. Stretches are joined by a hash of all their words to the first position of each: later ones go whole.
4. Where a fingerprint has stretches that differ, a match ends inside them.  The first position of each is opened into
   windows, which are joined by their fingerprint and a hash of their words to the first position of each: later ones go.

No pairs of later positions are made: a passage in a third of all documents costs a few rows an occurrence.  All
steps are linear in a document's words.  Texts are shuffled twice, to the places that are opened and to the runs that
go, whatever their size: a broadcast would have to grow with the corpus.

A word is a run of characters other than Unicode white space; in scripts without blanks (Chinese, Japanese,
Thai, Lao, Khmer, Burmese) each character counts as one, so that runs of MIN_WORDS characters are found.
Null texts are returned as null without words, texts of fewer words than MIN_WORDS as they are.  Words are compared by 64-bit
hashes, windows and stretches by two hashes of those: what goes is deleted on these 128 bits alone.  Different rows that repeat an id are in the order of their texts' hashes, identical ones are at one place;
rows with a null id come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, pack, stage_out, unpack

MIN_WORDS = 50
#: Words of a fingerprint; one in so many pairs of words is of the first, second and third kind that windows select (powers of two).
GRAM, RATES = 10, (32, 8, 2)
# fixed values: white space of ASCII and of Unicode beyond it, and the blocks of scripts that are written without blanks
ASCII_SPACE = r"\x09-\x0d\x1c-\x20"
OTHER_SPACE = r"\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
DENSE = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u3007\u3021-\u3029\u3038-\u303b\u3041-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9d\x{20000}-\x{3ffff}"
SPACE = ASCII_SPACE + OTHER_SPACE
#: The characters of SPACE, to trim.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def _other() -> Column:
    """Whether the text has white space or scripts beyond ASCII's; most texts are told by the first, short pattern."""
    return F.col("text").rlike(r"[\x85\xa0\u0e00-\uffff]") & F.col("text").rlike(f"[{OTHER_SPACE}{DENSE}]")


def _hashes() -> Column:
    """A hash of each word."""
    parted = F.regexp_replace("text", f"(?<=[{DENSE}])|(?=[{DENSE}])", " ")
    words = F.when(_other(), F.split(F.btrim(parted, F.lit(BLANKS)), f"[{SPACE}]+", -1)).otherwise(F.split(F.btrim("text", F.lit(BLANKS)), f"[{ASCII_SPACE}]+", -1))
    return F.transform(words, lambda x: F.xxhash64(x))


def _pieces() -> Column:
    """Each word with the white space before it, and last what there is at the end."""
    ends = rf"(?<=[^{SPACE}])(?=[{SPACE}{DENSE}])|(?<=[{DENSE}])(?=[^{SPACE}])"
    return F.when(_other(), F.split("text", ends, -1)).otherwise(F.split("text", f"(?<=[^{ASCII_SPACE}])(?=[{ASCII_SPACE}])", -1))


def _let(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value made once however often make uses it: a lambda's argument, unlike a column, is never copied into its uses."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def _parted(h: Column, min_words: int) -> Column:
    """Structs (f, k, a, b) of a fingerprint, hash of all words, first and last window of each stretch of the hashed words h."""
    gram = min(GRAM, max(2, min_words // 2))
    reach = min_words - gram

    def least(lo: Column, hi: Column, rate: int) -> Column:
        pair = lambda i: F.get(h, i).bitwiseXOR(F.shiftright(F.get(h, i + 1), 7))
        between = F.filter(F.sequence(lo, hi), lambda i: pair(i).bitwiseAND(F.lit(rate - 1)) == 0)
        return F.concat(F.array(lo - 1), between, F.array(hi + 1))

    def selected(points: Column, last: Column) -> Column:
        """at (the place), a, b of windows up to `last` that select a point, and a, b, q of those that reach none.

        points: places in order, between the one before the first window and the one beyond the last.
        """
        pairs = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        chosen = F.transform(F.slice(points, F.lit(2), F.size(points) - 2), lambda q, i: F.struct(q.alias("at"), F.greatest(F.get(points, i) + 1, q - reach).alias("a"), F.least(q, last).alias("b")))
        missed = F.transform(pairs, lambda x: F.struct((x["p"] + 1).alias("a"), F.least(x["q"] - (reach + 1), last).alias("b"), x["q"].alias("q")))
        return F.struct(*(F.filter(x, lambda y: y["a"] <= y["b"]).alias(n) for x, n in ((chosen, "chosen"), (missed, "missed"))))

    def cover(lo: Column, hi: Column, last: Column, rates: tuple[int, ...]) -> Column:
        """at, a, b of the windows from lo to `last`, which select from lo to hi, by the kinds of word that are left."""
        if not rates:
            return F.transform(F.sequence(lo, last), lambda i: F.struct(i.alias("at"), i.alias("a"), i.alias("b")))
        both = lambda x: F.concat(x["chosen"], F.flatten(F.transform(x["missed"], lambda y: cover(y["a"], y["q"] - 1, y["b"], rates[1:]))))
        return _let(least(lo, hi, rates[0]), lambda points: _let(selected(points, last), both))

    part = lambda x, n: F.xxhash64(F.slice(h, x + 1, n))
    stretches = cover(F.lit(0), F.size(h) - gram, F.size(h) - min_words, RATES)
    return F.transform(stretches, lambda x: F.struct(part(x["at"], F.lit(gram)).alias("f"), part(x["a"], x["b"] - x["a"] + min_words).alias("k"), x["a"].alias("a"), x["b"].alias("b")))


def _stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, tie, f, k, a, b of every stretch."""
    s = _let(_hashes(), lambda h: F.when(F.size(h) >= min_words, _parted(h, min_words)))
    # the outer form, since for the other one Spark infers a filter that would make the stretches a second time
    return docs.select("doc", "tie", F.explode_outer(s).alias("x")).where("x is not null").select("doc", "tie", "x.f", "x.k", "x.a", "x.b")


def repeated_words(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, tie, runs: structs (a, b), in order, of the first and last word (0-based) of each run to delete; a written table.

    The tables staged on the way are deleted once nothing reads them any more.

    docs: doc (the order), tie (tells rows at one place apart), text.
    """
    found = stage_out(spark, _stretches(docs, min_words), "stretches")
    often = found.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("f").alias("_f"))
    going = stage_out(spark, found.join(often, F.col("f") == F.col("_f"), "left_semi"), "going")
    drop_stage(spark, found)
    place = F.struct("doc", "tie", "a")
    first = stage_out(spark, going.groupBy("f", "k").agg(F.min(place).alias("earliest"), F.max(place).alias("latest"), F.first(F.expr("b - a")).alias("more")), "first")
    again = first.where("earliest < latest").select(F.col("f").alias("_f"), F.col("k").alias("_k"), "earliest")
    whole = going.join(again, (F.col("f") == F.col("_f")) & (F.col("k") == F.col("_k"))).where(place > F.col("earliest")).select("doc", "tie", "a", "b")
    several = first.groupBy("f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("f").alias("_f"))
    opened = first.join(several, F.col("f") == F.col("_f"), "left_semi").select("earliest.doc", "earliest.tie", "earliest.a", (F.col("earliest.a") + F.col("more")).alias("b"), "f")
    opened = stage_out(spark, opened.groupBy("doc", "tie").agg(F.collect_set(F.struct("a", "b", "f")).alias("at")), "opened")
    words = docs.join(opened.hint("shuffle_hash"), ["doc", "tie"])
    places = F.flatten(F.transform("at", lambda x: F.transform(F.sequence(x["a"], x["b"]), lambda i: F.struct(i.alias("i"), x["f"].alias("f")))))
    # equal windows have equal fingerprints, which are a second hash of some of their words
    keyed = _let(_hashes(), lambda h: F.transform(places, lambda x: F.struct(x["i"].alias("i"), x["f"].alias("f"), F.xxhash64(F.slice(h, x["i"] + 1, min_words)).alias("k"))))
    windows = stage_out(spark, words.select("doc", "tie", F.explode_outer(keyed).alias("x")).where("x is not null").select("doc", "tie", "x.i", "x.f", "x.k"), "windows")
    place = F.struct("doc", "tie", "i")
    earliest = windows.groupBy("f", "k").agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where("earliest < latest").select(F.col("f").alias("_f"), F.col("k").alias("_k"), "earliest")
    later = windows.join(earliest, (F.col("f") == F.col("_f")) & (F.col("k") == F.col("_k"))).where(place > F.col("earliest"))
    ranges = whole.unionByName(later.select("doc", "tie", F.col("i").alias("a"), F.col("i").alias("b")))
    starts = ranges.groupBy("doc", "tie").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("p"))
    # windows that overlap or touch are one run
    heads = F.filter("p", lambda x, i: (i == 0) | (x["a"] - F.get("p", F.greatest(i - 1, F.lit(0)))["b"] > min_words))
    tails = F.filter("p", lambda x, i: F.coalesce(F.get("p", i + 1)["a"] - x["b"] > min_words, F.lit(True)))
    gone = stage_out(spark, starts.select("doc", "tie", F.zip_with(heads, tails, lambda x, y: F.struct(x["a"].alias("a"), (y["b"] + (min_words - 1)).alias("b"))).alias("runs")), "gone")
    for df in (going, first, opened, windows):
        drop_stage(spark, df)
    return gone


def line_dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of docs with text cleaned, and n_removed, the words that went (a column so named is replaced)."""
    docs = docs.drop("n_removed")
    last = (1 << 63) - 1
    doc, tie = F.coalesce(F.col("doc_id").cast("long"), F.lit(last)), F.xxhash64("text")
    keyed = pack(docs.withColumn("text", F.col("text").cast("string")), "doc_id", "text").withColumns({"doc": doc, "tie": tie})
    gone = repeated_words(spark, keyed.select("doc", "tie", "text"), min_words)
    out = keyed.join(gone.hint("shuffle_hash"), ["doc", "tie"], "left")
    out = out.select("doc_id", "rest", "text", "runs", F.when(F.col("runs").isNotNull(), _pieces()).alias("pieces"))
    # words between runs, then those after the last one and white space at the end
    before = lambda i: F.when(i > 0, F.get("runs", F.greatest(i - 1, F.lit(0)))["b"]).otherwise(-1)
    between = F.flatten(F.transform("runs", lambda x, i: F.slice("pieces", before(i) + 2, x["a"] - before(i) - 1)))
    after = F.slice("pieces", F.element_at("runs", -1)["b"] + 2, F.size("pieces"))
    kept = F.array_join(F.concat(between, after), "")
    cut = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"] + 1)
    found = out.select("doc_id", "rest", F.when(F.col("runs").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(cut, F.lit(0)).cast("long").alias("n_removed"))
    return found.select(*unpack(docs, "doc_id", "text"), "n_removed")
