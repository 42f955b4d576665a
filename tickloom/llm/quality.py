"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing: every word has a sparse ternary index vector drawn from its hash; a word's context
vector is the sum of its neighbours' index vectors over the sample, weighted down by frequency, plus
its own.  Words unseen in the sample keep their index vector alone, through the hash.  A document is
the mean of its words' vectors and a few of the corpus's mean; a network of two layers, trained in numpy, gives a logit; a
temperature fitted on rows that the network didn't see calibrates it.  Excerpts of the training texts are
trained on too, by one law of length for both labels; what is scored is always whole.

Words are runs of letters (ASCII lower-cased, with a mark word for all-capital ones), runs of digits
(one word for all), and runs of punctuation; a word that equals the one before it adds a repeat mark.

Null and empty texts and those of white space alone have no words: they tell nothing, and get the sample's share of label 1.
Repeated rows and ids are scored each on their own; without labels of both classes every score is the
share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHasher, byte_view, chunks, held_out, joined, labelled_sample, mix

BUCKETS = 1 << 14
DIM = 24
NONZERO = 6
WINDOW = 2
HIDDEN = 24
#: Bound of the labelled sample: rows of class 0 and of class 1, bytes of a text.
PER_CLASS, MAX_BYTES = (1500, 1500), 9_000
STEPS, RATE, DECAY = 300, 0.02, 1e-4
#: Words of the corpus's mean that every text is pooled with, so that a word or two don't decide alone.
PRIOR = 2
#: Excerpts that a training text is trained on besides the whole.
EXCERPTS = 2
DIGIT, UPPER, REPEAT = 1, 2, 3

KIND = np.zeros(256, np.uint8)  # 0 white space, 1 letters, 2 digits, 3 punctuation
KIND[33:128] = 3
KIND[48:58] = 2
KIND[65:91] = KIND[97:123] = KIND[128:] = 1
CAPITAL = np.zeros(256, bool)
CAPITAL[65:91] = True
SMALL = np.zeros(256, bool)
SMALL[97:123] = True


def words(data: np.ndarray, off: np.ndarray, hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, offsets by row); marks follow the words that they belong to."""
    n = len(off) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    kind = KIND[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[off[:-1][off[:-1] < off[1:]]] = True
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(data))
    real = kind[begin] > 0
    begin, end = begin[real], end[real]
    k = kind[begin]
    bucket = (hasher(LOWER[data], begin, end) % np.uint64(BUCKETS - 4)).astype(np.int64) + 4
    bucket[k == 2] = DIGIT
    capitals = np.zeros(len(data) + 1, np.int64)
    np.cumsum(CAPITAL[data], out=capitals[1:])
    smalls = np.zeros(len(data) + 1, np.int64)
    np.cumsum(SMALL[data], out=smalls[1:])
    upper = (k == 1) & (capitals[end] - capitals[begin] >= 2) & (smalls[end] == smalls[begin])
    first = np.searchsorted(begin, off)
    again = np.zeros(len(begin), bool)
    again[1:] = (bucket[1:] == bucket[:-1]) & (k[1:] == 1)
    again[first[:-1][first[:-1] < first[1:]]] = False
    extra = upper.astype(np.int64) + again
    place = np.arange(len(begin)) + np.concatenate([np.zeros(1, np.int64), np.cumsum(extra)[:-1]]) if len(begin) else np.zeros(0, np.int64)
    out = np.empty(len(begin) + int(extra.sum()), np.int64)
    out[place] = bucket
    out[place[upper] + 1] = UPPER
    out[place[again] + 1 + upper[again]] = REPEAT
    shift = np.concatenate([np.zeros(1, np.int64), np.cumsum(extra)])
    return out, first + shift[first]


def index_vectors() -> np.ndarray:
    """Ternary vectors with NONZERO entries, each drawn from its bucket's hash."""
    out = np.zeros((BUCKETS, DIM), np.float32)
    ids = np.arange(BUCKETS, dtype=np.uint64)
    for j in range(NONZERO):
        h = mix(ids * np.uint64(NONZERO) + np.uint64(j + 1))
        np.add.at(out, (np.arange(BUCKETS), (h % np.uint64(DIM)).astype(np.int64)), np.where(h >> np.uint64(63), 1, -1).astype(np.float32))
    return out


def context_vectors(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Index vectors plus the normalised sum of neighbours' index vectors over all words of the sample."""
    base = index_vectors()
    count = np.bincount(ids, minlength=BUCKETS)
    rare = (1 / np.sqrt(1 + count)).astype(np.float32)  # frequent neighbours tell less
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    total = np.zeros_like(base)
    for step in range(1, WINDOW + 1):
        same = row[step:] == row[:-step]
        a, b = ids[:-step][same], ids[step:][same]
        for at, near in ((a, b), (b, a)):
            for d in range(DIM):
                total[:, d] += np.bincount(at, base[near, d] * rare[near], BUCKETS)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return base / np.sqrt(NONZERO) + total / np.maximum(norm, 1e-6)


def pooled(vectors: np.ndarray, ids: np.ndarray, off: np.ndarray, center: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """Mean vectors of rows and PRIOR words of the corpus's mean, `center`, of some `most` words at a time."""
    out = np.tile(PRIOR * center.astype(np.float32), (len(off) - 1, 1))
    for lo, hi, part, ends in chunks(ids, off, most):
        full = np.flatnonzero(ends[:-1] < ends[1:])
        if len(full):
            out[lo:hi][full] += np.add.reduceat(vectors[part], ends[:-1][full], axis=0)
    return out / (np.diff(off) + PRIOR)[:, None].astype(np.float32)


@dataclass
class QualityModel:
    vectors: np.ndarray
    center: np.ndarray  # mean vector of a word of the sample
    layers: list[np.ndarray]
    temperature: float
    share: float  # of label 1 in the sample

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, spread, a, b, c, d = self.layers
        return np.tanh((x - mean) / spread @ a + b) @ c + d

    def scores(self, data: np.ndarray, off: np.ndarray, hasher: WordHasher) -> np.ndarray:
        ids, ends = words(data, off, hasher)
        found = _sigmoid(self.logits(pooled(self.vectors, ids, ends, self.center)).astype(np.float64) / self.temperature)
        return np.where(ends[1:] > ends[:-1], found, self.share)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def excerpt(text: bytes, rng: np.random.Generator) -> bytes:
    """Some consecutive words of a training text: 3 to 120, short ones likelier, by the same law whatever its label.

    Short texts are rare among labelled ones, and their pooled vectors vary most.
    """
    parts = text.split(b" ")
    n = int(np.exp(rng.uniform(np.log(3), np.log(121))))
    at = int(rng.integers(max(1, len(parts) - n + 1)))
    return b" ".join(parts[at : at + n])


def train(rows: list[tuple[bytes, int]], seed: int = 11) -> QualityModel:
    y = np.array([r[1] for r in rows], np.float64)
    share = float(y.mean()) if len(y) else 0.0
    if len(set(y.tolist())) < 2:
        logit = np.float32(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return QualityModel(index_vectors(), np.zeros(DIM), [np.zeros(DIM), np.ones(DIM), np.zeros((DIM, 1)), np.zeros(1), np.zeros(1), logit], 1.0, share)
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    # texts set apart for the temperature, unless the others are of one class
    aside = max(2, len(rows) // 5)
    aside = aside if len({q for _, q in rows[aside:]}) == 2 else 0
    # excerpts of those set apart come first, so that what is apart stays in front
    rows = [*((excerpt(t, rng), q) for t, q in rows[:aside]), *rows, *((excerpt(t, rng), q) for t, q in rows[aside:] for _ in range(EXCERPTS))]
    aside *= 2
    y = np.array([r[1] for r in rows], np.float64)
    hasher = WordHasher()
    data, off = joined([r[0] for r in rows])
    parts = [words(d, o, hasher) for _, _, d, o in chunks(data, off)]
    ids = np.concatenate([p[0] for p in parts])
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))])
    vectors = context_vectors(ids, ends)
    center = np.bincount(ids, minlength=BUCKETS) @ vectors / max(1, len(ids))
    x = pooled(vectors, ids, ends, center)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / spread
    apart, fit = slice(0, aside or len(y)), slice(aside, None)
    a, b = rng.normal(0, DIM**-0.5, (DIM, HIDDEN)), np.zeros(HIDDEN)
    c, d = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (a, b, c, d)]
    X, Y = x[fit].astype(np.float64), y[fit]
    for t in range(1, STEPS + 1):
        h = np.tanh(X @ a + b)
        g = (_sigmoid(h @ c + d) - Y) / len(Y)
        gh = g[:, None] * c * (1 - h * h)
        for p, gp, (m, v) in zip((a, b, c, d), (X.T @ gh + DECAY * a, gh.sum(0), h.T @ g + DECAY * c, g.sum(keepdims=True)), state, strict=True):
            m += 0.1 * (gp - m)
            v += 0.01 * (gp * gp - v)
            p -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    z = np.tanh(x[apart] @ a + b) @ c + d
    grid = np.geomspace(0.25, 8, 60)
    loss = [-np.mean(np.log(np.where(y[apart] == 1, p := np.clip(_sigmoid(z / s), 1e-9, 1 - 1e-9), 1 - p))) for s in grid]
    layers = [q.astype(np.float32) for q in (mean, spread, a, b, c)] + [np.float32(d[0])]
    return QualityModel(vectors, center, layers, float(grid[int(np.argmin(loss))]), share)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS, max_bytes: int = MAX_BYTES) -> QualityModel:
    return train(labelled_sample(docs, labels, label, per_class, max_bytes))


def score(docs: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """doc_id, score, predicted of each row, in one scan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            p = np.concatenate([model.scores(d, o, hasher) for _, _, d, o in chunks(data, off)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Fits on the bounded labelled sample, then scores every whole text: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Whole rows whose text scores at least threshold, in one scan: rows are filtered within their Arrow batch."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            p = np.concatenate([model.scores(d, o, hasher) for _, _, d, o in chunks(data, off)] or [np.zeros(0)])
            yield batch.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
