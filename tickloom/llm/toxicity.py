"""Toxicity: bags of hashed character n-grams, embedded, averaged and put through a linear softmax.

Embeddings and softmax are trained jointly in numpy.  A misspelling shares most n-grams with the word
it comes from, so it is scored by them.  Averaging and the softmax's logit are both linear, so at
scoring time each n-gram's embedding is folded into one number; a text costs a table lookup a byte
and n-gram order, over the whole text.

Texts: ASCII is lower-cased; bytes other than letters, digits and non-ASCII end a word; n-grams of
3 to 6 bytes are taken within words with one boundary mark on each side.  Null and empty texts have no
n-gram and get the score of the bias.  Repeated rows and ids are scored each on their own; without
labels of both classes every score is the share of label 1 (0 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_VALUES, CHUNK_BYTES, LOWER, byte_view, chunks, held_out, joined, labelled_sample, segment_sums

ORDERS = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 4
#: Bound of the labelled sample: rows of class 0 and of class 1, bytes of a text.
PER_CLASS, MAX_BYTES = (2600, 1700), 9_000
STEPS, BATCH, RATE, DECAY, SCALE = 200, 256, 0.05, 1e-5, 30.0
POSITIVE = 0.3


def _marks() -> np.ndarray:
    """Each byte in lower case; all that end words become a space."""
    table = LOWER.copy()
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    table[~word[table]] = 32
    return table


MARKS = _marks()


def marked(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with a boundary mark before and after each; where each row's mark stands; marks before each byte."""
    n = len(off) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(off))] = MARKS[data]
    spaces = np.zeros(len(padded) + 1, np.int32)
    np.cumsum(padded == 32, out=spaces[1:])
    return padded, off + np.arange(n + 1), spaces


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, offsets by row) of every n-gram; a row's come order by order within its chunk."""
    n = len(off) - 1
    padded, first, spaces = marked(data, off)
    values = BYTE_VALUES[padded]
    ids, rows = [], []
    for size in ORDERS:
        m = len(padded) - size + 1
        if m <= 0:
            continue
        # marks may stand at either end only
        keep = np.flatnonzero(spaces[size - 1 : size - 1 + m] - spaces[1 : 1 + m] == 0)
        h = np.full(len(keep), size, np.uint64)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + values[keep + j]
        h ^= h >> np.uint64(32)
        ids.append((h % np.uint64(BUCKETS)).astype(np.int32))
        rows.append(np.searchsorted(keep, first))
    if not ids:
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    each = np.diff(np.stack(rows), axis=1)
    out_off = np.zeros(n + 1, np.int64)
    np.cumsum(each.sum(0), out=out_off[1:])
    out = np.empty(out_off[-1], np.int32)
    begin = out_off[:-1].copy()
    for k, part in enumerate(ids):
        place = np.arange(len(part)) + np.repeat(begin - rows[k][:-1], each[k])
        out[place] = part
        begin += each[k]
    return out, out_off


@dataclass
class ToxicityModel:
    """weight: of each bucket, its embedding times the difference of the softmax's rows; bias likewise."""

    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probabilities of label 1. N-grams are summed order by order, without being gathered by row."""
        n = len(off) - 1
        padded, first, spaces = marked(data, off)
        values = BYTE_VALUES[padded]
        total, count = np.zeros(n), np.zeros(n)
        for size in ORDERS:
            m = len(padded) - size + 1
            if m <= 0:
                continue
            h = np.full(m, size, np.uint64)
            for j in range(size):
                h *= np.uint64(0x100000001B3)
                h += values[j : j + m]
            h ^= h >> np.uint64(32)
            h &= np.uint64(BUCKETS - 1)
            keep = spaces[size - 1 : size - 1 + m] == spaces[1 : 1 + m]
            ends = np.minimum(first, m)
            total += segment_sums(np.where(keep, self.weight[h.astype(np.int64)], 0), ends)
            count += segment_sums(keep, ends)
        z = total / np.maximum(count, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def counted(rows: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets seen in two texts or more, entries' place among them, share of their text's n-grams, offsets by text), in narrow types."""
    data, off = joined([r[0] for r in rows])
    cols, shares, sizes = [], [], []
    seen = np.zeros(BUCKETS, np.int32)
    for _, _, d, o in chunks(data, off, CHUNK_BYTES // 4):
        ids, ends = ngrams(d, o)
        key, times = np.unique(np.repeat(np.arange(len(o) - 1, dtype=np.int64), np.diff(ends)) * BUCKETS + ids, return_counts=True)
        r = key // BUCKETS
        cols.append((key % BUCKETS).astype(np.int32))
        shares.append((times / np.maximum(np.diff(ends), 1)[r]).astype(np.float32))
        sizes.append(np.bincount(r, minlength=len(o) - 1))
        seen += np.bincount(cols[-1], minlength=BUCKETS).astype(np.int32)
    vocab = np.flatnonzero(seen >= 2)
    place = np.full(BUCKETS, -1, np.int32)
    place[vocab] = np.arange(len(vocab))
    for k, (c, share, size) in enumerate(zip(cols, shares, sizes, strict=True)):
        c = place[c]
        use = c >= 0
        cols[k], shares[k] = c[use], share[use]
        sizes[k] = np.bincount(np.repeat(np.arange(len(size)), size)[use], minlength=len(size))
    return vocab, np.concatenate(cols), np.concatenate(shares), np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes))])


def train(rows: list[tuple[bytes, int]], seed: int = 7) -> ToxicityModel:
    """Adam on embeddings and softmax together, BATCH texts a step; buckets seen in fewer than two texts stay 0."""
    y = np.array([r[1] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.0
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    y = y[order]
    vocab, cols, shares, ends = counted([rows[i] for i in order])
    n, v = len(y), len(vocab)
    # label 1 is the rarer one in a corpus, so it weighs less than half, whatever its share of the sample
    weight = np.where(y == 1, POSITIVE / y.mean(), (1 - POSITIVE) / (1 - y.mean()))
    E, S, b = rng.normal(0, 0.1, (DIM, v)).astype(np.float32), rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    # averages over thousands of n-grams are small: a fixed scale keeps the gradients of order one
    shares *= np.float32(SCALE)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (E, S, b)]
    onehot = np.eye(2)[y]
    starts = np.arange(0, n, BATCH)
    for t in range(STEPS):
        if t % len(starts) == 0:
            turn = rng.permutation(starts)
        lo = int(turn[t % len(starts)])
        hi = min(lo + BATCH, n)
        own = slice(int(ends[lo]), int(ends[hi]))
        col, part, doc = cols[own], shares[own], np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
        H = np.stack([np.bincount(doc, e[col] * part, hi - lo) for e in E], 1)
        z = H @ S.T + b
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        g = (p - onehot[lo:hi]) * weight[lo:hi, None] / (hi - lo)
        gE = np.stack([np.bincount(col, x[doc] * part, v) for x in (g @ S).T.astype(np.float32)]).astype(np.float32) + np.float32(DECAY) * E
        rate = RATE * min(1.0, 2 * (1 - t / STEPS))
        for x, gx, (m, u) in zip((E, S, b), (gE, g.T @ H, g.sum(0)), state, strict=True):
            m += 0.1 * (gx - m)
            u += 0.01 * (gx * gx - u)
            x -= rate * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(u / (1 - 0.99 ** (t + 1))) + 1e-8)
    folded = np.zeros(BUCKETS, np.float32)
    folded[vocab] = SCALE * ((S[1] - S[0]) @ E)
    return ToxicityModel(folded, float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS, max_bytes: int = MAX_BYTES) -> ToxicityModel:
    return train(labelled_sample(docs, labels, label, per_class, max_bytes))


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted of each row, in one scan without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            p = np.concatenate([model.scores(d, o) for _, _, d, o in chunks(data, off)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Fits on the bounded labelled sample, then scores every whole text: doc_id, held_out, score, predicted."""
    return score(docs, fit(docs, labels), threshold).select("doc_id", held_out().alias("held_out"), "score", "predicted")
