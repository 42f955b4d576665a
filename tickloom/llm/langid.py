"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads every byte of the text, in stretches of SPAN bytes, so that a text's length costs no memory and its
stretches are read side by side; in both directions it reads WARM bytes of the text more before it labels, so
that no position, nor a character of several bytes, is labelled from a zero state.  It labels every position once, and a
document's probabilities are the mean over its positions.
Training is by backpropagation through time in numpy, with the language as each position's label.

A text that is null or has no letter is `und` with score 0.  Without labelled languages everything is
`und`.  Repeated rows and ids are labelled each on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, byte_view, chunks, held_out

HIDDEN = 8
SPAN, WARM = 64, 8
#: Stretches that are read side by side: the arrays of one step stay in a core's cache.
LANES = 2048
#: Bound of the labelled sample: rows shared out among languages, but FEW of each at least; bytes of a text, stretches of a language.
ROWS, FEW, MAX_BYTES, STRETCHES = 3000, 40, 9_000, 2500
STEPS, BATCH, RATE = 160, 192, 0.02
UNKNOWN = "und"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place: 1 / (1 + exp(-x))."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of SPAN bytes and WARM more on each side, blanks beyond the document's ends; own bytes of each; document of each)."""
    per = -(-np.diff(off) // SPAN)
    doc = np.repeat(np.arange(len(per)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = off[:-1][doc] + nth * SPAN
    length = np.minimum(off[1:][doc] - begin, SPAN)
    padded = np.concatenate([np.full(WARM, 32, np.uint8), LOWER[data], np.full(SPAN + WARM, 32, np.uint8)])
    at = begin[:, None] + np.arange(-WARM, SPAN + WARM)
    out = padded[at + WARM]
    out[(at < off[:-1][doc][:, None]) | (at >= off[1:][doc][:, None])] = 32
    return out, length, doc


class Direction:
    """A gated recurrent layer: inputs W[byte] (update, reset, candidate), recurrence U, candidate's own bias r."""

    def __init__(self, rng: np.random.Generator) -> None:
        self.W = rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32)
        self.U = rng.normal(0, HIDDEN**-0.5, (HIDDEN, 3 * HIDDEN)).astype(np.float32)
        self.r = np.zeros(HIDDEN, np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.W, self.U, self.r]

    def read(self, text: np.ndarray, back: bool) -> np.ndarray:
        """States after each position, [position, lane, unit]."""
        span, lanes = text.shape[1], len(text)
        out = np.empty((span, lanes, HIDDEN), np.float32)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(span - 1, -1, -1) if back else range(span):
            x = self.W[text[:, t]]
            u = h @ self.U
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, s = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = u[:, 2 * HIDDEN :] + self.r
            c *= s
            c += x[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            h = c + z * (h - c)
            out[t] = h
        return out

    def learn(self, text: np.ndarray, states: np.ndarray, grad: np.ndarray, back: bool) -> list[np.ndarray]:
        """Gradients by backpropagation through time; grad: of the loss to each position's state."""
        span, lanes = text.shape[1], len(text)
        gW, gU, gr = np.zeros_like(self.W), np.zeros_like(self.U), np.zeros_like(self.r)
        order = range(span) if back else range(span - 1, -1, -1)
        carry = np.zeros((lanes, HIDDEN), np.float32)
        before = 1 if back else -1
        for t in order:
            p = t + before
            h = states[p] if 0 <= p < span else np.zeros((lanes, HIDDEN), np.float32)
            x = self.W[text[:, t]]
            u = h @ self.U
            gates = _sigmoid(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, s = gates[:, :HIDDEN], gates[:, HIDDEN:]
            q = u[:, 2 * HIDDEN :] + self.r
            c = np.tanh(s * q + x[:, 2 * HIDDEN :])
            g = grad[t] + carry
            gc = g * (1 - z) * (1 - c * c)
            gz = g * (h - c) * z * (1 - z)
            gs = gc * q * s * (1 - s)
            gx = np.concatenate([gz, gs, gc], 1)
            gu = np.concatenate([gz, gs, gc * s], 1)
            gU += h.T @ gu
            gr += (gc * s).sum(0)
            np.add.at(gW, text[:, t], gx)
            carry = g * z + gu @ self.U.T
        return [gW, gU, gr]


@dataclass
class LanguageModel:
    languages: list[str]
    ahead: Direction
    back: Direction
    V: np.ndarray  # [2 * HIDDEN, languages]
    b: np.ndarray

    def position_probabilities(self, text: np.ndarray) -> np.ndarray:
        """[position, lane, language] for rows of bytes, of those positions that aren't read to warm up."""
        z = self.ahead.read(text, False)[WARM:-WARM] @ self.V[:HIDDEN]
        z += self.back.read(text, True)[WARM:-WARM] @ self.V[HIDDEN:]
        z += self.b
        z -= z.max(2, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(2, keepdims=True)
        return z

    def pooled(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean probabilities of each document's positions; 0 for empty ones."""
        text, length, doc = stretches(data, off)
        total = np.zeros((len(off) - 1, len(self.languages)))
        for lo in range(0, len(text), LANES):
            p = self.position_probabilities(text[lo : lo + LANES])
            p *= (np.arange(SPAN)[:, None] < length[lo : lo + LANES])[:, :, None]
            each = p.sum(0)
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(doc[lo : lo + LANES], each[:, k], len(total))
        return total / np.maximum(np.diff(off), 1)[:, None]


def train(rows: list[tuple[bytes, str]], seed: int = 5) -> LanguageModel | None:
    languages = sorted({r[1] for r in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    ahead, back = Direction(rng), Direction(rng)
    V = rng.normal(0, 0.5, (2 * HIDDEN, len(languages))).astype(np.float32)
    model = LanguageModel(languages, ahead, back, V, np.zeros(len(languages), np.float32))
    pools = []
    for lang in languages:
        texts = [r[0] for r in rows if r[1] == lang]
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=off[1:])
        text, length, _ = stretches(np.frombuffer(b"".join(texts), np.uint8), off)
        full = np.flatnonzero(length >= SPAN // 2)
        full = full if len(full) else np.arange(len(text))
        if len(full):
            pools.append(text[rng.permutation(full)[:STRETCHES]])
        else:
            pools.append(np.full((1, SPAN + 2 * WARM), 32, np.uint8))

    def beside(grad: np.ndarray) -> np.ndarray:
        """Nothing is labelled, and nothing learned directly, where the network warms up."""
        return np.pad(grad, ((WARM, WARM), (0, 0), (0, 0)))

    parameters = [*ahead.parameters, *back.parameters, model.V, model.b]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    for t in range(1, STEPS + 1):
        y = np.arange(BATCH) % len(languages)
        text = np.stack([pools[k][rng.integers(len(pools[k]))] for k in y])
        f, g = ahead.read(text, False), back.read(text, True)
        f0, g0 = f[WARM:-WARM], g[WARM:-WARM]
        z = f0 @ model.V[:HIDDEN] + g0 @ model.V[HIDDEN:] + model.b
        z -= z.max(2, keepdims=True)
        p = np.exp(z)
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        p /= BATCH * SPAN
        grads = [*ahead.learn(text, f, beside(p @ model.V[:HIDDEN].T), False), *back.learn(text, g, beside(p @ model.V[HIDDEN:].T), True)]
        flat = p.reshape(-1, len(languages))
        grads += [np.concatenate([f0.reshape(-1, HIDDEN).T @ flat, g0.reshape(-1, HIDDEN).T @ flat]), flat.sum(0)]
        size = np.sqrt(sum(float((x * x).sum()) for x in grads))
        rate = RATE * min(1.0, 2 * (1 - t / (STEPS + 1)))
        for x, gx, (m, v) in zip(parameters, grads, state, strict=True):
            gx = gx * min(1.0, 1 / max(size, 1e-9))
            m += 0.1 * (gx - m)
            v += 0.01 * (gx * gx - v)
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return model


def fit(docs: DataFrame, rows: int = ROWS, max_bytes: int = MAX_BYTES) -> LanguageModel | None:
    """On at most max(FEW, rows / languages) texts of each language, of at most max_bytes, those of least hash of doc_id, none held out.

    Languages are counted first, so that a rare one gives as many texts as a frequent one as long as it has them; a
    cut by hash in proportion to its count then keeps what reaches the driver within the bound.
    """
    order = F.xxhash64("doc_id")
    known = docs.where(~held_out() & F.col("lang").isNotNull() & (F.octet_length("text") <= max_bytes))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    most = max(FEW, rows // len(counts))
    # half as many again as are used, so that chance leaves none short
    cuts = docs.sparkSession.createDataFrame([(k, min(2**64 - 1, int(1.5 * (most + 20) / n * 2**64)) - 2**63) for k, n in counts.items()], "_lang string, _cut bigint")
    found = known.join(F.broadcast(cuts), F.col("lang") == F.col("_lang")).where(order <= F.col("_cut")).select("doc_id", F.col("text").cast("binary").alias("text"), "lang", order.alias("o"))
    drawn: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in found.orderBy("o", "doc_id", "text").limit(2 * (most + 20) * len(counts)).collect():
        if len(drawn[r.lang]) < most:
            drawn[r.lang].append(bytes(r.text))
    return train([(t, k) for k, texts in drawn.items() for t in texts])


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score of each row, in one scan without a shuffle."""
    names = np.array(model.languages if model else [UNKNOWN], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = byte_view(batch.column("text"))
            if model:
                p = np.concatenate([model.pooled(d, o) for _, _, d, o in chunks(data, off)] or [np.zeros((0, len(names)))])
                best, score = names[p.argmax(1)], p.max(1)
            else:
                best, score = np.full(len(off) - 1, UNKNOWN, object), np.zeros(len(off) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(best, pa.string()), pa.array(score, pa.float64()), batch.column("letters")], ["doc_id", "lang", "p", "letters"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    found = rows.mapInArrow(run, "doc_id long, lang string, p double, letters boolean")
    known = F.col("letters") & (F.col("lang") != UNKNOWN)
    return found.select("doc_id", F.when(known, F.col("lang")).otherwise(UNKNOWN).alias("lang_pred"), F.when(known, F.least(F.col("p"), F.lit(1.0))).otherwise(0.0).alias("score"))


def language_id(docs: DataFrame) -> DataFrame:
    """Fits on the bounded sample, then labels every whole text: doc_id, held_out, lang_pred, score."""
    return predict(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
