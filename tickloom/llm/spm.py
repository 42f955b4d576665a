"""SentencePiece encoding that keeps every piece's place in the original text, and decoding.

Normalisation is done here: at each position the longest prefix in the model's compiled character map
(a double-array trie) is replaced, else one character is copied; white space is escaped and, if the
model says so, collapsed and prefixed.  Each normalised byte records the source position it comes from,
so a piece's bytes in the normalised text project to a byte span of the original.  Segmentation into
pieces is the sentencepiece library's, on the normalised text, with a copy of the model whose own
normaliser is the identity.  Decoding is the library's with the model as given.

Null and empty texts have no pieces, only the begin and end ids.  The model is read once on the driver,
by a path that is a parameter; executors get its bytes.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁".encode()
CONTROL, USER_DEFINED, BYTE = 3, 4, 6
#: Texts that are encoded together, and their bytes.
BATCH_ROWS, BATCH_BYTES = 512, 1 << 20
_INTS = T.ArrayType(T.IntegerType())
COLUMNS = {"ids": _INTS, "ids_le": T.BinaryType(), "begins": _INTS, "ends": _INTS, "decoded": T.StringType(), "aligned": T.BooleanType(), "n_ids": T.LongType()}


def _fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(field, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, kind, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, kind, raw[at : at + size]
            at += size


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def identity_copy(model: bytes) -> bytes:
    """The model with a normaliser that changes nothing but what escaping needs."""
    spec = b"\x0a\x08identity" + b"\x18\x00" + b"\x20\x00" + b"\x28\x01"
    out = b""
    for field, kind, value in _fields(model):
        if field == 3:
            continue
        out += _varint(field << 3 | kind) + (_varint(value) if kind == 0 else (_varint(len(value)) if kind == 2 else b"") + value)
    return out + _varint(3 << 3 | 2) + _varint(len(spec)) + spec


class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 and the replacements' strings."""

    def __init__(self, blob: bytes) -> None:
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, source bytes) of the longest prefix of text[at:] in the map."""
        if not self.units:
            return None
        found = None
        unit = self.units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (self.strings[value : self.strings.index(b"\0", value)], i + 1 - at)
        return found


class Normalizer:
    def __init__(self, model: bytes) -> None:
        blob, self.prefix, self.collapse, self.escape, self.suffix = b"", True, True, True, False
        symbols = []
        for field, _, value in _fields(model):
            if field == 1:
                piece = {f: v for f, _, v in _fields(value)}
                if piece.get(3, 1) == USER_DEFINED:
                    symbols.append(piece[1])
            elif field == 2:
                self.suffix = bool({f: v for f, _, v in _fields(value)}.get(24, 0))
            elif field == 3:
                spec = {f: v for f, _, v in _fields(value)}
                blob, self.prefix, self.collapse, self.escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        self.map = CharacterMap(blob)
        self.symbols = sorted(symbols, key=len, reverse=True)
        #: Nothing is replaced or collapsed, so that whole texts are treated at once.
        self.plain = not self.map.units and not self.collapse and self.escape and not self.symbols and not self.suffix

    def _next(self, text: bytes, at: int) -> tuple[bytes, int, bool]:
        """(replacement, source bytes, whether they are the source's own) at a position."""
        for s in self.symbols:
            if text.startswith(s, at):
                return s, len(s), True
        if found := self.map.longest(text, at):
            return *found, False
        b = text[at]
        size = 1 if b < 128 else 2 if b < 224 else 3 if b < 240 else 4
        return text[at : at + size], size, True

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised text, source position of each of its bytes and of its end)."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.plain:
            raw = np.frombuffer(text, np.uint8)
            at = np.repeat(np.arange(len(raw)), np.where(raw == 32, len(SPACE), 1))
            head = len(SPACE) * self.prefix
            return SPACE * self.prefix + text.replace(b" ", SPACE), np.concatenate([np.zeros(head, np.int64), at, [len(raw)]])
        space = SPACE if self.escape else b" "
        out, source = bytearray(), []
        at, end = 0, len(text)
        steps = []
        while at < end:
            new, size, same = self._next(text, at)
            steps.append((new, at, same))
            at += size
        if self.collapse:
            steps = list(itertools.dropwhile(lambda s: s[0] == b" ", steps))
        if not steps:
            return b"", np.array([end], np.int64)
        if self.prefix and not self.suffix:
            out += space
            source += [steps[0][1]] * len(space)
        blank = self.collapse
        for new, at, same in steps:
            if blank and self.collapse:
                new, same = (new.lstrip(b" "), same and not new.startswith(b" "))
            for i, b in enumerate(new):
                if b == 32:
                    out += space
                    source += [at] * len(space)
                else:
                    out.append(b)
                    source.append(at + i if same else at)
            blank = new.endswith(b" ") if new else blank
        if self.collapse:
            while out.endswith(space):
                del out[-len(space) :], source[-len(space) :]
        if self.prefix and self.suffix:
            out += space
            source += [len(text)] * len(space)
        return bytes(out), np.array([*source, end], np.int64)


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=identity_copy(model))
        self.normalizer = Normalizer(model)
        self.lengths = np.array([1 if self.own.is_byte(i) else len(self.own.id_to_piece(i).encode()) for i in range(self.own.vocab_size())], np.int64)
        self.unknown = self.own.unk_id()

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids with begin and end, first and end source byte of each) of each text; begin and end ids span nothing."""
        pairs = [self.normalizer(t) for t in texts]
        out = []
        for (norm, source), ids, text in zip(pairs, self.plain.encode([n for n, _ in pairs], num_threads=1), texts, strict=True):
            a = np.array([self.own.bos_id(), *ids, self.own.eos_id()], np.int64)
            size = self.lengths[a]
            size[0] = size[-1] = 0
            if self.unknown in ids:
                size[1:-1] = self._measured(norm)
            ends = np.cumsum(size)
            begins = source[ends - size]
            stops = source[ends]
            begins[-1] = stops[-1] = len(text)
            begins[0] = stops[0] = 0
            out.append((a, begins, stops))
        return out

    def _measured(self, norm: bytes) -> list[int]:
        """Bytes of each piece where a piece's own length doesn't tell: unknown characters."""
        sizes, text = [], norm.decode()
        for p in self.plain.encode(text, out_type="immutable_proto").pieces:
            sizes.append(1 if self.own.is_byte(p.id) else len(text[p.begin : p.end].encode()))
        return sizes

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.own.decode([x.tolist() for x in ids], num_threads=1) if ids else []


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int32)))


def encode_decode(spark: SparkSession, docs: DataFrame, model_path: str, columns: tuple[str, ...] = ("ids", "begins", "ends", "decoded")) -> DataFrame:
    """All columns of docs but text, and the asked ones of COLUMNS, of each whole text; columns of docs so named are replaced.

    ids_le: ids as little-endian unsigned 32-bit integers. aligned: the pieces' source spans are in order and
    cover the text from its first byte to its last.
    """
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    others = [c for c in docs.columns if c not in ("text", *columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(model.value)
        for batch in batches:
            lo = 0
            sizes = np.array([0 if x is None else x for x in pc.binary_length(batch.column("text")).to_pylist()], np.int64)
            total = np.concatenate([[0], np.cumsum(sizes)])
            while lo < batch.num_rows:
                hi = min(max(lo + 1, int(np.searchsorted(total, total[lo] + BATCH_BYTES, "right")) - 1), lo + BATCH_ROWS)
                part = batch.slice(lo, hi - lo)
                texts = [(x or "").encode() for x in part.column("text").to_pylist()]
                found = codec.encode(texts)
                make = {
                    "ids": lambda found=found: _lists([x[0] for x in found]),
                    "ids_le": lambda found=found: pa.array([x[0].astype("<u4").tobytes() for x in found], pa.binary()),
                    "begins": lambda found=found: _lists([x[1] for x in found]),
                    "ends": lambda found=found: _lists([x[2] for x in found]),
                    "decoded": lambda found=found: pa.array(codec.decode([x[0] for x in found]), pa.string()),
                    "aligned": lambda found=found, texts=texts: pa.array([bool((b[1:] == e[:-1]).all() and b[0] == 0 and e[-1] == len(t)) for (_, b, e), t in zip(found, texts, strict=True)]),
                    "n_ids": lambda found=found: pa.array([len(x[0]) for x in found], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), *(make[c]() for c in columns)], [*others, *columns])
                lo = hi

    schema = T.StructType([*(docs.schema[c] for c in others), *(T.StructField(c, COLUMNS[c]) for c in columns)])
    return docs.select(*(F.col(f"`{c}`") for c in others), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
