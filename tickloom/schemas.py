"""The trade and candle schemas, and the wire shapes that parsers ask for."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "tinyint": T.ByteType()}


def _schema(text: str) -> T.StructType:
    """A flat schema from names and types; needs no session, unlike Spark's own DDL parser."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (field.split() for field in text.split(","))])


TRADE_COLUMNS = ("exchange", "instrument", "trade_id", "price", "qty", "event_ts", "trade_ts", "recv_ts")
TRADE = _schema("exchange string, instrument string, trade_id bigint, price double, qty double, event_ts bigint, trade_ts bigint, recv_ts bigint")
CANDLE = _schema(
    "instrument_id tinyint, instrument string, exchange string, interval_ms bigint, window_start_ms bigint, window_end_ms bigint, "
    "open double, high double, low double, close double, base_volume double, quote_volume double"
)
CANDLE_COLUMNS = tuple(f.name for f in CANDLE)

#: Only what is read: of key pairs that differ by case, one at most, so that fields stay unambiguous. Where both
#: of a pair are read, they are read apart. As strings, numbers keep the text that they are written in.
BINANCE = "data struct<E: string, s: string, t: string, p: string, q: string>, _corrupt string"
BINANCE_TIME = "data struct<T: string>"
BINANCE_RAW = "e string, s string, t string, p string, q string, _corrupt string"
BINANCE_RAW_TIME = "T string"
BYBIT = "topic string, ts bigint, type string, data array<struct<i: string, T: bigint, p: string, v: string>>, _corrupt string"
BYBIT_PROVIDER = "topic string, data array<struct<i: string, T: bigint, p: string, v: string, s: string>>, _corrupt string"
OKX = "arg struct<channel: string>, data array<struct<instId: string, tradeId: string, px: string, sz: string, ts: string>>, _corrupt string"
