"""Feeds' messages to trades, with rejects beside them.

Each parser takes a frame with a string column `value` and returns one row per trade, or one per rejected
message or element: the trade's columns, `pos` (place in the message), `reject` (null for trades) and
`value`.  Nothing is dropped silently: accepted() and rejected() tell the rows apart.

reject is one of
    malformed      not a JSON object, or its data are missing or of the wrong shape
    not_trade      another kind of message
    missing_field  a field that the feed must have isn't there
    bad_number     a number that isn't written as one, isn't finite or doesn't fit
    bad_time       an event time of more than 15 digits

Every message is parsed once, or twice where keys that differ by case only are both read: fields are taken
from the parsed value, and rows come from a generator, below which Catalyst doesn't push predicates on them.  All is built-in expressions, so that it runs in
whole-stage code and in streams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.codecs import symbol_of_okx, symbol_of_topic
from ..functions.numbers import now_ms, to_double, to_id
from .candles import MAX_TIME

Parser = Callable[..., DataFrame]


def _trade(exchange: str, instrument: Column, trade_id: Column, price: Column, qty: Column, event_ts: Column, trade_ts: Column, recv_ts: Column, reject: Column) -> Column:
    return F.struct(
        F.lit(exchange).alias("exchange"),
        instrument.alias("instrument"),
        trade_id.alias("trade_id"),
        price.alias("price"),
        qty.alias("qty"),
        event_ts.alias("event_ts"),
        trade_ts.alias("trade_ts"),
        recv_ts.alias("recv_ts"),
        F.coalesce(reject, F.when(~event_ts.between(-MAX_TIME, MAX_TIME), "bad_time")).alias("reject"),
    )


def _nothing(exchange: str, reason: Column, recv_ts: Column) -> Column:
    def none(kind: str) -> Column:
        return F.lit(None).cast(kind)

    return F.array(_trade(exchange, none("string"), none("bigint"), none("double"), none("double"), none("bigint"), none("bigint"), recv_ts, reason))


def _rows(frame: DataFrame, rows: Column) -> DataFrame:
    out = frame.select("value", F.posexplode(rows).alias("pos", "row"))
    return out.select(*[F.col(f"row.{c}").alias(c) for c in schemas.TRADE_COLUMNS], "pos", F.col("row.reject").alias("reject"), "value")


def _any_null(*columns: Column) -> Column:
    out = columns[0].isNull()
    for c in columns[1:]:
        out = out | c.isNull()
    return out


def _numbers(raw: tuple[Column, ...], read: tuple[Column, ...]) -> Column:
    """Whether any number is there but can't be read."""
    out = F.lit(False)
    for a, b in zip(raw, read, strict=True):
        out = out | (a.isNotNull() & b.isNull())
    return out


def binance(raw: DataFrame, recv_ts: Column | None = None) -> DataFrame:
    """Combined stream: one trade in `data`, whose kind isn't looked at."""
    m = _json(raw, schemas.BINANCE, recv_ts, schemas.BINANCE_TIME)
    d = F.col("m.data")
    texts = (d["t"], d["p"], d["q"], d["E"], F.col("m2.data.T"))
    read = (to_id(texts[0]), to_double(texts[1]), to_double(texts[2]), to_id(texts[3]), to_id(texts[4]))
    reject = F.when(_any_null(d["s"], *texts), "missing_field").when(_numbers(texts, read), "bad_number")
    good = F.array(_trade("BINANCE", d["s"], *read, F.col("recv_ts"), reject))
    return _rows(m, F.when(_broken(d), _nothing("BINANCE", F.lit("malformed"), F.col("recv_ts"))).otherwise(good))


def binance_raw(raw: DataFrame, recv_ts: Column | None = None) -> DataFrame:
    """Raw stream: keys at the top, of kind trade only; fields that are missing stay null."""
    m = _json(raw, schemas.BINANCE_RAW, recv_ts, schemas.BINANCE_RAW_TIME)
    texts = (F.col("m.t"), F.col("m.p"), F.col("m.q"), F.col("m2.T"))
    read = (to_id(texts[0]), to_double(texts[1]), to_double(texts[2]), to_id(texts[3]))
    good = F.array(_trade("BINANCE", F.upper("m.s"), read[0], read[1], read[2], read[3], read[3], F.col("recv_ts"), F.when(_numbers(texts, read), "bad_number")))
    rows = F.when(_broken(F.col("m")), _nothing("BINANCE", F.lit("malformed"), F.col("recv_ts"))).when(~F.col("m.e").eqNullSafe("trade"), _nothing("BINANCE", F.lit("not_trade"), F.col("recv_ts"))).otherwise(good)
    return _rows(m, rows)


def _json(raw: DataFrame, schema: str, recv_ts: Column | None, apart: str | None = None) -> DataFrame:
    """value, recv_ts, object (whether the text is of an object), m and, by a schema of its own, m2."""
    recv = now_ms() if recv_ts is None else recv_ts
    more = [F.from_json("value", apart).alias("m2")] if apart else []
    return raw.select("value", recv.alias("recv_ts"), F.col("value").rlike(r"^\s*\{").alias("object"), F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m"), *more)


def _broken(data: Column) -> Column:
    """Whether a message isn't an object, can't be parsed or lacks its data."""
    return F.coalesce(~F.col("object") | F.col("m._corrupt").isNotNull() | F.col("m").isNull() | data.isNull(), F.lit(True))


def bybit(raw: DataFrame, recv_ts: Column | None = None) -> DataFrame:
    """Public trades: one trade an element; the symbol is the topic's; a single bad element rejects the message."""
    m = _json(raw, schemas.BYBIT, recv_ts).withColumn("symbol", symbol_of_topic(F.col("m.topic")))

    def element(x: Column) -> Column:
        texts = (x["i"], x["p"], x["v"])
        read = (to_id(x["i"]), to_double(x["p"]), to_double(x["v"]))
        reject = F.when(_any_null(x["T"], *texts), "missing_field").when(_numbers(texts, read), "bad_number")
        return _trade("BYBIT", F.col("symbol"), read[0], read[1], read[2], F.col("m.ts"), x["T"], F.col("recv_ts"), reject)

    wrong = _broken(F.col("m.data")) | _any_null(F.col("m.topic"), F.col("m.type"), F.col("m.ts")) | F.exists("m.data", lambda x: x.isNull())
    m = m.withColumn("rows", F.when(~F.coalesce(wrong, F.lit(True)), F.transform("m.data", element)))
    first = F.filter("rows", lambda r: r["reject"].isNotNull())
    rows = F.when(F.col("rows").isNull(), _nothing("BYBIT", F.lit("malformed"), F.col("recv_ts"))).when(F.size(first) > 0, _nothing("BYBIT", F.get(first, F.lit(0))["reject"], F.col("recv_ts"))).otherwise(F.col("rows"))
    return _rows(m, rows)


def bybit_provider(raw: DataFrame, recv_ts: Column | None = None) -> DataFrame:
    """As bybit, but the symbol is each element's own, missing fields stay null, and bad elements go alone."""
    m = _json(raw, schemas.BYBIT_PROVIDER, recv_ts)

    def element(x: Column) -> Column:
        texts = (x["i"], x["p"], x["v"])
        read = (to_id(x["i"]), to_double(x["p"]), to_double(x["v"]))
        return _trade("BYBIT", x["s"], read[0], read[1], read[2], x["T"], x["T"], F.col("recv_ts"), F.when(x.isNull(), "malformed").when(_numbers(texts, read), "bad_number"))

    trades = F.coalesce(F.col("m.topic").contains("publicTrade"), F.lit(False))
    wrong = _broken(F.col("m")) | (trades & F.col("m.data").isNull())
    rows = F.when(wrong, _nothing("BYBIT", F.lit("malformed"), F.col("recv_ts"))).when(~trades, _nothing("BYBIT", F.lit("not_trade"), F.col("recv_ts"))).otherwise(F.transform("m.data", element))
    return _rows(m, rows)


def okx(raw: DataFrame, recv_ts: Column | None = None) -> DataFrame:
    """Trades channel, or no channel named; ids lose their hyphens; bad elements go alone."""
    m = _json(raw, schemas.OKX, recv_ts)

    def element(x: Column) -> Column:
        texts = (x["tradeId"], x["px"], x["sz"], x["ts"])
        read = (to_id(x["tradeId"]), to_double(x["px"]), to_double(x["sz"]), to_id(x["ts"]))
        return _trade("OKX", symbol_of_okx(x["instId"]), read[0], read[1], read[2], read[3], read[3], F.col("recv_ts"), F.when(x.isNull(), "malformed").when(_numbers(texts, read), "bad_number"))

    other = F.coalesce(F.col("m.arg.channel") != "trades", F.lit(False))
    wrong = _broken(F.col("m.data"))
    rows = F.when(wrong, _nothing("OKX", F.lit("malformed"), F.col("recv_ts"))).when(other, _nothing("OKX", F.lit("not_trade"), F.col("recv_ts"))).otherwise(F.transform("m.data", element))
    return _rows(m, rows)


PARSERS: dict[str, Parser] = {"binance": binance, "binance_raw": binance_raw, "bybit": bybit, "bybit_provider": bybit_provider, "okx": okx}


def parse(raw: DataFrame, feed: str, recv_ts: Column | None = None) -> DataFrame:
    return PARSERS[feed](raw, recv_ts)


def accepted(parsed: DataFrame) -> DataFrame:
    """The trades, with the columns of a trade."""
    return parsed.where("reject is null").select(*schemas.TRADE_COLUMNS)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where("reject is not null").select("exchange", "pos", "reject", "value")
