"""Lists in text, and the messages that subscribe to a feed."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import okx_of_symbol


def split_list(text: str) -> list[str]:
    """Comma-separated tokens; empty ones in the middle count, one at the end doesn't."""
    tokens = text.split(",")
    return tokens[:-1] if tokens[-1] == "" else tokens


def split_column(text: Column) -> Column:
    tokens = F.split(text, ",", -1)
    return F.when(F.element_at(tokens, -1) == "", F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens)


def okx_id(symbol: str) -> str:
    head, found, tail = symbol.partition("USDT")
    return f"{head}-{found}{tail}" if found else symbol


def subscribe_text(feed: str, symbols: Sequence[str], verb: str = "subscribe") -> str:
    """The message that subscribes to a feed, or unsubscribes, as JSON without blanks."""
    # fixed values: the exchanges' protocols, here and below
    bodies = {
        "binance": lambda: {"method": verb.upper(), "params": [f"{s.lower()}@trade" for s in symbols], "id": 1},
        "bybit": lambda: {"op": verb, "args": [f"publicTrade.{s}" for s in symbols]},
        "okx": lambda: {"op": verb, "args": [{"channel": "trades", "instId": okx_id(s)} for s in symbols]},
    }
    return json.dumps(bodies[feed](), separators=(",", ":"))


def subscribe_column(feed: str, symbols: Column) -> Column:
    """The same from an array column of symbols that need no escaping."""
    q = F.lit('"')
    if feed == "binance":
        items, head, tail = F.transform(symbols, lambda s: F.concat(q, F.lower(s), F.lit('@trade"'))), '{"method":"SUBSCRIBE","params":[', '],"id":1}'
    elif feed == "bybit":
        items, head, tail = F.transform(symbols, lambda s: F.concat(F.lit('"publicTrade.'), s, q)), '{"op":"subscribe","args":[', "]}"
    elif feed == "okx":
        items, head, tail = F.transform(symbols, lambda s: F.concat(F.lit('{"channel":"trades","instId":"'), okx_of_symbol(s), F.lit('"}'))), '{"op":"subscribe","args":[', "]}"
    else:
        raise KeyError(feed)
    return F.concat(F.lit(head), F.array_join(items, ","), F.lit(tail))
