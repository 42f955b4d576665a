"""Exchanges and instruments by name and by number. Matching is exact and case-sensitive; all else is unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the numbers that records carry
UNKNOWN = -1
EXCHANGES = {"BINANCE": 0, "BYBIT": 1, "OKX": 2}
INSTRUMENTS = {"BTCUSDT": 0, "ETHUSDT": 1, "SOLUSDT": 2}
UNKNOWN_NAME = "UNKNOWN"


def _code(name: Column, codes: dict[str, int]) -> Column:
    out = F
    for k, v in codes.items():
        out = out.when(name == k, F.lit(v))
    return out.otherwise(F.lit(UNKNOWN)).cast("tinyint")


def _name(code: Column, codes: dict[str, int]) -> Column:
    out = F
    for k, v in codes.items():
        out = out.when(code == v, F.lit(k))
    return out.otherwise(F.lit(UNKNOWN_NAME))


def exchange_code(name: Column) -> Column:
    return _code(name, EXCHANGES)


def exchange_name(code: Column) -> Column:
    return _name(code, EXCHANGES)


def instrument_id(name: Column) -> Column:
    return _code(name, INSTRUMENTS)


def instrument_name(code: Column) -> Column:
    return _name(code, INSTRUMENTS)


def symbol_of_topic(topic: Column, prefix: str = "publicTrade.") -> Column:
    """What follows the first prefix, wherever it stands; empty without one."""
    at = F.instr(topic, prefix)
    return F.when(at > 0, F.substring(topic, at + len(prefix), F.length(topic))).otherwise("")


def okx_of_symbol(symbol: Column) -> Column:
    """A hyphen before the first USDT, if there is one."""
    at = F.instr(symbol, "USDT")
    return F.when(at > 0, F.concat(F.substring(symbol, F.lit(1), at - 1), F.lit("-"), F.substring(symbol, at, F.length(symbol)))).otherwise(symbol)


def symbol_of_okx(inst_id: Column) -> Column:
    return F.replace(inst_id, F.lit("-"), F.lit(""))
