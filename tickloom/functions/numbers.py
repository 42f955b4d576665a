"""Strict numbers from text, event time, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(text: Column) -> Column:
    """A finite decimal number written in full; null for all else, such as signs of plus, blanks, suffixes, inf and nan."""
    value = F.when(text.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def to_id(text: Column) -> Column:
    """A whole number of digits only; null if it doesn't fit a bigint."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint"))


def window_start(event_ts: Column, interval_ms: int) -> Column:
    """The epoch-aligned start of the window that an event time in ms falls into."""
    if interval_ms <= 0:
        raise ValueError("interval_ms must be positive")
    return event_ts - event_ts % F.lit(interval_ms)


def now_ms() -> Column:
    """The wall clock in ms, one value a query or micro-batch."""
    return F.unix_millis(F.current_timestamp())


def notional(price: Column, qty: Column) -> Column:
    return price * qty


def reconnect_delay_ms(attempt: Column, first_ms: int = 1000, most_ms: int = 60_000) -> Column:
    """Doubling from first_ms, capped; attempts count from 1."""
    return F.least(F.lit(first_ms) * F.pow(F.lit(2), attempt - 1), F.lit(most_ms)).cast("bigint")


def reconnect_schedule(attempts: int = 10, first_ms: int = 1000, most_ms: int = 60_000) -> list[int]:
    """Delays before each attempt; after the last one a feed is given up."""
    return [min(first_ms << (n - 1), most_ms) for n in range(1, attempts + 1)]
