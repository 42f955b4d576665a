"""Candles as a stream completes them, open ones from its state, and late trades that revise finished ones.

Trades are folded in the tasks that read them, a row for each candle and Arrow batch, before they are shuffled by instrument: an
instrument with most of the trades costs each task a row a window.  A stateful processor holds the open candles of an
instrument by window, in RocksDB, and writes those that change.

* A candle is completed when the watermark has passed its window: an event-time timer emits it once (kind `closed`) and
  drops its state.
* Trades of a window that is completed already aren't dropped: their fold is emitted (kind `late`). revised() merges such
  folds into the completed candles; merging is exact, since folds hold the order keys of open and close and decimal sums.
* Candles of several intervals come of one shuffle: folds are of the shortest one, and the processor merges each into a window of every
  interval, with timers of their own.
* open_candles() reads the open ones out of the checkpoint, of a stream that runs or one that has stopped: what it would emit
  next, or what is flushed when it ends.

What is emitted is a fold (FOLD); candles_of() makes candles of folds.  Volumes are sums of decimals where each trade's fit 18 digits
before the point, else sums of doubles.  Trades without price, quantity or time are passed over.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from decimal import Decimal, localcontext
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions.codecs import exchange_code, exchange_name, instrument_id
from ..functions.numbers import window_start
from ..operators.candles import order_key, usable, volumes
from ..schemas import CANDLE_COLUMNS

if TYPE_CHECKING:
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

# workers need not import this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ("per", "instrument")
VALUES = "open double, first string, high double, low double, close double, last string, code int, base double, quote double, exact_base string, exact_quote string, trades bigint"
NAMES = tuple(x.split()[0] for x in VALUES.split(", "))
#: per: the exchange if candles are made per exchange, else ''. Order keys and decimal sums are text; a sum that isn't exact is null.
FOLD = f"per string, instrument string, window_start_ms bigint, {VALUES}"
EMITTED = f"kind string, interval_ms bigint, {FOLD}"
CANDLE_KEY = ("interval_ms", *KEY, "window_start_ms")
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries that are started within keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER[0], before)


def _folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The folds of a batch of trades, in the columns of FOLD."""
    table = pa.Table.from_batches([batch]).sort_by("ord")
    wanted = [("price", "first"), ("ord", "min"), ("price", "max"), ("price", "min"), ("price", "last"), ("ord", "max"), ("code", "first"), ("base", "sum"), ("quote", "sum")]
    wanted += [("exact_base", "sum"), ("exact_quote", "sum"), ("exact_base", "count"), ("exact_quote", "count"), ([], "count_all")]
    found = table.group_by([*KEY, "window_start_ms"], use_threads=False).aggregate(wanted).to_pydict()
    count = found["count_all"]
    columns = {"open": "price_first", "first": "ord_min", "high": "price_max", "low": "price_min", "close": "price_last", "last": "ord_max", "code": "code_first", "base": "base_sum", "quote": "quote_sum"}
    out = {k: found[k] for k in (*KEY, "window_start_ms")} | {k: found[v] for k, v in columns.items()}
    for name in ("first", "last"):
        out[name] = [str(x) for x in out[name]]
    for name in ("exact_base", "exact_quote"):
        out[name] = [str(x) if n == every else None for x, n, every in zip(found[f"{name}_sum"], found[f"{name}_count"], count, strict=True)]
    out["trades"] = count
    kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    fields = [x.split() for x in FOLD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(out[n], kinds[k]) for n, k in fields], [n for n, _ in fields])


def folds(trades: DataFrame, interval_ms: int, per_exchange: bool = False) -> DataFrame:
    """Folds of the trades, several of a candle; batch or stream. Before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _folded(batch)

    amounts = volumes()
    exact = {k: F.col(k).try_cast("decimal(30,12)") for k in ("exact_base", "exact_quote")}
    per = F.col("exchange") if per_exchange else F.lit("")
    rows = trades.where(usable()).withColumns(amounts).withColumns({**exact, "per": per, "code": exchange_code(F.col("exchange")).cast("int"), "ord": order_key()})
    rows = rows.withColumn("window_start_ms", window_start(F.col("event_ts"), interval_ms))
    return rows.select(*KEY, "window_start_ms", "price", "code", "ord", "base", "quote", "exact_base", "exact_quote").mapInArrow(run, FOLD)


def _sum(a: str | None, b: str | None) -> str | None:
    if a is None or b is None:
        return None
    with localcontext() as exact:
        exact.prec = 100
        return str(Decimal(a) + Decimal(b))


def merge(a: tuple, b: tuple) -> tuple:
    """Two folds of a candle (in the order of NAMES) as one."""
    x, y = (dict(zip(NAMES, v, strict=True)) for v in (a, b))
    early, late = (x, y) if Decimal(x["first"]) <= Decimal(y["first"]) else (y, x)
    end = x if Decimal(x["last"]) >= Decimal(y["last"]) else y
    out = {"open": early["open"], "first": early["first"], "code": early["code"], "close": end["close"], "last": end["last"]}
    out |= {"high": max(x["high"], y["high"]), "low": min(x["low"], y["low"])} | {n: x[n] + y[n] for n in ("base", "quote", "trades")}
    out |= {n: _sum(x[n], y[n]) for n in ("exact_base", "exact_quote")}
    return tuple(out[n] for n in NAMES)


class OpenCandles(StatefulProcessor):
    """The open candles of an instrument, by interval and window."""

    def __init__(self, intervals_ms: Sequence[int]) -> None:
        self.intervals = tuple(intervals_ms)

    @staticmethod
    def row(kind: str, key: tuple, place: tuple[int, int], value: tuple) -> Row:
        return Row(kind=kind, interval_ms=place[0], per=key[0], instrument=key[1], window_start_ms=place[1], **dict(zip(NAMES, value, strict=True)))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "interval_ms bigint, window_start_ms bigint", VALUES)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        found: dict[tuple[int, int], tuple] = {}
        for row in rows:
            value = tuple(row[n] for n in NAMES)
            for interval in self.intervals:
                place = interval, row["window_start_ms"] - row["window_start_ms"] % interval
                found[place] = merge(found[place], value) if place in found else value
        for place, value in found.items():
            end = sum(place)
            if end <= timerValues.getCurrentWatermarkInMs():
                yield self.row("late", key, place, value)
                continue
            before = self.open.getValue(place)
            if before is None:
                # a timer is due when the watermark is beyond it
                self.handle.registerTimer(end - 1)
            self.open.updateValue(place, value if before is None else merge(tuple(before), value))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        end = expiredTimerInfo.getExpiryTimeInMs() + 1
        for interval in self.intervals:
            place = interval, end - interval
            if end % interval == 0 and (value := self.open.getValue(place)) is not None:
                yield self.row("closed", key, place, tuple(value))
                self.open.removeKey(place)

    def close(self) -> None:
        pass


def rolled(trades: DataFrame, intervals_ms: Sequence[int] = (5000,), per_exchange: bool = False) -> DataFrame:
    """EMITTED rows of streaming trades that have a watermark (operators.feeds.with_watermark, union_streams). Start it within rocksdb().

    Every interval must be a multiple of the shortest.
    """
    finest = min(intervals_ms)
    if any(i % finest for i in intervals_ms):
        raise ValueError("every interval must be a multiple of the smallest")
    grouped = folds(trades, finest, per_exchange).groupBy(*KEY)
    return grouped.transformWithState(OpenCandles(sorted(set(intervals_ms))), EMITTED, "append", "eventtime")


def open_candles(spark: SparkSession, checkpoint: str, operator: int = 0) -> DataFrame:
    """Rows of EMITTED, of kind `open`, for the open candles of the stream with that checkpoint, after its last micro-batch that is committed."""
    state = spark.read.format("statestore").option("stateVarName", "open").option("operatorId", operator).load(checkpoint)
    return state.select(F.lit("open").alias("kind"), "key.*", "user_map_key.*", "user_map_value.*").select(*[x.split()[0] for x in EMITTED.split(", ")])


def _volume(name: str) -> Column:
    return F.coalesce(F.col(f"exact_{name}").try_cast("decimal(38,12)").cast("double"), F.col(name)).alias(f"{name}_volume")


def candles_of(emitted: DataFrame, *extra: str) -> DataFrame:
    """Candles of folds, one of each, with other columns that are named."""
    return emitted.select(
        instrument_id(F.col("instrument")).alias("instrument_id"), "instrument", exchange_name(F.col("code")).alias("exchange"), "interval_ms",
        "window_start_ms", (F.col("window_start_ms") + F.col("interval_ms")).alias("window_end_ms"), "open", "high", "low", "close", _volume("base"), _volume("quote"), *extra,
    ).select(*CANDLE_COLUMNS, *extra)


def revised(emitted: DataFrame) -> DataFrame:
    """One fold of each candle of rows of EMITTED, late trades in it, and `late`, how many trades came late.

    A window whose first trade came late has a candle too.
    """
    order = lambda c: F.col(c).cast("decimal(38,0)")
    exact = lambda c: F.when(F.count(c) == F.count(F.lit(1)), F.try_sum(F.col(c).cast("decimal(30,12)"))).cast("string").alias(c)
    return emitted.groupBy(*CANDLE_KEY).agg(
        F.min_by("open", order("first")).alias("open"), F.min(order("first")).cast("string").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", order("last")).alias("close"), F.max(order("last")).cast("string").alias("last"), F.min_by("code", order("first")).alias("code"),
        F.sum("base").alias("base"), F.sum("quote").alias("quote"), exact("exact_base"), exact("exact_quote"), F.sum("trades").alias("trades"),
        F.sum(F.when(F.col("kind") == "late", F.col("trades")).otherwise(0)).alias("late"),
    )
