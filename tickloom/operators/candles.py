"""Trades folded into candles.

Trades in a frame have no order of arrival.  Open and close follow a total order: event time, then trade
id, then exchange; or, to replay a capture, a column that numbers arrivals.  The order is one decimal, so
that min_by and max_by keep fixed-width state and Spark aggregates by hash, before and after the shuffle: an
instrument with most of the trades costs each task one row.

Volumes are summed as decimals, which makes them the same in any partitioning.  Prices keep 10 decimals in them and
quantities 12; where one is too large for its decimal or has more digits than that, or a sum is too large for its own, that
candle's volume is the sum of doubles.  exact=False sums doubles only.

Event times of more than 15 digits (in ms: after the year 30000) aren't times; such trades are passed over, as
those without price, quantity or time are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.codecs import exchange_code, exchange_name, instrument_id
from ..functions.numbers import notional, window_start
from ..schemas import CANDLE_COLUMNS
from ..session import shared_path

#: Of prices and quantities in exact sums; their product is a decimal(38,12).
PRICE, QTY = "decimal(20,10)", "decimal(27,12)"
MAX_TIME = 10**15 - 1


def order_key(seq: str | None = None) -> Column:
    """(event_ts, trade_id, exchange) as one decimal, or the arrival number."""
    if seq:
        return F.col(seq).cast("decimal(38,0)")
    scale = F.lit(str(10**20)).cast("decimal(21,0)")
    ms = F.col("event_ts").cast("decimal(18,0)") * scale + F.coalesce(F.col("trade_id"), F.lit(0)).cast("decimal(20,0)")
    return (ms * F.lit(10) + exchange_code(F.col("exchange")).cast("decimal(2,0)") + F.lit(1)).cast("decimal(38,0)")


def usable() -> Column:
    """Whether a trade can be folded."""
    return F.col("price").isNotNull() & F.col("qty").isNotNull() & F.coalesce(F.col("event_ts").between(-MAX_TIME, MAX_TIME), F.lit(False))


def volumes(exact: bool = True) -> dict[str, Column]:
    """base and quote of a trade as doubles and, if exact, as decimals, null where they don't fit or would be rounded."""
    found = {"base": F.col("qty"), "quote": notional(F.col("price"), F.col("qty"))}
    if exact:
        price, qty = (F.when(F.col(c).try_cast(kind).cast("double") == F.col(c), F.col(c).try_cast(kind)) for c, kind in (("price", PRICE), ("qty", QTY)))
        found |= {"exact_base": qty, "exact_quote": F.try_multiply(price, qty)}
    return found


def _whole(name: str) -> Column:
    """The decimal sum if every term is there and it fits."""
    return F.when(F.count(name) == F.count(F.lit(1)), F.try_sum(name))


def total(name: str, exact: bool = True) -> Column:
    return F.coalesce(_whole(f"exact_{name}").cast("double"), F.sum(name)) if exact else F.sum(name)


def _ready(trades: DataFrame, interval_ms: int, seq: str | None, exact: bool) -> DataFrame:
    amounts = [c.alias(k) for k, c in volumes(exact).items()]
    return trades.where(usable()).select("instrument", exchange_code(F.col("exchange")).alias("code"), "price", *amounts, window_start(F.col("event_ts"), interval_ms).alias("bucket"), order_key(seq).alias("ord"), "event_ts")


def fold(exact: bool = True) -> list[Column]:
    return [
        F.min_by("price", "ord").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ord").alias("close"),
        total("base", exact).alias("base_volume"),
        total("quote", exact).alias("quote_volume"),
    ]


def _shaped(folded: DataFrame, interval_ms: Column) -> DataFrame:
    out = folded.withColumn("instrument_id", instrument_id(F.col("instrument"))).withColumn("exchange", exchange_name(F.col("code"))).withColumn("interval_ms", interval_ms.cast("bigint"))
    return out.select(*CANDLE_COLUMNS)


def only(trades: DataFrame, instruments: Sequence[str] | None) -> DataFrame:
    """Trades of the named instruments; all if none are named."""
    return trades.where(F.col("instrument").isin(*instruments)) if instruments else trades


def all_time(trades: DataFrame, interval_ms: int = 5000, seq: str | None = None, exact: bool = True) -> DataFrame:
    """One candle an instrument, which never rolls over: its start is the first trade's window, its end 0."""
    rows = _ready(trades, interval_ms, seq, exact)
    folded = rows.groupBy("instrument").agg(*fold(exact), F.min_by("code", "ord").alias("code"), F.min_by("bucket", "ord").alias("window_start_ms"))
    return _shaped(folded.withColumn("window_end_ms", F.lit(0).cast("bigint")), F.lit(interval_ms))


def windowed(trades: DataFrame, interval_ms: int = 5000, per_exchange: bool = False, seq: str | None = None, exact: bool = True) -> DataFrame:
    """One candle an instrument and window; per exchange, or consolidated with the first trade's exchange."""
    rows = _ready(trades, interval_ms, seq, exact)
    if per_exchange:
        folded = rows.groupBy("instrument", "code", F.col("bucket").alias("window_start_ms")).agg(*fold(exact))
    else:
        folded = rows.groupBy("instrument", F.col("bucket").alias("window_start_ms")).agg(*fold(exact), F.min_by("code", "ord").alias("code"))
    return _shaped(folded.withColumn("window_end_ms", F.col("window_start_ms") + F.lit(interval_ms)), F.lit(interval_ms))


def multi_interval(trades: DataFrame, intervals_ms: Sequence[int], exact: bool = True) -> DataFrame:
    """Consolidated candles of several intervals, each a multiple of the first, in one pass over the trades.

    The finest candles are folded from trades; coarser ones from those, so trades are shuffled once.
    """
    finest, *others = sorted(set(intervals_ms))
    if any(i % finest for i in others):
        raise ValueError("every interval must be a multiple of the smallest")
    rows = _ready(trades, finest, None, exact)
    sums = [x for c in ("base", "quote") for x in (F.sum(c).alias(c), *([_whole(f"exact_{c}").alias(f"exact_{c}")] if exact else []))]
    fine = rows.groupBy("instrument", "bucket").agg(
        F.min_by("price", "ord").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ord").alias("close"),
        *sums, F.min_by("code", "ord").alias("code"), F.min("ord").alias("first"), F.max("ord").alias("last"),
    )
    each = fine.withColumn("interval", F.explode(F.array(*[F.lit(i).cast("bigint") for i in (finest, *others)])))
    folded = each.groupBy("instrument", "interval", (F.col("bucket") - F.col("bucket") % F.col("interval")).alias("window_start_ms")).agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"),
        total("base", exact).alias("base_volume"), total("quote", exact).alias("quote_volume"), F.min_by("code", "first").alias("code"),
    )
    return _shaped(folded.withColumn("window_end_ms", F.col("window_start_ms") + F.col("interval")), F.col("interval"))


#: Trades of a chunk of running().
CHUNK_ROWS = 200_000


def chunked(trades: DataFrame, chunk_rows: int, path: str) -> DataFrame:
    """Trades with their order key and `chunk`: ranges of (instrument, order key) of about so many rows, whatever their times, in order.

    They are written to path, so that a chunk's number stays the same whenever it is read.
    """
    rows = trades.where(usable()).withColumn("ord", order_key())
    n = max(1, -(-rows.count() // chunk_rows))
    rows.repartitionByRange(n, "instrument", "ord").withColumn("chunk", F.spark_partition_id()).write.parquet(path)
    return trades.sparkSession.read.parquet(path)


def running(trades: DataFrame, interval_ms: int = 5000, chunk_rows: int = CHUNK_ROWS, exact: bool = True, path: str | None = None) -> DataFrame:
    """The all-time candle as it stands after each trade: trade_id, exchange and event_ts of the trade, then the candle's values.

    One window over an instrument's whole history would be one task.  Histories are cut into chunks of counted rows,
    so that an instrument with most of its trades in one second costs no task more than another: values run within a chunk, and each
    chunk starts from a prefix of the folds of those before it.  path: where the chunks are written; a folder of their own by default.
    """
    amounts = volumes(exact)
    cut = chunked(trades, chunk_rows, path or shared_path(trades.sparkSession, "running"))
    rows = cut.select("instrument", "chunk", "trade_id", "exchange", "event_ts", "price", "ord", window_start(F.col("event_ts"), interval_ms).alias("bucket"), exchange_code(F.col("exchange")).alias("code"), *[c.alias(k) for k, c in amounts.items()])
    first = F.struct("price", "code", "bucket")
    folded = rows.groupBy("instrument", "chunk").agg(
        F.min_by("price", "ord").alias("open"), F.min_by("code", "ord").alias("code"), F.min_by("bucket", "ord").alias("bucket"), F.max("price").alias("high"), F.min("price").alias("low"),
        *[(_whole(k) if k.startswith("exact") else F.sum(k)).alias(k) for k in amounts],
    )

    def sums(w: WindowSpec, tag: str) -> list[Column]:
        return [(F.when(F.count(k).over(w) == F.count(F.lit(1)).over(w), F.try_sum(k).over(w)) if k.startswith("exact") else F.sum(k).over(w)).alias(k + tag) for k in amounts]

    before = Window.partitionBy("instrument").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = folded.select(
        "instrument", "chunk", F.first(F.struct(F.col("open").alias("price"), "code", "bucket")).over(before).alias("first0"),
        F.max("high").over(before).alias("high0"), F.min("low").over(before).alias("low0"), *sums(before, "0"),
    )
    within = Window.partitionBy("instrument", "chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.select("instrument", "chunk", "trade_id", "exchange", "event_ts", F.col("price").alias("close"), F.first(first).over(within).alias("first1"), F.max("price").over(within).alias("high1"), F.min("price").over(within).alias("low1"), *sums(within, "1"))
    both = own.join(carried, ["instrument", "chunk"])
    start = F.coalesce("first0", "first1")

    def upto(name: str) -> Column:
        plain = F.coalesce(f"{name}0", F.lit(0.0)) + F.col(f"{name}1")
        # the first chunk has none before it; a later one's sum is null if it isn't exact
        return F.coalesce(F.when(F.col("first0").isNull(), F.col(f"exact_{name}1")).otherwise(F.try_add(f"exact_{name}0", f"exact_{name}1")).cast("double"), plain) if exact else plain

    return both.select(
        "instrument", "trade_id", "exchange", "event_ts", start["bucket"].alias("window_start_ms"), start["price"].alias("open"),
        F.greatest("high0", "high1").alias("high"), F.least("low0", "low1").alias("low"), "close",
        upto("base").alias("base_volume"), upto("quote").alias("quote_volume"), exchange_name(start["code"]).alias("candle_exchange"),
    )


def counters(trades: DataFrame, interval_ms: int, per_exchange: bool = False) -> DataFrame:
    """trades_processed and candles_emitted of windowed(), in one row, from one scan."""
    keys = [window_start(F.col("event_ts"), interval_ms).alias("bucket"), F.col("instrument"), *([exchange_code(F.col("exchange")).alias("code")] if per_exchange else [])]
    each = trades.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(usable()).alias("candle"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("trades_processed"), F.count_if("candle").alias("candles_emitted"))
