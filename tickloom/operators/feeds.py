"""Several feeds as one, and repeated trades as one."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import TRADE_COLUMNS

KEYS = ("exchange", "instrument", "trade_id")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All trades of all feeds, with repeats and in no order."""
    return reduce(DataFrame.unionByName, [f.select(*TRADE_COLUMNS) for f in feeds])


def with_watermark(trades: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Streaming trades with event_time, watermarked; those that have it stay as they are."""
    if "event_time" in trades.columns:
        return trades
    return trades.withColumn("event_time", F.timestamp_millis("event_ts")).withWatermark("event_time", delay)


def union_streams(feeds: Mapping[str, DataFrame], delay: str = "10 seconds", delays: Mapping[str, str] | None = None) -> DataFrame:
    """All trades of streaming feeds, each watermarked by its own times: delay, or its own of delays.

    Spark takes the least of the watermarks (its default policy), so a feed that lags holds candles open until it has caught
    up, and none of its trades come late because another feed is ahead.  A feed that says nothing holds them too, and so does each feed
    after a restart until it says something: leave out feeds that are switched off.
    """
    own = dict(delays or {})
    if strange := own.keys() - feeds.keys():
        raise ValueError(f"delays of no feed: {sorted(strange)}")
    marked = [with_watermark(f.select(*TRADE_COLUMNS), own.get(name, delay)) for name, f in feeds.items()]
    if marked[0].sparkSession.conf.get("spark.sql.streaming.multipleWatermarkPolicy") != "min":
        raise ValueError("spark.sql.streaming.multipleWatermarkPolicy must be min, or a lagging feed's trades are lost")
    return reduce(DataFrame.unionByName, marked)


def dedup_trades(trades: DataFrame) -> DataFrame:
    """One trade for each exchange, instrument and id: the earliest by event time, then by receipt. Batch only.

    Without an id a trade can't repeat another.  Repeats are reduced before the shuffle, by hash: the order is one
    decimal of both times (null before all) and of a hash of the other values, so that ties are settled alike.
    """
    bound = 10**15 - 1
    time = lambda c: F.coalesce(F.least(F.greatest(F.col(c), F.lit(0)), F.lit(bound)), F.lit(0)).cast("decimal(15,0)")
    tie = F.pmod(F.xxhash64("event_ts", "recv_ts", "trade_ts", "price", "qty"), F.lit(10**7)).cast("decimal(7,0)")
    order = (time("event_ts") * F.lit(10**15).cast("decimal(16,0)") + time("recv_ts")) * F.lit(10**7).cast("decimal(8,0)") + tie
    rows = trades.where("trade_id is not null").withColumn("_order", order.cast("decimal(38,0)"))
    named = rows.groupBy(*KEYS).agg(*[F.min_by(c, "_order").alias(c) for c in TRADE_COLUMNS if c not in KEYS]).select(*TRADE_COLUMNS)
    return named.unionByName(trades.where("trade_id is null").select(*TRADE_COLUMNS))


def dedup_stream(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """As a stream comes: the first arrival of each key stays, for as long as the watermark keeps keys.

    trades: watermarked (with_watermark, union_streams), or not yet. State is bounded by time instead of a count.
    """
    return with_watermark(trades, delay).dropDuplicatesWithinWatermark(list(KEYS))
