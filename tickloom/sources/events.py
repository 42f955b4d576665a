"""Trades made from a table of events, for tests and benchmarks: no feed can be reached from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TRADE_COLUMNS

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def trades_of(events: DataFrame, *extra: str) -> DataFrame:
    """A trade of each event: exchange by id, instrument by user, price the value, quantity from props."""
    exchange = F.when(F.col("event_id") % 3 == 0, "BINANCE").when(F.col("event_id") % 3 == 1, "BYBIT").otherwise("OKX")
    user = F.col("user_id") % 4
    instrument = F.when(user == 0, "BTCUSDT").when(user == 1, "ETHUSDT").when(user == 2, "SOLUSDT").otherwise("DOGEUSDT")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    out = events.select(
        exchange.alias("exchange"), instrument.alias("instrument"), F.col("event_id").alias("trade_id"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"), ms.alias("event_ts"), ms.alias("trade_ts"), (ms + 5).alias("recv_ts"), *extra,
    )
    return out.select(*TRADE_COLUMNS, *extra)


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def trades(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return trades_of(read(spark, sf_dir), *extra)


def trades_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    return trades_of(reader.parquet(sf_dir))
