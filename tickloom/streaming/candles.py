"""Candles of a stream of trades, and where they go.

emit="closed": append mode; a candle is emitted once, when the watermark has passed its window.  Windows
that the stream ends in stay open.  emit="all": update mode; every trade's candle as it stands after each
micro-batch, so that a sink that upserts by key has the open ones too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codecs import exchange_code, exchange_name, instrument_id
from ..operators.candles import fold, order_key, usable, volumes
from ..operators.feeds import dedup_stream, with_watermark
from ..schemas import CANDLE, CANDLE_COLUMNS

MODES = {"closed": "append", "all": "update"}
#: In the metadata of a candle's exchange: whether it is part of the candle's key.
KEY = "candle_key"
STORED = "per string, batch bigint, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CANDLE)


def candles_stream(trades: DataFrame, interval_ms: int = 5000, delay: str = "10 seconds", per_exchange: bool = False, dedup: bool = False) -> DataFrame:
    """Windowed candles of streaming trades; the same values as operators.candles.windowed gives in batch.

    Trades of several feeds come from operators.feeds.union_streams, which watermarks each feed by itself.
    """
    rows = trades.where(usable())
    rows = dedup_stream(rows, delay) if dedup else with_watermark(rows, delay)
    keys = [F.window("event_time", f"{interval_ms} milliseconds").alias("w"), F.col("instrument"), *([F.col("code")] if per_exchange else [])]
    rows = rows.withColumns({"ord": order_key(), "code": exchange_code(F.col("exchange")), **volumes()})
    folded = rows.groupBy(*keys).agg(*fold(), *([] if per_exchange else [F.min_by("code", "ord").alias("code")]))
    return folded.select(
        instrument_id(F.col("instrument")).alias("instrument_id"), "instrument", exchange_name(F.col("code")).alias("exchange", metadata={KEY: per_exchange}), F.lit(interval_ms).cast("bigint").alias("interval_ms"),
        F.unix_millis("w.start").alias("window_start_ms"), F.unix_millis("w.end").alias("window_end_ms"), "open", "high", "low", "close", "base_volume", "quote_volume",
    )


def start(candles: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, emit: str = "closed", trigger: dict | None = None) -> StreamingQuery:
    """Hands each micro-batch's candles to sink(frame, batch id); restarting with the same checkpoint goes on where it was."""
    return candles.writeStream.outputMode(MODES[emit]).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(**(trigger or {"availableNow": True})).start()


def parquet_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each micro-batch in a folder of its own, which a repeated batch overwrites: exactly once. See compact()."""

    def write(frame: DataFrame, batch: int) -> None:
        per = F.col("exchange") if frame.schema["exchange"].metadata.get(KEY) else F.lit("")
        frame.withColumns({"per": per, "batch": F.lit(batch).cast("bigint")}).write.mode("overwrite").parquet(f"{path}/part={batch}")

    return write


def callback_sink(callback: Callable[[dict], None]) -> Callable[[DataFrame, int], None]:
    """Calls back once a candle on the driver, which all candles go through, partition by partition: for few candles."""

    def push(frame: DataFrame, _: int) -> None:
        for row in frame.toLocalIterator():
            callback(row.asDict())

    return push


def partition_sink(callback: Callable[[Iterator[dict]], None]) -> Callable[[DataFrame, int], None]:
    """Calls back once a partition of candles, on the executors; a task that is run again calls back again: see sinks.Push for once only."""

    def push(frame: DataFrame, _: int) -> None:
        frame.foreachPartition(lambda rows: callback(r.asDict() for r in rows))

    return push


def _last(rows: DataFrame) -> DataFrame:
    """Of each candle the last batch's. A consolidated candle's exchange may change while trades of its window come; its key doesn't."""
    key = ("per", "instrument", "window_start_ms")
    values = F.struct(*[c for c in CANDLE_COLUMNS if c not in key])
    return rows.groupBy(*key).agg(F.max_by(values, "batch").alias("v"), F.max("batch").alias("batch")).select(*key, "batch", "v.*")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)


def written(spark: SparkSession, path: str) -> DataFrame:
    """What parquet_sink wrote, the last batch of each candle counting."""
    return _last(_stored(spark, path)).select(*CANDLE_COLUMNS)


def compact(spark: SparkSession, path: str) -> None:
    """Folds the folders of all batches but the last, which may be written again, into one, so that reads don't fold all history.

    Reading in between is right: a candle that is there twice is there with the same batch.
    """
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    root = fs_path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = {s.getPath().getName().partition("=")[2]: s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("part=")}
    batches = sorted((n for n in found if n.isdigit()), key=int)[:-1]
    old = [found[n] for n in found if n in batches or not n.isdigit()]
    if len(old) < 2:
        return
    rows = spark.read.schema(STORED).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(*[p.toString() for p in old])
    # aside, where no reader looks, and then by a name that no compaction has had: one that stops anywhere loses nothing
    aside = fs_path(f"{path}/_compacting")
    _last(rows).write.mode("overwrite").parquet(aside.toString())
    fs.rename(aside, fs_path(f"{path}/part=to{batches[-1]}-{uuid.uuid4().hex}"))
    for p in old:
        fs.delete(p, True)
