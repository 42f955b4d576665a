"""python -m tickloom --input=DIR --output=DIR --checkpoint=DIR [settings]: candles of landed messages, one folder a feed.

DIR/<exchange> holds the messages that were landed for each exchange of the settings (see config.Settings); an
exchange without a folder is passed over.  --emit=all upserts open candles too; --delay= is each feed's watermark's.  --live=yes
also lands the messages, from the exchanges' public feeds, and goes on until it is ended.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .config import Settings
from .operators import candles, parsers
from .operators.feeds import union_streams
from .session import session
from .sources.feeds import FEEDS, Feed, landing
from .sources.live import Lander, Session, connect, shared_writer
from .streaming import candles as streaming

OPTIONS = {"input": None, "output": None, "checkpoint": None, "emit": "closed", "delay": "10 seconds", "live": "no"}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def consolidated(spark: SparkSession, settings: Settings, path: str, delay: str) -> DataFrame:
    """Streaming candles of all feeds together, of the settings' instruments."""
    names = [x for x in settings.exchanges if x in FEEDS and _exists(spark, f"{path}/{x}")]
    if not names:
        raise ValueError(f"no folder of a known exchange in {path}")
    trades = union_streams({x: parsers.accepted(FEEDS[x].parse(landing(spark, f"{path}/{x}"))) for x in names}, delay)
    return streaming.candles_stream(candles.only(trades, settings.instruments), settings.interval_ms, dedup=True)


def landers(spark: SparkSession, settings: Settings, path: str, open_session: Callable[[Feed], Session] = connect) -> list[Lander]:
    """One for each known exchange of the settings, started."""
    made = [Lander(FEEDS[x], settings.instruments, shared_writer(spark, f"{path}/{x}"), open_session) for x in settings.exchanges if x in FEEDS]
    for lander in made:
        lander.start()
    return made


def start(spark: SparkSession, args: Sequence[str], open_session: Callable[[Feed], Session] = connect) -> StreamingQuery:
    settings = Settings.from_args(args).validate()
    options = OPTIONS | {k[2:]: v for k, eq, v in (a.partition("=") for a in settings.unknown) if eq and k[2:] in OPTIONS}
    if missing := [k for k, v in options.items() if not v]:
        raise ValueError(f"missing: {', '.join(f'--{k}=' for k in missing)}")
    live = options["live"] == "yes"
    if live:
        landers(spark, settings, options["input"], open_session)
    found = consolidated(spark, settings, options["input"], options["delay"])
    return streaming.start(found, streaming.parquet_sink(options["output"]), options["checkpoint"], options["emit"], {"processingTime": "1 second"} if live else None)


if __name__ == "__main__":
    start(session(), sys.argv[1:]).awaitTermination()
