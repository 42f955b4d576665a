"""One query per operator over the whole events table, read as trades; wire queries render messages and parse them back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, numbers, text
from ..operators import candles, feeds, parsers
from ..session import shared_path
from ..sources import events, replay
from ..sources.feeds import FEEDS, landing
from ..sources.segments import segments
from ..streaming import candles as streaming
from ..streaming import dedup, rollover, sinks

HOUR, DAY = 3_600_000, 86_400_000
SHOWN = ("exchange", "instrument", "trade_id", "price", "qty", "event_ts", "trade_ts")


def _of(spark: SparkSession, sf_dir: str, exchange: str, *extra: str) -> DataFrame:
    return events.trades(spark, sf_dir, *extra).where(F.col("exchange") == exchange)


def _json(**fields: Column | str) -> Column:
    """A JSON object as text; values are JSON already."""
    parts: list[Column] = []
    for i, (k, v) in enumerate(fields.items()):
        parts += [F.lit(("{" if not i else ",") + f'"{k}":'), F.lit(v) if isinstance(v, str) else v]
    return F.concat(*parts, F.lit("}"))


def _quoted(c: Column | str) -> Column:
    return F.concat(F.lit('"'), (F.col(c) if isinstance(c, str) else c).cast("string"), F.lit('"'))


def _number(c: str) -> Column:
    return F.col(c).cast("string")


def _binance(kind: Column | None = None, symbol: Column | None = None) -> Column:
    e = F.lit('"trade"') if kind is None else _quoted(kind)
    return _json(e=e, E=_number("event_ts"), s=_quoted("instrument") if symbol is None else _quoted(symbol), t=_number("trade_id"), p=_quoted("price"), q=_quoted("qty"), T=_number("trade_ts"), m="false", M="true")


def _combined() -> Column:
    return _json(stream=_quoted(F.concat(F.lower("instrument"), F.lit("@trade"))), data=_binance())


def parse_binance_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.accepted(parsers.binance(_of(spark, sf_dir, "BINANCE").select(_combined().alias("value")))).select(*SHOWN)


def parse_binance_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "aggTrade").otherwise("trade")
    raw = _of(spark, sf_dir, "BINANCE", "event_type").select(_binance(kind, F.lower("instrument")).alias("value"))
    return parsers.accepted(parsers.binance_raw(raw)).select(*SHOWN)


def _bybit_messages(trades: DataFrame) -> DataFrame:
    """One message for each instrument and hour."""
    item = _json(i=_quoted("trade_id"), T=_number("trade_ts"), p=_quoted("price"), v=_quoted("qty"), S='"Sell"', seq="1", s=_quoted("instrument"), BT="false")
    grouped = trades.groupBy("instrument", numbers.window_start(F.col("event_ts"), HOUR).alias("hour")).agg(F.max("event_ts").alias("ts"), F.array_join(F.collect_list(item), ",").alias("items"))
    return grouped.select(_json(topic=_quoted(F.concat(F.lit("publicTrade."), "instrument")), ts=_number("ts"), type='"snapshot"', data=F.concat(F.lit("["), "items", F.lit("]"))).alias("value"))


def parse_bybit_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.accepted(parsers.bybit(_bybit_messages(_of(spark, sf_dir, "BYBIT")))).select(*SHOWN)


def parse_bybit_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.accepted(parsers.bybit_provider(_bybit_messages(_of(spark, sf_dir, "BYBIT")))).select(*SHOWN)


def _okx_message(channel: Column) -> Column:
    item = _json(instId=_quoted(codecs.okx_of_symbol(F.col("instrument"))), tradeId=_quoted("trade_id"), px=_quoted("price"), sz=_quoted("qty"), ts=_quoted("trade_ts"))
    return F.concat(F.lit("{"), channel, F.lit('"data":['), item, F.lit("]}"))


def parse_okx(spark: SparkSession, sf_dir: str) -> DataFrame:
    channel = F.when(F.col("trade_id") % 2 == 0, '"arg":{"channel":"trades"},').otherwise("")
    return parsers.accepted(parsers.okx(_of(spark, sf_dir, "OKX").select(_okx_message(channel).alias("value")))).select(*SHOWN)


def reject_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by feed and outcome of messages that are spoilt in one way or another by trade_id."""
    k = F.pmod(F.floor(F.col("trade_id") / 3), F.lit(8))
    spoilt = (
        F.when(k == 0, "nope").when(k == 1, "[]").when(k == 2, '{"stream":"x"}').when(k == 3, F.replace(_combined(), F.lit('"p":"'), F.lit('"p":"x')))
        .when(k == 4, F.replace(_combined(), F.lit('"q":'), F.lit('"w":'))).when(k == 5, F.replace(_combined(), F.lit('"t":'), F.lit('"t":1844674407370955161')))
        .otherwise(_combined())
    )
    first = parsers.binance(_of(spark, sf_dir, "BINANCE").select(spoilt.alias("value"))).select(F.lit("binance").alias("feed"), "reject")
    item = _json(i=_quoted("trade_id"), T=_number("trade_ts"), p=_quoted("price"), v=_quoted("qty"))
    message = lambda items: _json(topic=_quoted(F.concat(F.lit("publicTrade."), "instrument")), ts=_number("event_ts"), type='"snapshot"', data=items)
    spoilt = (
        F.when(k == 0, message(F.concat(F.lit("["), item, F.lit(",3]")))).when(k == 1, message(F.lit("{}"))).when(k == 2, message(F.concat(F.lit("["), F.replace(item, F.lit('"T":'), F.lit('"x":')), F.lit("]"))))
        .when(k == 3, message(F.concat(F.lit("["), item, F.lit(","), F.replace(item, F.lit('"p":"'), F.lit('"p":"nan')), F.lit("]")))).otherwise(message(F.concat(F.lit("["), item, F.lit("]"))))
    )
    second = parsers.bybit(_of(spark, sf_dir, "BYBIT").select(spoilt.alias("value"))).select(F.lit("bybit").alias("feed"), "reject")
    channel = F.when(k == 0, '"arg":{"channel":"books"},').when(k == 1, '"arg":{},').otherwise("")
    spoilt = F.when(k == 2, '{"event":"subscribe"}').when(k == 3, F.replace(_okx_message(channel), F.lit('"px":"'), F.lit('"px":"+'))).otherwise(_okx_message(channel))
    third = parsers.okx(_of(spark, sf_dir, "OKX").select(spoilt.alias("value"))).select(F.lit("okx").alias("feed"), "reject")
    every = first.unionByName(second).unionByName(third)
    return every.groupBy("feed", F.coalesce("reject", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def symbol_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = events.trades(spark, sf_dir).select(F.col("instrument").alias("name")).distinct()
    names = names.unionByName(names.select(F.concat(F.lower("name"), F.lit("USDT")).alias("name"))).unionByName(events.trades(spark, sf_dir).select(F.col("exchange").alias("name")).distinct())
    name = F.col("name")
    return names.select(
        "name", codecs.instrument_id(name).cast("int").alias("instrument_id"), codecs.instrument_name(codecs.instrument_id(name)).alias("instrument_name"),
        codecs.exchange_code(name).cast("int").alias("exchange_code"), codecs.exchange_name(codecs.exchange_code(name)).alias("exchange_name"),
        codecs.okx_of_symbol(name).alias("okx_id"), codecs.symbol_of_okx(codecs.okx_of_symbol(name)).alias("from_okx"), F.upper(name).alias("upper_name"), F.lower(name).alias("lower_name"),
        codecs.symbol_of_topic(F.concat(F.lit("x.publicTrade."), name)).alias("topic_symbol"), codecs.symbol_of_topic(name).alias("no_topic"),
    )


def subscribe_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = events.trades(spark, sf_dir).agg(F.sort_array(F.collect_set("instrument")).alias("symbols"))
    each = symbols.select("symbols", F.explode(F.array(*map(F.lit, ("binance", "bybit", "okx")))).alias("feed"))
    message = F.when(F.col("feed") == "binance", text.subscribe_column("binance", F.col("symbols"))).when(F.col("feed") == "bybit", text.subscribe_column("bybit", F.col("symbols"))).otherwise(text.subscribe_column("okx", F.col("symbols")))
    return each.select("feed", message.alias("message"))


def reconnect_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the schedule's attempts, how often each would be made if a feed were down from every hour's start to its first trade, by instrument."""
    hour = numbers.window_start(F.col("event_ts"), HOUR).alias("hour")
    quiet = events.trades(spark, sf_dir).groupBy("exchange", "instrument", hour).agg(F.min("event_ts").alias("first")).select((F.col("first") - F.col("hour")).alias("quiet"))
    each = quiet.select("quiet", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("attempt"))
    until = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("attempt")), F.lit(0).cast("long"), lambda total, k: total + numbers.reconnect_delay_ms(k).cast("long"))
    return each.where(until <= F.col("quiet")).groupBy("attempt", numbers.reconnect_delay_ms(F.col("attempt")).alias("delay_ms")).agg(F.count(F.lit(1)).alias("made"))


def split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.trades(spark, sf_dir, "event_type")
    joined = F.concat("event_type", F.lit(","), F.when(F.col("trade_id") % 3 == 0, "").otherwise(F.col("instrument")), F.when(F.col("trade_id") % 2 == 0, ",").otherwise(""))
    tokens = rows.select("trade_id", F.posexplode(text.split_column(joined)).alias("pos", "token"))
    return tokens.select("trade_id", "pos", "token")


def union_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.union_feeds(*(_of(spark, sf_dir, x) for x in codecs.EXCHANGES))


def replay_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades written as captures, each message over several lines, then split and parsed."""
    path = shared_path(spark, "captures")
    pretty = F.replace(F.replace(_combined(), F.lit('"data":{'), F.lit('\n  "data":\n  {')), F.lit(',"s"'), F.lit(',\n  "s"'))
    _of(spark, sf_dir, "BINANCE").select(F.concat(F.lit("# a line without braces\n"), pretty).alias("value")).write.option("maxRecordsPerFile", 100_000).text(path)
    return parsers.accepted(parsers.binance(replay.json_objects(spark, path))).select(*SHOWN)


def candles_alltime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.all_time(events.trades(spark, sf_dir), HOUR)


def candles_windowed_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.windowed(events.trades(spark, sf_dir), HOUR, per_exchange=True)


def candles_consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.windowed(events.trades(spark, sf_dir), HOUR)


def candles_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.windowed(candles.only(events.trades(spark, sf_dir), ["BTCUSDT", "SOLUSDT"]), DAY)


def candles_multi_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.multi_interval(events.trades(spark, sf_dir), [HOUR, 4 * HOUR, DAY])


def running_candle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.running(events.trades(spark, sf_dir), HOUR)


def dedup_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.trades(spark, sf_dir)
    # each trade again, received later, and with the same id on another exchange
    again = rows.withColumn("recv_ts", F.col("recv_ts") + 7)
    other = rows.withColumn("exchange", F.when(F.col("exchange") == "OKX", "BYBIT").otherwise("OKX"))
    return feeds.dedup_trades(rows.unionByName(again).unionByName(other))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candles.counters(events.trades(spark, sf_dir), HOUR)


def _streamed(spark: SparkSession, trades: DataFrame, emit: str, **options: bool) -> DataFrame:
    path = shared_path(spark, "stream")
    found = streaming.candles_stream(trades, HOUR, "2 hours", **options)
    query = streaming.start(found, streaming.parquet_sink(f"{path}/out"), f"{path}/checkpoint", emit)
    query.awaitTermination()
    return streaming.written(spark, f"{path}/out")


def candles_stream_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, events.trades_stream(spark, sf_dir), "all")


def candles_stream_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, events.trades_stream(spark, sf_dir), "closed")


def candles_stream_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed(spark, events.trades_stream(spark, sf_dir), "all", per_exchange=True)


def candle_callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed candles pushed to an inbox, each delivered once, and counted there."""
    path = shared_path(spark, "callbacks")
    spark.dataSource.register(sinks.Push)
    found = streaming.candles_stream(events.trades_stream(spark, sf_dir), HOUR, "2 hours")
    query = found.writeStream.format("push").option("path", f"{path}/inbox").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()
    got = sinks.delivered(spark, f"{path}/inbox", "instrument string, window_start_ms bigint")
    return got.agg(F.count(F.lit(1)).alias("candles"), F.coalesce(F.sum(F.expr(f"window_start_ms div {HOUR}")), F.lit(0)).alias("hours"))


def _messages(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Raw messages of each feed: some spoilt, some of another kind, and every trade twice."""
    twice = lambda rows: rows.withColumn("again", F.explode(F.array(F.lit(0), F.lit(1))))
    spoilt = F.col("trade_id") % 50 == 0
    # each is rendered once, before it is repeated
    binance = twice(_of(spark, sf_dir, "BINANCE").select(F.when(spoilt, "nope").otherwise(_binance(symbol=F.lower("instrument"))).alias("value"))).select("value")
    bybit = twice(_bybit_messages(_of(spark, sf_dir, "BYBIT").where(~spoilt))).select("value")
    books = _of(spark, sf_dir, "BYBIT").select(_json(topic=_quoted(F.concat(F.lit("orderbook.1."), "instrument")), ts=_number("event_ts"), type='"snapshot"', data="[]").alias("value"))
    okx = twice(_of(spark, sf_dir, "OKX").select(F.when(spoilt, F.replace(_okx_message(F.lit("")), F.lit('"px":"'), F.lit('"px":"x'))).otherwise(_okx_message(F.lit('"arg":{"channel":"trades"},'))).alias("value"))).select("value")
    return {"binance": binance, "bybit": bybit.unionByName(books), "okx": okx}


def feed_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw messages to candles: each feed parsed and rid of rejects, united, rid of repeats, folded."""
    parsed = [parsers.accepted(FEEDS[name].parse(raw)) for name, raw in _messages(spark, sf_dir).items()]
    return candles.windowed(feeds.dedup_trades(feeds.union_feeds(*parsed)), HOUR)


def feed_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the same messages are rejected for, with whether a receipt is stamped."""
    parsed = [FEEDS[name].parse(raw).select(F.lit(name).alias("feed"), F.coalesce("reject", F.lit("accepted")).alias("outcome"), "recv_ts") for name, raw in _messages(spark, sf_dir).items()]
    every = parsed[0].unionByName(parsed[1]).unionByName(parsed[2])
    return every.groupBy("feed", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("recv_ts") > 0).alias("stamped"))


def _landed_feeds(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: parsers.accepted(FEEDS[name].parse(landing(spark, f"{path}/{name}/*", None))) for name in FEEDS}


def feed_candles_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of landed messages, in two runs: the second brings all messages again and, later than the watermark allows, new trades."""
    path = shared_path(spark, "landing")
    for name, raw in _messages(spark, sf_dir).items():
        raw.write.text(f"{path}/{name}/first")

    def run() -> None:
        # ids by the million: the default provider would hold them all in the executors' heaps
        with rollover.rocksdb(spark):
            found = streaming.candles_stream(feeds.union_streams(_landed_feeds(spark, path), "2 hours"), HOUR, dedup=True)
            query = streaming.start(found, streaming.parquet_sink(f"{path}/out"), f"{path}/checkpoint", "all")
        query.awaitTermination()

    run()
    for name in FEEDS:
        spark.read.text(f"{path}/{name}/first").write.text(f"{path}/{name}/second")
    # ids that no trade has, at the earliest time
    earliest = events.trades(spark, sf_dir).agg(F.min("trade_ts")).first()[0]
    late = _of(spark, sf_dir, "BINANCE").withColumns({"trade_id": F.col("trade_id") + 10**9, "trade_ts": F.lit(earliest), "price": F.col("price") + 1})
    late.select(_binance(symbol=F.lower("instrument")).alias("value")).write.text(f"{path}/binance/third")
    run()
    return streaming.written(spark, f"{path}/out")


def stream_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages of a stream were parsed and rejected, by reason, as a listener is told."""
    path = shared_path(spark, "counters")
    for name, raw in _messages(spark, sf_dir).items():
        raw.write.text(f"{path}/{name}/first")
    parsed = [FEEDS[name].parse(landing(spark, f"{path}/{name}/*", None)).select("exchange", "reject") for name in FEEDS]
    counters = sinks.Counters()
    spark.streams.addListener(counters)
    try:
        every = sinks.observed(parsed[0].unionByName(parsed[1]).unionByName(parsed[2]))
        every.writeStream.format("noop").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        counters.wait()
    finally:
        spark.streams.removeListener(counters)
    return spark.createDataFrame(sorted(counters.totals.items()), "outcome string, n bigint")


def feed_candles_lagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of three feeds of which one is days behind: its second half comes when the others are through, and is in time by its own watermark."""
    path = shared_path(spark, "lagging")
    messages = _messages(spark, sf_dir)
    half = events.trades(spark, sf_dir).agg((F.min("event_ts") + (F.max("event_ts") - F.min("event_ts")) / 2).cast("bigint")).first()[0]
    okx = _of(spark, sf_dir, "OKX").where("trade_id % 50 <> 0")
    parts = [okx.where(F.col("event_ts") < half), okx.where(F.col("event_ts") >= half)]
    for name in ("binance", "bybit"):
        messages[name].write.text(f"{path}/{name}/first")
    for part, rows in zip(("first", "second"), parts, strict=True):
        rows.select(_okx_message(F.lit('"arg":{"channel":"trades"},')).alias("value")).write.text(f"{path}/okx/{part}")
        found = streaming.candles_stream(feeds.union_streams(_landed_feeds(spark, path), "2 hours"), HOUR, dedup=True)
        streaming.start(found, streaming.parquet_sink(f"{path}/out"), f"{path}/checkpoint", "all").awaitTermination()
    return streaming.written(spark, f"{path}/out")


def live_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades of landed segments, through a source that frees them, in two runs of one query: every message once."""
    path = shared_path(spark, "segments")
    for run, even in enumerate((0, 1)):
        for name, exchange in (("binance", "BINANCE"), ("okx", "OKX")):
            rows = _of(spark, sf_dir, exchange).where(F.col("trade_id") % 2 == even)
            message = _binance(symbol=F.lower("instrument")) if name == "binance" else _okx_message(F.lit(""))
            rows.select(message.alias("value")).write.text(f"{path}/in/{name}/{run}")
        raw = segments(spark, f"{path}/in")
        parsed = [parsers.accepted(FEEDS[name].parse(raw.where(F.col("feed") == name).select("value"))) for name in ("binance", "okx")]
        query = feeds.union_feeds(*parsed).select(*SHOWN).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


def _rolled(spark: SparkSession, path: str, trades: DataFrame, *intervals: int) -> DataFrame:
    """What a run of the stream of trades, whose state is in the path, has emitted there so far."""
    with rollover.rocksdb(spark):
        found = rollover.rolled(feeds.with_watermark(trades, "2 hours"), intervals).writeStream.format("parquet").option("path", f"{path}/out")
        query = found.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


def candles_rollover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles as the stream completed them, and those that are flushed when it stops, from its state."""
    path = shared_path(spark, "rollover")
    closed = _rolled(spark, path, events.trades_stream(spark, sf_dir), HOUR)
    return rollover.candles_of(closed.unionByName(rollover.open_candles(spark, f"{path}/checkpoint")), "kind")


def candles_multi_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for several intervals, of one shuffle of folds."""
    path = shared_path(spark, "intervals")
    closed = _rolled(spark, path, events.trades_stream(spark, sf_dir), HOUR, 4 * HOUR, DAY)
    return rollover.candles_of(closed.unionByName(rollover.open_candles(spark, f"{path}/checkpoint")))


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open candles of a stream, out of its checkpoint: what it would emit next."""
    path = shared_path(spark, "snapshot")
    _rolled(spark, path, events.trades_stream(spark, sf_dir), DAY)
    return rollover.candles_of(rollover.open_candles(spark, f"{path}/checkpoint"))


def candles_revised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles of a stream whose every tenth trade comes when all others have: completed ones revised by late trades, and open ones."""
    path = shared_path(spark, "revised")
    for run, share in enumerate((F.col("event_id") % 10 > 0, F.col("event_id") % 10 == 0)):
        events.read(spark, sf_dir).where(share).write.parquet(f"{path}/in/{run}")
        stream = spark.readStream.schema(events.EVENTS).parquet(f"{path}/in/*")
        emitted = _rolled(spark, path, events.trades_of(stream), HOUR)
    still = rollover.open_candles(spark, f"{path}/checkpoint")
    return rollover.candles_of(rollover.revised(emitted.unionByName(still)), "trades", "late")


def dedup_counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades twice, one after the other, and all again in a second run, from the last to the first, past a memory of 500 ids: what is forgotten by then comes again."""
    path = shared_path(spark, "counted")
    for run in range(2):
        events.read(spark, sf_dir).write.parquet(f"{path}/in/{run}")
        rows = events.trades_of(spark.readStream.schema(events.EVENTS).parquet(f"{path}/in/*"))
        received = F.col("recv_ts") if run == 0 else 4 * 10**12 - F.col("recv_ts")
        twice = rows.withColumns({"trade_id": F.explode(F.array("trade_id", "trade_id")), "recv_ts": received})
        with rollover.rocksdb(spark):
            found = dedup.dedup_counted(twice, 500, 4).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint")
            query = found.trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        parse_binance_combined, parse_binance_raw, parse_bybit_snapshot, parse_bybit_provider, parse_okx, reject_malformed, symbol_codecs, subscribe_messages, reconnect_schedule, split_list, union_feeds,
        replay_objects, candles_alltime, candles_windowed_exchange, candles_consolidated, candles_universe, candles_multi_interval, running_candle, dedup_trades, run_counters, candles_stream_all, candles_stream_closed,
        candles_stream_exchange, candle_callbacks, feed_candles, feed_rejects, feed_candles_stream, feed_candles_lagging, live_segments,
        stream_counters, candles_rollover, candles_multi_stream, stream_snapshot, candles_revised, dedup_counted_stream,
    )
}
