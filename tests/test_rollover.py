import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import candles
from tickloom.operators.feeds import union_streams, with_watermark
from tickloom.schemas import TRADE
from tickloom.streaming import candles as streaming
from tickloom.streaming import rollover


def trade(i, ts, price=1.0, qty=1.0, instrument="BTCUSDT", exchange="BINANCE"):
    return (exchange, instrument, i, price, qty, ts, ts, ts)


def land(spark, path, rows):
    spark.createDataFrame(rows, TRADE).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema(TRADE).parquet(path)


def run(spark, tmp_path, per_exchange=False, intervals=(5000,)):
    with rollover.rocksdb(spark):
        found = rollover.rolled(with_watermark(stream(spark, f"file://{tmp_path}/in"), "2 seconds"), intervals, per_exchange)
        query = found.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out"), rollover.open_candles(spark, f"file://{tmp_path}/checkpoint")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_completes_revises_and_flushes(spark, tmp_path):
    land(spark, f"file://{tmp_path}/in", [trade(1, 1000, 10.0), trade(2, 4999, 12.0), trade(3, 5000, 9.0), trade(4, 12000, 11.0)])
    emitted, still = run(spark, tmp_path)
    # the watermark ends at 10000: the window that ends there is complete
    assert {(r.kind, r.window_start_ms, r.trades) for r in emitted.collect()} == {("closed", 0, 2), ("closed", 5000, 1)}
    assert [(r.window_start_ms, r.trades) for r in still.collect()] == [(10000, 1)]
    # late for two windows, of which one had no trade of that instrument; in time for the open one
    late = [trade(5, 500, 20.0), trade(6, 600, 3.0, instrument="ETHUSDT"), trade(7, 11000, 1.0), trade(8, 2000, 0.5)]
    land(spark, f"file://{tmp_path}/in", late)
    emitted, still = run(spark, tmp_path)
    assert sorted((r.instrument, r.window_start_ms, r.trades) for r in emitted.where("kind = 'late'").collect()) == [("BTCUSDT", 0, 2), ("ETHUSDT", 0, 1)]
    revised = rollover.revised(emitted)
    assert {(r.instrument, r.window_start_ms): r.late for r in revised.collect()} == {("BTCUSDT", 0): 2, ("BTCUSDT", 5000): 0, ("ETHUSDT", 0): 1}
    batch = candles.windowed(spark.read.parquet(f"file://{tmp_path}/in"), 5000)
    assert rows_of(rollover.candles_of(rollover.revised(emitted.unionByName(still)))) == rows_of(batch)


@pytest.mark.parametrize("per_exchange", [False, True])
def test_equals_batch_whatever_the_order(spark, tmp_path, per_exchange):
    rng = random.Random(per_exchange)
    trades = [trade(i, rng.randrange(60_000), rng.randrange(1, 9999) / 100, rng.choice([0.1, 1e-7, 3.0, 1e20]), rng.choice(["BTCUSDT", "ETHUSDT"]), rng.choice(["OKX", "BYBIT"])) for i in range(300)]
    trades += [("OKX", "BTCUSDT", None, 1.0, 1.0, 7, 7, 7), ("OKX", "BTCUSDT", 1, None, 1.0, 7, 7, 7), ("OKX", "BTCUSDT", 1, 1.0, 1.0, None, 7, 7)]
    for lo in range(0, 303, 101):
        land(spark, f"file://{tmp_path}/in", trades[lo : lo + 101])
        emitted, still = run(spark, tmp_path, per_exchange)
    found = rollover.candles_of(rollover.revised(emitted.unionByName(still)))
    batch = candles.windowed(spark.read.parquet(f"file://{tmp_path}/in"), 5000, per_exchange)
    key = lambda r: (r[1], r[2] if per_exchange else "", r[4])
    got, want = sorted(map(tuple, found.collect()), key=key), sorted(map(tuple, batch.collect()), key=key)
    assert [r[:10] for r in got] == [r[:10] for r in want]
    assert [r[10:] for r in got] == [pytest.approx(r[10:], rel=1e-12) for r in want]
    assert emitted.groupBy("per", "instrument", "window_start_ms").agg(F.count_if(F.col("kind") == "closed").alias("n")).where("n > 1").count() == 0


def test_several_intervals_of_one_stream(spark, tmp_path):
    rng = random.Random(4)
    # the last trades are late for their short windows and in time for the long one
    trades = [trade(i, rng.randrange(95_000), float(rng.randrange(1, 99))) for i in range(120)] + [trade(200, 95_000)], [trade(300 + i, 91_000 + i, 50.0) for i in range(3)]
    for part in trades:
        land(spark, f"file://{tmp_path}/in", part)
        emitted, still = run(spark, tmp_path, intervals=(20_000, 2000))
    found = rollover.revised(emitted.unionByName(still))
    batch = candles.multi_interval(spark.read.parquet(f"file://{tmp_path}/in"), [2000, 20_000])
    assert rows_of(rollover.candles_of(found)) == rows_of(batch)
    assert {r.interval_ms: r.n for r in found.groupBy("interval_ms").agg(F.sum("late").alias("n")).collect()} == {2000: 3, 20_000: 0}
    with pytest.raises(ValueError):
        rollover.rolled(with_watermark(stream(spark, f"file://{tmp_path}/in"), "2 seconds"), (2000, 5000))


def test_merging_is_exact_and_in_any_order():
    fold = lambda ts, price, qty: (price, str(ts), price, price, price, str(ts), ts % 3, qty, price * qty, f"{qty:.12f}", f"{price * qty:.12f}", 1)
    parts = [fold(10 + i, 1.0 + i % 7, 0.1) for i in range(20)]
    rng = random.Random(1)
    seen = set()
    for _ in range(5):
        rng.shuffle(parts)
        out = parts[0]
        for p in parts[1:]:
            out = rollover.merge(out, p)
        seen.add((out[:7], out[9:]))
    assert len(seen) == 1 and dict(zip(rollover.NAMES, out, strict=True))["exact_base"] == "2.000000000000"
    assert rollover.merge(parts[0], (*parts[1][:9], None, None, 1))[9:] == (None, None, 2)


def test_a_lagging_feed_loses_nothing(spark, tmp_path):
    hour = 3_600_000
    fast, slow = f"file://{tmp_path}/fast", f"file://{tmp_path}/slow"

    def run(delays=None):
        both = union_streams({"fast": stream(spark, fast), "slow": stream(spark, slow)}, "1 minute", delays)
        found = streaming.candles_stream(both, hour, per_exchange=True)
        streaming.start(found, streaming.parquet_sink(f"file://{tmp_path}/out"), f"file://{tmp_path}/checkpoint", "closed").awaitTermination()
        return streaming.written(spark, f"file://{tmp_path}/out").where("exchange = 'OKX'").groupBy().sum("base_volume").first()[0] or 0

    land(spark, fast, [trade(i, (5 + i) * hour) for i in range(10)])
    land(spark, slow, [trade(i, i * hour // 10, exchange="OKX") for i in range(10)])
    assert run() == 0
    land(spark, slow, [trade(10 + i, hour + i * hour // 10, exchange="OKX") for i in range(11)])
    # a query that starts again waits for every feed to say something
    assert run() == 0
    land(spark, fast, [trade(50, 20 * hour)])
    land(spark, slow, [trade(21, 2 * hour + 1, exchange="OKX")])
    # of the slow feed's hours the first one is complete, although the fast one was five hours ahead from the start
    assert run() == 10
    land(spark, fast, [trade(51, 21 * hour)])
    land(spark, slow, [trade(30, 4 * hour, exchange="OKX")])
    assert run() == 22
    with pytest.raises(ValueError):
        run({"other": "1 hour"})
    spark.conf.set("spark.sql.streaming.multipleWatermarkPolicy", "max")
    try:
        with pytest.raises(ValueError):
            run()
    finally:
        spark.conf.unset("spark.sql.streaming.multipleWatermarkPolicy")
