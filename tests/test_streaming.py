import json
import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import candles, parsers
from tickloom.operators.feeds import with_watermark
from tickloom.plans import queries
from tickloom.sources import feeds
from tickloom.streaming import candles as streaming
from tickloom.streaming import dedup, rollover


def message(i, price, ts, symbol="btcusdt"):
    return json.dumps({"e": "trade", "E": ts, "s": symbol, "t": i, "p": str(price), "q": "1", "T": ts})


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(message(*r) for r in rows) + "\nnope\n")


def stream(spark, path, **options):
    trades = parsers.accepted(parsers.parse(feeds.landing(spark, f"file://{path}/in", 1), "binance_raw"))
    return streaming.candles_stream(trades, 5000, "2 seconds", **options)


def run(spark, path, emit, **options):
    query = streaming.start(stream(spark, path, **options), streaming.parquet_sink(f"file://{path}/out"), f"file://{path}/checkpoint", emit)
    query.awaitTermination()
    return {(r.instrument, r.window_start_ms): r for r in streaming.written(spark, f"file://{path}/out").collect()}


ROWS = [(1, 10.0, 1000), (2, 12.0, 1500), (3, 9.0, 6000), (4, 11.0, 12000)]


def test_all_has_open_windows_and_equals_batch(spark, tmp_path):
    land(tmp_path / "in", "a.txt", ROWS)
    found = run(spark, tmp_path, "all")
    batch = candles.windowed(parsers.accepted(parsers.parse(feeds.landed(spark, f"file://{tmp_path}/in"), "binance_raw")), 5000)
    assert sorted(map(tuple, found.values())) == sorted(map(tuple, batch.collect()))


def test_closed_leaves_the_trailing_window(spark, tmp_path):
    land(tmp_path / "in", "a.txt", ROWS)
    found = run(spark, tmp_path, "closed")
    # the watermark ends at 10000: the window that ends there is closed, the next one isn't
    assert set(found) == {("BTCUSDT", 0), ("BTCUSDT", 5000)}


def test_restart_goes_on_from_the_checkpoint(spark, tmp_path):
    land(tmp_path / "in", "a.txt", ROWS[:2])
    assert run(spark, tmp_path, "all")[("BTCUSDT", 0)].base_volume == 2
    land(tmp_path / "in", "b.txt", [(5, 20.0, 4000), *ROWS[2:]])
    found = run(spark, tmp_path, "all")
    assert found[("BTCUSDT", 0)].base_volume == 3 and found[("BTCUSDT", 0)].high == 20.0
    assert len(found) == 3


def test_late_trades_are_left_out_after_the_watermark(spark, tmp_path):
    land(tmp_path / "in", "a.txt", ROWS)
    run(spark, tmp_path, "closed")
    land(tmp_path / "in", "b.txt", [(9, 99.0, 1200), (10, 1.0, 30000)])
    found = run(spark, tmp_path, "closed")
    assert found[("BTCUSDT", 0)].high == 12.0 and ("BTCUSDT", 10000) in found


def test_repeats_within_the_watermark(spark, tmp_path):
    land(tmp_path / "in", "a.txt", [ROWS[0], ROWS[0], ROWS[1]])
    assert run(spark, tmp_path, "closed", dedup=True) == {}
    land(tmp_path / "in", "b.txt", [ROWS[1], (4, 11.0, 12000)])
    assert run(spark, tmp_path, "closed", dedup=True)[("BTCUSDT", 0)].base_volume == 2


def test_callbacks(spark, tmp_path):
    land(tmp_path / "in", "a.txt", ROWS)
    seen = []
    streaming.start(stream(spark, tmp_path), streaming.callback_sink(seen.append), f"file://{tmp_path}/checkpoint").awaitTermination()
    assert sorted(c["window_start_ms"] for c in seen) == [0, 5000]


def test_candles_of_each_exchange(spark, tmp_path):
    land(tmp_path / "in", "a.txt", ROWS)
    trades = parsers.accepted(parsers.parse(feeds.landing(spark, f"file://{tmp_path}/in"), "binance_raw"))
    other = trades.withColumns({"exchange": F.lit("OKX"), "price": F.col("price") + 1})
    found = streaming.candles_stream(trades.unionByName(other), 5000, "2 seconds", per_exchange=True)
    streaming.start(found, streaming.parquet_sink(f"file://{tmp_path}/out"), f"file://{tmp_path}/checkpoint", "all").awaitTermination()
    landed = parsers.accepted(parsers.parse(feeds.landed(spark, f"file://{tmp_path}/in"), "binance_raw"))
    batch = candles.windowed(landed.unionByName(landed.withColumns({"exchange": F.lit("OKX"), "price": F.col("price") + 1})), 5000, per_exchange=True)
    got = streaming.written(spark, f"file://{tmp_path}/out").collect()
    assert len(got) == 6 and sorted(map(tuple, got)) == sorted(map(tuple, batch.collect()))


def test_compaction_keeps_the_last_of_each_candle(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for k in range(4):
        land(tmp_path / "in", f"{k}.txt", [(10 + k, 10.0 + k, 1000 + k), (20 + k, 5.0, 6000)])
        run(spark, tmp_path, "all")
        if k == 1:
            streaming.compact(spark, out)
    before = sorted(map(tuple, streaming.written(spark, out).collect()))
    streaming.compact(spark, out)
    parts = [x.name for x in (tmp_path / "out").iterdir() if x.name.startswith("part=")]
    assert len(parts) == 2 and sum(x.startswith("part=to") for x in parts) == 1
    assert sorted(map(tuple, streaming.written(spark, out).collect())) == before and {r[10] for r in before} == {4.0}


def test_callbacks_by_partition(spark, tmp_path):
    land(tmp_path / "in", "a.txt", ROWS)
    n = spark.sparkContext.accumulator(0)
    streaming.start(stream(spark, tmp_path), streaming.partition_sink(lambda rows: n.add(sum(1 for _ in rows))), f"file://{tmp_path}/checkpoint").awaitTermination()
    assert n.value == 2


@pytest.mark.parametrize(("most", "ring"), [(7, 3), (5, 1), (3, 9), (1, 1)])
def test_counted_dedup_forgets_as_its_ring_says(most, ring):
    rng = random.Random(most)
    ids = [rng.randrange(14) for _ in range(400)]
    # all new ids in order: what is remembered are those since the last multiple of most, and the last ring before it
    order, want = [], []
    for i in ids:
        since = len(order) - len(order) % most
        want.append(i not in order[max(0, since - ring) :])
        if want[-1]:
            order.append(i)
    n, numbers, got = 0, {}, []
    for lo in range(0, 400, 37):
        new, n, given = dedup.numbered(ids[lo : lo + 37], n, numbers.get, most, ring)
        numbers |= given
        got += new
    assert got == want and n == len(order)


def test_counted_dedup_holds_neither_a_batch_nor_its_ids():
    rows = [(random.Random(i).randrange(50), i) for i in range(1000)]
    key = lambda r: r[:1]
    taken = iter(rows)
    for run in (7, 500, 1000, 2000):
        assert list(dedup.in_order(iter(rows), key, run)) == sorted(rows, key=key)
    # nothing is taken before it is asked for, and merged rows come one by one
    first = next(dedup.in_order(taken, key, 10))
    assert first == min(rows) and not list(dedup.in_order([], key))
    asked = []
    numbering = dedup.Numbering(20, lambda i: asked.append(i), 10, 2)
    held = 0
    for i in range(5000):
        assert numbering.is_new(i)
        held = max(held, len(numbering.numbers))
    # what was there before is forgotten as soon as its numbers are below the bound
    assert held <= 12 and len(asked) <= 20 and numbering.n == 5020


def test_counted_dedup_of_a_stream(spark, tmp_path):
    rng = random.Random(3)
    ids = [rng.randrange(12) for _ in range(120)]
    new, _, _ = dedup.numbered(ids, 0, lambda _: None, 7, 3)
    (tmp_path / "in").mkdir()
    for part, lo in enumerate((0, 60)):
        (tmp_path / "in" / f"{part}.txt").write_text("\n".join(message(i, 1.0, 1000 + lo + k) for k, i in enumerate(ids[lo : lo + 60])))
        trades = parsers.accepted(parsers.parse(feeds.landing(spark, f"file://{tmp_path}/in", 1), "binance_raw"))
        with rollover.rocksdb(spark):
            query = dedup.dedup_counted(trades, 7, 3).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    found = [r.event_ts - 1000 for r in spark.read.parquet(f"file://{tmp_path}/out").orderBy("event_ts").collect()]
    assert found == [k for k, is_new in enumerate(new) if is_new]
    # what is forgotten isn't kept
    state = spark.read.format("statestore").option("stateVarName", "numbers").load(f"file://{tmp_path}/checkpoint")
    assert state.count() <= 7 + 3
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            dedup.dedup_counted(trades, *bad)


def test_messages_are_rendered_before_they_are_repeated(spark):
    for name in ("binance", "okx"):
        plan = queries._messages(spark, "/root/testdata/sf0.001")[name]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("CASE WHEN")


def test_event_time(spark):
    df = spark.createDataFrame([(1770003054104,)], "event_ts bigint")
    assert with_watermark(df).select(F.unix_millis("event_time")).first()[0] == 1770003054104


def test_main_consolidates_feeds(spark, tmp_path):
    from tickloom.__main__ import start

    (tmp_path / "in").mkdir()
    land(tmp_path / "in" / "binance", "a.txt", [*ROWS, (7, 50.0, 1200, "dogeusdt")])
    okx = '{"arg":{"channel":"trades"},"data":[{"instId":"BTC-USDT","tradeId":"1","px":"5","sz":"3","ts":"900"}]}'
    (tmp_path / "in" / "okx").mkdir()
    (tmp_path / "in" / "okx" / "a.txt").write_text(okx + "\n" + okx + "\n")
    args = [f"--input=file://{tmp_path}/in", f"--output=file://{tmp_path}/out", f"--checkpoint=file://{tmp_path}/checkpoint", "--emit=all", "--interval_ms=5000"]
    start(spark, args).awaitTermination()
    found = {(r.instrument, r.window_start_ms): r for r in streaming.written(spark, f"file://{tmp_path}/out").collect()}
    assert {k[0] for k in found} == {"BTCUSDT"}
    c = found[("BTCUSDT", 0)]
    assert (c.exchange, c.open, c.high, c.low, c.close, c.base_volume) == ("OKX", 5.0, 12.0, 5.0, 12.0, 5.0)
    with pytest.raises(ValueError):
        start(spark, args[:1])
