import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import candles, feeds
from tickloom.schemas import CANDLE_COLUMNS, TRADE


def frame(spark, rows, schema=TRADE):
    """rows: (exchange, instrument, trade_id, price, qty, event_ts)."""
    return spark.createDataFrame([(*r, r[5], r[5]) for r in rows], schema)


def model(rows):
    """The fold, trade by trade in the total order, of one instrument's trades."""
    codes = {"BINANCE": 0, "BYBIT": 1, "OKX": 2}
    state = None
    for x, _, i, p, q, t in sorted(rows, key=lambda r: (r[5], r[2], codes.get(r[0], -1))):
        if state is None:
            state = {"exchange": x, "open": p, "high": p, "low": p, "close": p, "base_volume": q, "quote_volume": p * q}
        else:
            state |= {"high": max(state["high"], p), "low": min(state["low"], p), "close": p, "base_volume": state["base_volume"] + q, "quote_volume": state["quote_volume"] + p * q}
    return state


PRICES = [100.1, 101, 99.5, 102, 100.5, 98, 98.5, 103, 101.5, 97, 97.5, 104, 103.5, 99, 100, 105, 104.5, 96, 96.5, 100]


def test_twenty_trades(spark):
    rows = [("BINANCE", "BTCUSDT", 1000 + i, float(p), 1.0, 1770000000000 + i) for i, p in enumerate(PRICES)]
    random.Random(0).shuffle(rows)
    for found in (candles.all_time(frame(spark, rows)), candles.windowed(frame(spark, rows)), candles.windowed(frame(spark, rows), per_exchange=True)):
        (c,) = found.collect()
        assert tuple(found.columns) == CANDLE_COLUMNS
        assert (c.open, c.high, c.low, c.close, c.base_volume, c.window_start_ms) == (100.1, 105.0, 96.0, 100.0, 20.0, 1770000000000)
        assert c.quote_volume == pytest.approx(sum(PRICES))


def test_three_instruments(spark):
    rows = [("BINANCE", s, 1, 75019.99, q, 1770003054104) for s, q in (("BTCUSDT", 0.031), ("ETHUSDT", 0.031), ("SOLUSDT", 0.038))]
    found = candles.all_time(frame(spark, rows)).collect()
    assert {c.instrument_id for c in found} == {0, 1, 2} and {c.exchange for c in found} == {"BINANCE"}
    assert {(c.window_start_ms, c.window_end_ms) for c in found} == {(1770003050000, 0)}


def test_unknown_instruments_stay_apart(spark):
    rows = [("OKX", "DOGEUSDT", 1, 1.0, 1.0, 5), ("OKX", "XRPUSDT", 2, 2.0, 1.0, 6)]
    assert [(c.instrument_id, c.instrument) for c in candles.all_time(frame(spark, rows)).orderBy("instrument").collect()] == [(-1, "DOGEUSDT"), (-1, "XRPUSDT")]


def test_two_windows(spark):
    rows = [("OKX", "BTCUSDT", 1, 1.0, 1.0, 4999), ("OKX", "BTCUSDT", 2, 2.0, 1.0, 5000)]
    assert candles.all_time(frame(spark, rows)).count() == 1
    found = candles.windowed(frame(spark, rows)).orderBy("window_start_ms").collect()
    assert [(c.window_start_ms, c.window_end_ms) for c in found] == [(0, 5000), (5000, 10000)]


def test_arrival_order(spark):
    rows = [("OKX", "BTCUSDT", 3, 1.0, 1.0, 9000), ("BYBIT", "BTCUSDT", 2, 2.0, 1.0, 100)]
    schema = "exchange string, instrument string, trade_id bigint, price double, qty double, event_ts bigint, trade_ts bigint, recv_ts bigint, seq int"
    df = spark.createDataFrame([(*r, r[5], r[5], k) for k, r in enumerate(rows)], schema)
    (c,) = candles.all_time(df, seq="seq").collect()
    assert (c.open, c.close, c.exchange, c.window_start_ms) == (1.0, 2.0, "OKX", 5000)
    (c,) = candles.all_time(df).collect()
    assert (c.open, c.close, c.exchange, c.window_start_ms) == (2.0, 1.0, "BYBIT", 0)


TRADES = st.lists(st.tuples(st.sampled_from(["BINANCE", "BYBIT", "OKX", "OTHER"]), st.just("BTCUSDT"), st.integers(0, 5), st.integers(1, 9).map(float), st.integers(1, 9).map(float), st.integers(0, 20_000)), min_size=1, max_size=25, unique_by=lambda r: (r[0], r[2], r[5]))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TRADES, st.randoms())
def test_candles_match_the_fold(spark, rows, rng):
    shuffled = list(rows)
    rng.shuffle(shuffled)
    df = frame(spark, shuffled).repartition(3).cache()
    (c,) = candles.all_time(df).collect()
    expected = model(rows)
    expected["exchange"] = expected["exchange"] if expected["exchange"] != "OTHER" else "UNKNOWN"
    assert {k: c[k] for k in expected} == expected
    by_window = candles.windowed(df).collect()
    assert sum(x.base_volume for x in by_window) == c.base_volume and sum(x.quote_volume for x in by_window) == c.quote_volume
    for x in by_window:
        assert x.low <= min(x.open, x.close) <= max(x.open, x.close) <= x.high
        own = model([r for r in rows if r[5] - r[5] % 5000 == x.window_start_ms])
        assert (x.open, x.high, x.low, x.close) == (own["open"], own["high"], own["low"], own["close"])
    running = candles.running(df, 5000, 7).collect()
    assert len(running) == len(rows)
    codes = {"BINANCE": 0, "BYBIT": 1, "OKX": 2}
    key = lambda x, i, t: (t, i, codes.get(x, -1))
    for r in running:
        own = model([x for x in rows if key(x[0], x[2], x[5]) <= key(r.exchange, r.trade_id, r.event_ts)])
        assert (r.open, r.high, r.low, r.close, r.base_volume, r.quote_volume) == tuple(own[k] for k in ("open", "high", "low", "close", "base_volume", "quote_volume"))
    df.unpersist()


def test_intervals_from_finer_candles(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["BINANCE", "OKX"]), rng.choice(["BTCUSDT", "ETHUSDT"]), i, float(rng.randint(1, 50)), float(rng.randint(1, 5)), rng.randint(0, 60_000)) for i in range(300)]
    df = frame(spark, rows)
    found = candles.multi_interval(df, [1000, 5000, 20_000])
    for interval in (1000, 5000, 20_000):
        assert sorted(map(tuple, found.where(F.col("interval_ms") == interval).collect())) == sorted(map(tuple, candles.windowed(df, interval).collect()))
    with pytest.raises(ValueError):
        candles.multi_interval(df, [1000, 1500])


def test_folds_aggregate_by_hash(spark):
    df = frame(spark, [("OKX", "BTCUSDT", 1, 1.0, 1.0, 1)])
    for found in (candles.all_time(df), candles.windowed(df), candles.windowed(df, per_exchange=True)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan and plan.count("Exchange") == 1


def test_dedup_and_union(spark):
    rows = [("OKX", "BTCUSDT", 1, 1.0, 1.0, 9), ("OKX", "BTCUSDT", 1, 5.0, 1.0, 8), ("BYBIT", "BTCUSDT", 1, 3.0, 1.0, 7), ("OKX", "BTCUSDT", None, 4.0, 1.0, 6), ("OKX", "BTCUSDT", None, 4.0, 1.0, 6)]
    df = feeds.union_feeds(frame(spark, rows[:2]), frame(spark, rows[2:]))
    assert df.count() == 5
    found = [(r.exchange, r.trade_id, r.price) for r in feeds.dedup_trades(df).collect()]
    assert sorted(found, key=str) == sorted([("OKX", 1, 5.0), ("BYBIT", 1, 3.0), ("OKX", None, 4.0), ("OKX", None, 4.0)], key=str)
    (c,) = candles.counters(df, 5).collect()
    assert (c.trades_processed, c.candles_emitted) == (5, 1)
    plan = feeds.dedup_trades(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_universe_is_off_by_default(spark):
    df = frame(spark, [("OKX", "BTCUSDT", 1, 1.0, 1.0, 9), ("OKX", "XRPUSDT", 2, 1.0, 1.0, 9)])
    assert candles.only(df, None).count() == 2 and candles.only(df, ["BTCUSDT"]).count() == 1


@pytest.mark.parametrize(("qty", "exact"), [(1e10, True), (1e12, True), (1e-9, True), (0.1, True), (1e30, False)])
def test_volumes_of_any_size(spark, qty, exact):
    rows = [("OKX", "BTCUSDT", i, 0.25, qty, 1000 * i) for i in range(7)]
    df = frame(spark, rows)
    total = float(sum(Decimal(str(qty)) for _ in rows)) if exact else 7 * qty
    quote = float(sum(Decimal(str(qty)) * Decimal("0.25") for _ in rows)) if exact else 7 * qty * 0.25
    (c,) = candles.all_time(df).collect()
    coarse = candles.multi_interval(df, [5000, 10_000]).where("interval_ms = 10000").collect()[0]
    last = max(candles.running(df, 5000, 3).collect(), key=lambda r: r.event_ts)
    for found in (c, coarse, last):
        assert (found.base_volume, found.quote_volume) == ((total, quote) if exact else (pytest.approx(total), pytest.approx(quote)))


def test_times_that_are_none_are_passed_over(spark):
    rows = [("OKX", "BTCUSDT", 1, 1.0, 1.0, 10**17), ("OKX", "BTCUSDT", 2, 2.0, 1.0, 5)]
    for found in (candles.all_time(frame(spark, rows)), candles.windowed(frame(spark, rows)), candles.running(frame(spark, rows))):
        assert [r.open for r in found.collect()] == [2.0]
    assert candles.counters(frame(spark, rows), 10).first() == (2, 1)
    assert candles.counters(frame(spark, []), 10).first() == (0, 0)


def test_chunks_are_even_whatever_the_times(spark, tmp_path):
    # nine of ten trades of one instrument in one second
    rows = spark.range(20_000).selectExpr(
        "'OKX' as exchange", "if(id % 50 = 0, 'ETHUSDT', 'BTCUSDT') as instrument", "id as trade_id", "cast(1 + id % 7 as double) as price", "1.0D as qty",
        "if(id % 10 > 0, 5000000 + id % 1000, id * 1000) as event_ts", "0L as trade_ts", "0L as recv_ts",
    )
    cut = candles.chunked(rows, 1000, f"file://{tmp_path}/chunks")
    sizes = [r["count"] for r in cut.groupBy("chunk").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 2000
    within = cut.groupBy("instrument", "chunk").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).orderBy("instrument", "chunk").collect()
    assert all(a.hi < b.lo for a, b in zip(within, within[1:], strict=False) if a.instrument == b.instrument)
    last = candles.running(rows, 5000, 1000).groupBy("instrument").agg(F.max("base_volume").alias("v")).collect()
    assert {r.instrument: r.v for r in last} == {"BTCUSDT": 19_600.0, "ETHUSDT": 400.0}


def test_tiny_quantities_count(spark):
    rows = [("OKX", "BTCUSDT", i, 3e-11, 1e-13, 1000 * i) for i in range(4)]
    (c,) = candles.all_time(frame(spark, rows)).collect()
    assert c.base_volume == pytest.approx(4e-13) and c.quote_volume == pytest.approx(12e-24)
    (mixed,) = candles.all_time(frame(spark, [*rows, ("OKX", "BTCUSDT", 9, 1.0, 1e-13, 9000)])).collect()
    assert mixed.quote_volume == pytest.approx(1e-13 + 12e-24)
