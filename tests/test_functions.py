import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.config import Settings
from tickloom.functions import codecs, numbers, text
from tickloom.sources.feeds import FEEDS
from tickloom.sources.replay import json_objects, split_objects


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_codes_are_exact_and_case_sensitive(spark):
    names = ["BINANCE", "binance", "OKX", "", None]
    assert column(spark, names, codecs.exchange_code) == [0, -1, 2, -1, -1]
    assert column(spark, ["SOLUSDT", "DOGEUSDT"], codecs.instrument_id) == [2, -1]
    assert column(spark, [1, -1, 9], codecs.exchange_name, "int") == ["BYBIT", "UNKNOWN", "UNKNOWN"]
    assert column(spark, [0, 5], codecs.instrument_name, "int") == ["BTCUSDT", "UNKNOWN"]


def test_symbols(spark):
    assert column(spark, ["publicTrade.ETHUSDT", "a.publicTrade.X.publicTrade.Y", "orderbook"], codecs.symbol_of_topic) == ["ETHUSDT", "X.publicTrade.Y", ""]
    symbols = ["BTCUSDT", "USDTUSDT", "BTCEUR", ""]
    assert column(spark, symbols, codecs.okx_of_symbol) == ["BTC-USDT", "-USDTUSDT", "BTCEUR", ""]
    assert [text.okx_id(s) for s in symbols] == ["BTC-USDT", "-USDTUSDT", "BTCEUR", ""]
    assert column(spark, ["BTC-USDT-SWAP"], codecs.symbol_of_okx) == ["BTCUSDTSWAP"]


def test_strict_numbers(spark):
    written = ["1.5", "-2", "3e2", "1.5abc", "", "nan", "inf", "+1.5", " 1.5", "1.5d", "1e999", None, ".5"]
    assert column(spark, written, numbers.to_double) == [1.5, -2.0, 300.0] + [None] * 10
    assert column(spark, ["18446744073709551615", "2280000001559930510", "12x", "-1"], numbers.to_id) == [None, 2280000001559930510, None, None]


def test_windows_and_delays(spark):
    assert column(spark, [1770003054104], lambda c: numbers.window_start(c, 5000), "bigint") == [1770003050000]
    with pytest.raises(ValueError):
        numbers.window_start(F.lit(1), 0)
    # fixed values: the schedule
    expected = [1000, 2000, 4000, 8000, 16000, 32000, 60000, 60000, 60000, 60000]
    assert numbers.reconnect_schedule() == expected
    assert column(spark, list(range(1, 11)), numbers.reconnect_delay_ms, "int") == expected
    assert column(spark, [0], lambda c: numbers.now_ms())[0] > 0


def test_lists(spark):
    lists = ["a,b", "a,,b", "a,b,", "", ",", "a"]
    expected = [["a", "b"], ["a", "", "b"], ["a", "b"], [], [""], ["a"]]
    assert [text.split_list(x) for x in lists] == expected
    assert column(spark, lists, text.split_column) == expected


def test_subscriptions(spark):
    # fixed values: the exchanges' protocols
    symbols = ["BTCUSDT", "ETHUSDT"]
    assert FEEDS["binance"].subscription(symbols) == '{"method":"SUBSCRIBE","params":["btcusdt@trade","ethusdt@trade"],"id":1}'
    assert FEEDS["bybit"].subscription(symbols) == '{"op":"subscribe","args":["publicTrade.BTCUSDT","publicTrade.ETHUSDT"]}'
    assert FEEDS["okx"].subscription(symbols) == '{"op":"subscribe","args":[{"channel":"trades","instId":"BTC-USDT"},{"channel":"trades","instId":"ETH-USDT"}]}'
    for feed in FEEDS:
        assert column(spark, [symbols], lambda c, feed=feed: text.subscribe_column(feed, c), "array<string>") == [FEEDS[feed].subscription(symbols)]
    assert FEEDS["okx"].url == "wss://ws.okx.com:8443/ws/v5/public"


def test_settings():
    s = Settings.from_args(["--interval_ms=250", "--exchanges=okx,,bybit,", "--instruments=", "--grpc_port=9", "other"])
    assert (s.interval_ms, s.exchanges, s.instruments, s.grpc_port, s.unknown) == (250, ("okx", "", "bybit"), ("BTCUSDT", "ETHUSDT", "SOLUSDT"), 9, ("other",))
    assert Settings.from_args([]) == Settings() == Settings().validate()
    for bad in (Settings(interval_ms=0), Settings(exchanges=()), Settings(instruments=())):
        with pytest.raises(ValueError):
            bad.validate()


PRETTY = 'noise\n  {\n "a": {\n }\n}\n{"b": 1}\nx {"c":2} {"d":3}\n{"open":\n'


def test_split_objects():
    assert list(split_objects(PRETTY.split("\n"))) == ['{\n "a": {\n }\n}\n', '{"b": 1}\n', '{"c":2} {"d":3}\n']


@given(st.lists(st.sampled_from(["{", "}", "x", "{}", ""]), max_size=12))
def test_split_objects_balance(lines):
    for value in split_objects(lines):
        assert value.startswith("{") and value.count("{") == value.count("}")


def test_captures_are_read_file_by_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(PRETTY)
    assert json_objects(spark, f"file://{tmp_path}").count() == 9
