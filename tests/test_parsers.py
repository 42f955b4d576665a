import pytest

from tickloom.operators import parsers
from tickloom.schemas import TRADE, TRADE_COLUMNS


def raw(spark, *messages):
    return spark.createDataFrame([(m,) for m in messages], "value string")


def trades(spark, feed, *messages):
    return [r.asDict() for r in parsers.accepted(parsers.parse(raw(spark, *messages), feed)).collect()]


def reasons(spark, feed, *messages):
    found = parsers.rejected(parsers.parse(raw(spark, *messages), feed)).collect()
    return [next((r.reject for r in found if r.value == m), None) for m in messages]


# fixed values: sample messages of the exchanges and what they hold
BINANCE = '{"stream":"btcusdt@trade","data":{"e":"trade","E":1770003054104,"s":"BTCUSDT","t":5858430818,"p":"75019.99000000","q":"0.03100000","T":1770003054103,"m":false,"M":true}}'


def bybit(items, topic="publicTrade.ETHUSDT", ts="1770197572744"):
    return f'{{"topic":"{topic}","ts":{ts},"type":"snapshot","data":{items}}}'


def item(i=1, p="2260.15", v="0.11", t="1770197572743", s="ETHUSDT"):
    return f'{{"i":"{i}","T":{t},"p":"{p}","v":"{v}","S":"Sell","seq":1,"s":"{s}","BT":false,"RPI":false}}'


def test_binance_single_trade(spark):
    (t,) = trades(spark, "binance", BINANCE)
    assert t.pop("recv_ts") > 0
    assert t == {"exchange": "BINANCE", "instrument": "BTCUSDT", "trade_id": 5858430818, "price": 75019.99, "qty": 0.031, "event_ts": 1770003054104, "trade_ts": 1770003054103}


def test_bybit_nine_items(spark):
    sizes = ["0.09464", *["0.11"] * 7, "0.04162"]
    message = bybit("[" + ",".join(item(2280000001559930510 + k, v=v) for k, v in enumerate(sizes)) + "]")
    found = parsers.parse(raw(spark, message), "bybit").orderBy("pos").collect()
    assert [r.trade_id for r in found] == [2280000001559930510 + k for k in range(9)]
    assert [r.qty for r in found] == [float(v) for v in sizes]
    assert {(r.exchange, r.instrument, r.price, r.event_ts, r.trade_ts, r.reject) for r in found} == {("BYBIT", "ETHUSDT", 2260.15, 1770197572744, 1770197572743, None)}


@pytest.mark.parametrize("feed", list(parsers.PARSERS))
def test_junk_is_rejected(spark, feed):
    junk = ["nope", "[]", "{}", "", "3", "null", '{"data":']
    assert all(r in ("malformed", "not_trade") for r in reasons(spark, feed, *junk))
    assert trades(spark, feed, *junk) == []
    parsed = parsers.parse(raw(spark, *junk), feed)
    assert parsed.count() == len(junk)
    assert [(f.name, f.dataType) for f in parsed.select(*TRADE_COLUMNS).schema] == [(f.name, f.dataType) for f in TRADE]


def test_keys_that_differ_by_case(spark):
    message = '{"data":{"E":1,"e":2,"T":3,"t":4,"s":"X","p":"1","q":"1"}}'
    (t,) = trades(spark, "binance", message)
    assert (t["event_ts"], t["trade_ts"], t["trade_id"]) == (1, 3, 4)


def test_binance_rejects(spark):
    bad = [BINANCE.replace('"75019.99000000"', f'"{p}"') for p in ("1.5abc", "", "nan", "1e999")]
    assert reasons(spark, "binance", *bad) == ["bad_number"] * 4
    assert reasons(spark, "binance", BINANCE.replace("5858430818", "18446744073709551615"), BINANCE.replace('"q"', '"w"'), BINANCE.replace('"data":{', '"data":[{').replace("}}", "}]}")) == ["bad_number", "missing_field", "malformed"]


def test_binance_raw(spark):
    message = '{"e":"trade","E":5,"s":"btcusdt","t":7,"p":"1.5","q":"2","T":6}'
    other = message.replace('"trade"', '"aggTrade"')
    part = '{"e":"trade","s":"ethusdt"}'
    found = trades(spark, "binance_raw", message, other, part)
    assert [(t["instrument"], t["trade_id"], t["price"], t["event_ts"], t["trade_ts"]) for t in found] == [("BTCUSDT", 7, 1.5, 6, 6), ("ETHUSDT", None, None, None, None)]
    assert reasons(spark, "binance_raw", other) == ["not_trade"]


def test_bybit_rejects_whole_messages(spark):
    messages = [bybit(f"[{item()},3]"), bybit("{}"), bybit(f"[{item()},{item(2, p='x')}]"), bybit("[" + item().replace('"T"', '"x"') + "]"), bybit(f"[{item()}]").replace('"ts"', '"tt"')]
    assert reasons(spark, "bybit", *messages) == ["malformed", "malformed", "bad_number", "missing_field", "malformed"]
    assert trades(spark, "bybit", *messages) == []
    (t,) = trades(spark, "bybit", bybit(f"[{item()}]", topic="other"))
    assert t["instrument"] == ""


def test_bybit_provider_rejects_elements(spark):
    good, bad = item(1, s="SOLUSDT"), item(2, p="x")
    found = trades(spark, "bybit_provider", bybit(f"[{good},{bad}]"))
    assert [(t["trade_id"], t["instrument"], t["event_ts"]) for t in found] == [(1, "SOLUSDT", 1770197572743)]
    assert reasons(spark, "bybit_provider", bybit(f"[{good}]", topic="tickers.X"), bybit("{}")) == ["not_trade", "malformed"]


def test_okx_channels(spark):
    data = '"data":[{"instId":"BTC-USDT","tradeId":"9","px":"1.5","sz":"2","ts":"77"},{"instId":"BTC-USDT","tradeId":"10","px":"+1","sz":"2","ts":"77"}]'
    found = trades(spark, "okx", "{" + data + "}", '{"arg":{"channel":"trades"},' + data + "}", '{"arg":{"channel":"books"},' + data + "}")
    assert [(t["exchange"], t["instrument"], t["trade_id"], t["price"], t["qty"], t["event_ts"], t["trade_ts"]) for t in found] == [("OKX", "BTCUSDT", 9, 1.5, 2.0, 77, 77)] * 2
    assert reasons(spark, "okx", '{"arg":{"channel":"books"},' + data + "}", '{"event":"subscribe"}') == ["not_trade", "malformed"]


def test_messages_are_parsed_once(spark):
    for feed, times in (("binance", 2), ("binance_raw", 2), ("bybit", 1), ("bybit_provider", 1), ("okx", 1)):
        plan = parsers.accepted(parsers.parse(raw(spark, BINANCE), feed)).select("price", "trade_ts")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("from_json(") == times, plan
        assert "Python" not in plan


@pytest.mark.parametrize("feed", list(parsers.PARSERS))
def test_messages_within_an_array_are_rejected(spark, feed):
    data = '"data":[{"instId":"BTC-USDT","tradeId":"9","px":"1.5","sz":"2","ts":"77"}]'
    good = {"binance": BINANCE, "binance_raw": '{"e":"trade","s":"x","t":1,"p":"1","q":"1","T":1}', "okx": "{" + data + "}"}.get(feed, bybit(f"[{item()}]"))
    assert len(trades(spark, feed, good, " \n" + good)) == 2
    assert reasons(spark, feed, f"[{good}]") == ["malformed"]


def test_times_that_are_none(spark):
    late = BINANCE.replace('"E":1770003054104', '"E":1770003054104000000')
    assert reasons(spark, "binance", late, BINANCE) == ["bad_time", None]
