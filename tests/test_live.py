import base64
import hashlib
import socket
import struct
import threading
import time

import pytest

from tickloom.operators import candles, parsers
from tickloom.sources import live
from tickloom.sources.feeds import FEEDS, Feed, landed

TRADE = '{"arg":{"channel":"trades"},"data":[{"instId":"BTC-USDT","tradeId":"%d","px":"%d","sz":"1","ts":"1000"}]}'


def frame(kind, body, last=True):
    n = len(body)
    size = bytes([n]) if n < 126 else b"\x7e" + struct.pack(">H", n) if n < 1 << 16 else b"\x7f" + struct.pack(">Q", n)
    return bytes([(128 if last else 0) | kind]) + size + body


class Server:
    """Answers each connection with the next of its scripts, then closes."""

    def __init__(self, *scripts):
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.scripts, self.heard = list(scripts), []
        threading.Thread(target=self.run, daemon=True).start()

    @property
    def feed(self):
        return Feed("okx", "OKX", "127.0.0.1", self.socket.getsockname()[1], "/ws", "okx")

    def run(self):
        for script in self.scripts:
            c, _ = self.socket.accept()
            head = b""
            while b"\r\n\r\n" not in head:
                head += c.recv(4096)
            key = next(x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"sec-websocket-key"))
            accept = base64.b64encode(hashlib.sha1(key + b"258EAFA5-E914-47DA-95CA-C5AB0DC85B11").digest())
            c.sendall(b"HTTP/1.1 101 Switching Protocols\r\nUpgrade: websocket\r\nConnection: Upgrade\r\nSec-WebSocket-Accept: " + (accept if script is not None else b"no") + b"\r\n\r\n")
            if script is not None:
                a = c.recv(2)
                n = a[1] & 127
                n = struct.unpack(">H", c.recv(2))[0] if n == 126 else n
                mask, body = c.recv(4), c.recv(n)
                self.heard.append(bytes(x ^ mask[i & 3] for i, x in enumerate(body)).decode())
                for part in script:
                    c.sendall(part)
            c.close()
        self.socket.close()


def plain(feed):
    return live.WebSocket(feed.host, feed.port, feed.path, tls=False, timeout=5)


def test_messages_of_all_kinds_are_landed_and_read(spark, tmp_path):
    one, two, three = ((TRADE % (i, 10 * i)).encode() for i in (1, 2, 3))
    long = ('{"data":[],"pad":"' + "x" * 70_000 + '"}').encode()
    server = Server([frame(1, one), frame(9, b"ping"), frame(1, two[:20], False), frame(10, b""), frame(0, two[20:])], None, [frame(1, long) + frame(1, three), frame(8, b"")])
    lander = live.Lander(server.feed, ["BTCUSDT"], live.shared_writer(spark, f"file://{tmp_path}/in"), plain, lines=2, delays_ms=(1, 1, 1))
    lander.start()
    lander.start()
    lander.wait(20)
    assert lander.given_up and len(lander.failures) >= 2
    assert server.heard == [FEEDS["okx"].subscription(["BTCUSDT"])] * 2
    trades = parsers.accepted(parsers.parse(landed(spark, f"file://{tmp_path}/in/*.txt"), "okx"))
    assert sorted((r.trade_id, r.price) for r in trades.collect()) == [(1, 10.0), (2, 20.0), (3, 30.0)]
    (c,) = candles.windowed(trades, 5000).collect()
    assert (c.open, c.close, c.base_volume) == (10.0, 30.0, 3.0)


def test_attempts_are_spaced_as_scheduled(tmp_path):
    tried = []

    def fail(feed):
        tried.append(time.monotonic())
        raise OSError("no network")

    lander = live.Lander(FEEDS["okx"], ["BTCUSDT"], live.local_writer(str(tmp_path)), fail, delays_ms=(20, 40, 80))
    lander.start()
    lander.wait(10)
    assert lander.given_up and len(tried) == 4
    assert [b - a >= d for a, b, d in zip(tried, tried[1:], (0.02, 0.04, 0.08), strict=False)] == [True] * 3


def test_stop_writes_what_is_held(tmp_path):
    class Endless:
        def __init__(self):
            self.open, self.sent = True, []

        def send(self, text):
            self.sent.append(text)

        def messages(self):
            yield "first"
            while self.open:
                time.sleep(0.01)

        def close(self):
            self.open = False

    lander = live.Lander(FEEDS["bybit"], ["BTCUSDT"], live.local_writer(str(tmp_path)), lambda _: Endless(), seconds=60)
    lander.stop()
    lander.start()
    time.sleep(0.1)
    lander.stop()
    lander.stop()
    assert [p.read_text() for p in tmp_path.iterdir()] == ["first\n"] and not lander.given_up


def test_a_feed_unsubscribes():
    symbols = ["BTCUSDT", "ETHUSDT"]
    # fixed values: the exchanges' protocols
    assert FEEDS["binance"].unsubscription(symbols) == '{"method":"UNSUBSCRIBE","params":["btcusdt@trade","ethusdt@trade"],"id":1}'
    assert FEEDS["bybit"].unsubscription(symbols) == '{"op":"unsubscribe","args":["publicTrade.BTCUSDT","publicTrade.ETHUSDT"]}'
    assert FEEDS["okx"].unsubscription(symbols[:1]) == '{"op":"unsubscribe","args":[{"channel":"trades","instId":"BTC-USDT"}]}'


@pytest.mark.parametrize("answer", [b"HTTP/1.1 404 Not Found\r\n\r\n", b""])
def test_other_servers_are_refused(answer):
    s = socket.create_server(("127.0.0.1", 0))

    def once():
        c, _ = s.accept()
        c.recv(4096)
        c.sendall(answer)
        c.close()

    threading.Thread(target=once, daemon=True).start()
    with pytest.raises(ConnectionError):
        live.WebSocket("127.0.0.1", s.getsockname()[1], "/", tls=False, timeout=5)
    s.close()


def test_main_lands_and_folds(spark, tmp_path):
    from tickloom.__main__ import start
    from tickloom.streaming.candles import written

    class Feeding:
        def __init__(self, feed):
            self.feed, self.open = feed, True

        def send(self, text):
            pass

        def messages(self):
            if self.feed.name == "okx":
                yield from (TRADE % (i, i) for i in range(1, 6))
            while self.open:
                time.sleep(0.01)

        def close(self):
            self.open = False

    made = []
    args = [f"--input=file://{tmp_path}/in", f"--output=file://{tmp_path}/out", f"--checkpoint=file://{tmp_path}/checkpoint", "--emit=all", "--live=yes", "--exchanges=okx,binance"]
    query = start(spark, args, lambda feed: made.append(Feeding(feed)) or made[-1])
    try:
        for session in made:
            session.close()
        until = time.monotonic() + 40
        while time.monotonic() < until:
            found = written(spark, f"file://{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
            if found and found[0].base_volume == 5:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert [(c.instrument, c.open, c.close, c.base_volume) for c in found] == [("BTCUSDT", 1.0, 5.0, 5.0)]


def test_a_quiet_feed_is_landed_in_time_and_a_silent_one_is_given_up(tmp_path):
    over = threading.Event()

    def quiet():
        yield frame(1, (TRADE % (1, 10)).encode())
        over.wait(20)

    server = Server(quiet(), quiet())
    opened = []

    def short(feed):
        opened.append(time.monotonic())
        return live.WebSocket(feed.host, feed.port, feed.path, tls=False, timeout=5, quiet=1.2)

    lander = live.Lander(server.feed, ["BTCUSDT"], live.local_writer(str(tmp_path)), short, lines=100, seconds=0.1, delays_ms=(1,))
    lander.start()
    until = time.monotonic() + 5
    while not list(tmp_path.iterdir()) and time.monotonic() < until:
        time.sleep(0.02)
    # the message is there while the connection still stands
    assert len(list(tmp_path.iterdir())) == 1 and len(opened) == 1 and not lander.failures
    while not lander.failures and time.monotonic() < until:
        time.sleep(0.02)
    assert "silent" in str(lander.failures[0])
    over.set()
    lander.stop()


def test_a_ping_asks_before_a_connection_is_given_up():
    class Quiet:
        def __init__(self):
            self.sent, self.asked = [], 0

        def recv(self, n):
            self.asked += 1
            if self.sent:
                return frame(1, b"back") + frame(8, b"")
            time.sleep(0.02)
            raise TimeoutError

        def sendall(self, body):
            self.sent.append(body)

    ws = live.WebSocket.__new__(live.WebSocket)
    ws.socket, ws.held, ws.quiet, ws.heard, ws.asked = Quiet(), b"", 0.4, time.monotonic(), False
    assert list(ws.messages()) == ["back"] and len(ws.socket.sent) == 1 and ws.socket.sent[0][0] == 128 | live.PING
