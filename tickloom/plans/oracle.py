"""SQL for each query, over the same tables."""

from __future__ import annotations

HOUR, DAY = 3_600_000, 86_400_000

TRADES = """WITH trades AS (
    SELECT CASE event_id % 3 WHEN 0 THEN 'BINANCE' WHEN 1 THEN 'BYBIT' ELSE 'OKX' END AS exchange, event_id % 3 AS code,
           CASE user_id % 4 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'ETHUSDT' WHEN 2 THEN 'SOLUSDT' ELSE 'DOGEUSDT' END AS instrument,
           CASE WHEN user_id % 4 < 3 THEN user_id % 4 ELSE -1 END AS instrument_id, event_id AS trade_id, value AS price,
           CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS qty, epoch_us(ts) // 1000 AS event_ts, epoch_us(ts) // 1000 AS trade_ts,
           epoch_us(ts) // 1000 + 5 AS recv_ts, event_type
    FROM events
)"""
SHOWN = "exchange, instrument, trade_id, price, qty, event_ts, trade_ts"
FIRST = "row(event_ts, trade_id, code)"
FOLD = f"""arg_min(price, {FIRST}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {FIRST}) AS close,
    CAST(sum(CAST(qty AS DECIMAL(18, 8))) AS DOUBLE) AS base_volume,
    CAST(sum(CAST(price AS DECIMAL(38, 8)) * CAST(qty AS DECIMAL(38, 8))) AS DOUBLE) AS quote_volume"""
NAME = "CASE {} WHEN 0 THEN 'BINANCE' WHEN 1 THEN 'BYBIT' WHEN 2 THEN 'OKX' ELSE 'UNKNOWN' END"
CONSOLIDATED = NAME.format(f"arg_min(code, {FIRST})")


def _windowed(interval: int, where: str = "", having: str = "") -> str:
    return f"""{TRADES}
        SELECT CAST(instrument_id AS TINYINT) AS instrument_id, instrument, {CONSOLIDATED} AS exchange, CAST({interval} AS BIGINT) AS interval_ms,
               event_ts - event_ts % {interval} AS window_start_ms, event_ts - event_ts % {interval} + {interval} AS window_end_ms, {FOLD}
        FROM trades {where} GROUP BY instrument_id, instrument, event_ts - event_ts % {interval} {having}"""


def _decimal(c: str) -> str:
    return f"CAST({c} AS DECIMAL(38, 8))"


_RUN = f"(PARTITION BY instrument ORDER BY event_ts, trade_id, code ROWS UNBOUNDED PRECEDING)"
_EACH_EXCHANGE = f"""{TRADES}
    SELECT CAST(instrument_id AS TINYINT) AS instrument_id, instrument, exchange, CAST({HOUR} AS BIGINT) AS interval_ms,
           event_ts - event_ts % {HOUR} AS window_start_ms, event_ts - event_ts % {HOUR} + {HOUR} AS window_end_ms, {FOLD}
    FROM trades GROUP BY instrument_id, instrument, exchange, event_ts - event_ts % {HOUR}"""
_K = "(trade_id // 3) % 8"

ORACLE_SQL: dict[str, str] = {
    "parse_binance_combined": f"{TRADES} SELECT {SHOWN} FROM trades WHERE code = 0",
    "parse_binance_raw": f"{TRADES} SELECT {SHOWN} FROM trades WHERE code = 0 AND event_type <> 'view'",
    "parse_bybit_snapshot": f"""{TRADES} SELECT exchange, instrument, trade_id, price, qty,
        max(event_ts) OVER (PARTITION BY instrument, event_ts // {HOUR}) AS event_ts, trade_ts FROM trades WHERE code = 1""",
    "parse_bybit_provider": f"{TRADES} SELECT {SHOWN} FROM trades WHERE code = 1",
    "parse_okx": f"{TRADES} SELECT {SHOWN} FROM trades WHERE code = 2",
    "reject_malformed": f"""{TRADES}
        SELECT feed, outcome, count(*) AS n FROM (
            SELECT 'binance' AS feed, CASE WHEN {_K} < 3 THEN 'malformed' WHEN {_K} = 3 THEN 'bad_number'
                   WHEN {_K} = 4 THEN 'missing_field' WHEN {_K} = 5 THEN 'bad_number' ELSE 'accepted' END AS outcome FROM trades WHERE code = 0
            UNION ALL
            SELECT 'bybit', CASE WHEN {_K} < 2 THEN 'malformed' WHEN {_K} = 2 THEN 'missing_field' WHEN {_K} = 3 THEN 'bad_number' ELSE 'accepted' END
            FROM trades WHERE code = 1
            UNION ALL
            SELECT 'okx', CASE WHEN {_K} = 0 THEN 'not_trade' WHEN {_K} = 2 THEN 'malformed' WHEN {_K} = 3 THEN 'bad_number' ELSE 'accepted' END
            FROM trades WHERE code = 2
        ) GROUP BY feed, outcome""",
    "symbol_codecs": f"""{TRADES},
        names AS (
            SELECT DISTINCT instrument AS name FROM trades UNION ALL SELECT DISTINCT lower(instrument) || 'USDT' FROM trades
            UNION ALL SELECT DISTINCT exchange FROM trades
        ), okx AS (
            SELECT *, CASE WHEN instr(name, 'USDT') > 0
                THEN substr(name, 1, instr(name, 'USDT') - 1) || '-' || substr(name, instr(name, 'USDT')) ELSE name END AS okx_id FROM names
        )
        SELECT name, CASE name WHEN 'BTCUSDT' THEN 0 WHEN 'ETHUSDT' THEN 1 WHEN 'SOLUSDT' THEN 2 ELSE -1 END AS instrument_id,
               CASE WHEN name IN ('BTCUSDT', 'ETHUSDT', 'SOLUSDT') THEN name ELSE 'UNKNOWN' END AS instrument_name,
               CASE name WHEN 'BINANCE' THEN 0 WHEN 'BYBIT' THEN 1 WHEN 'OKX' THEN 2 ELSE -1 END AS exchange_code,
               CASE WHEN name IN ('BINANCE', 'BYBIT', 'OKX') THEN name ELSE 'UNKNOWN' END AS exchange_name,
               okx_id, replace(okx_id, '-', '') AS from_okx, upper(name) AS upper_name, lower(name) AS lower_name, name AS topic_symbol, '' AS no_topic
        FROM okx""",
    "subscribe_messages": f"""{TRADES}, s AS (SELECT DISTINCT instrument AS s FROM trades)
        SELECT 'binance' AS feed, '{{"method":"SUBSCRIBE","params":[' || string_agg('"' || lower(s) || '@trade"', ',' ORDER BY s) || '],"id":1}}' AS message FROM s
        UNION ALL SELECT 'bybit', '{{"op":"subscribe","args":[' || string_agg('"publicTrade.' || s || '"', ',' ORDER BY s) || ']}}' FROM s
        UNION ALL SELECT 'okx', '{{"op":"subscribe","args":[' || string_agg('{{"channel":"trades","instId":"' || replace(s, 'USDT', '-USDT') || '"}}', ',' ORDER BY s) || ']}}' FROM s""",
    "reconnect_schedule": f"""{TRADES},
        d AS (SELECT n AS attempt, CAST(least(1000 * pow(2, n - 1), 60000) AS BIGINT) AS delay_ms FROM range(1, 11) t(n)),
        a AS (SELECT *, sum(delay_ms) OVER (ORDER BY attempt) AS until FROM d),
        q AS (SELECT min(event_ts) % {HOUR} AS quiet FROM trades GROUP BY exchange, instrument, event_ts // {HOUR})
        SELECT attempt, delay_ms, count(*) AS made FROM a JOIN q ON until <= quiet GROUP BY ALL""",
    "split_list": f"""{TRADES}, t AS (
            SELECT trade_id, string_split(event_type || ',' || CASE WHEN trade_id % 3 = 0 THEN '' ELSE instrument END || CASE WHEN trade_id % 2 = 0 THEN ',' ELSE '' END, ',') AS x FROM trades
        ), u AS (SELECT trade_id, CASE WHEN x[-1] = '' THEN x[1:len(x) - 1] ELSE x END AS x FROM t)
        SELECT trade_id, CAST(generate_subscripts(x, 1) - 1 AS INT) AS pos, unnest(x) AS token FROM u""",
    "union_feeds": f"""{TRADES}
        SELECT {SHOWN}, recv_ts FROM trades WHERE code = 0 UNION ALL SELECT {SHOWN}, recv_ts FROM trades WHERE code = 1
        UNION ALL SELECT {SHOWN}, recv_ts FROM trades WHERE code = 2""",
    "replay_objects": f"{TRADES} SELECT {SHOWN} FROM trades WHERE code = 0",
    "candles_alltime": f"""{TRADES}
        SELECT CAST(instrument_id AS TINYINT) AS instrument_id, instrument, {CONSOLIDATED} AS exchange, CAST({HOUR} AS BIGINT) AS interval_ms,
               arg_min(event_ts - event_ts % {HOUR}, {FIRST}) AS window_start_ms, CAST(0 AS BIGINT) AS window_end_ms, {FOLD}
        FROM trades GROUP BY instrument_id, instrument""",
    "candles_windowed_exchange": _EACH_EXCHANGE,
    "candles_consolidated": _windowed(HOUR),
    "candles_universe": _windowed(DAY, "WHERE instrument IN ('BTCUSDT', 'SOLUSDT')"),
    "candles_multi_interval": " UNION ALL ".join(f"SELECT * FROM ({_windowed(i)})" for i in (HOUR, 4 * HOUR, DAY)),
    "running_candle": f"""{TRADES}
        SELECT instrument, trade_id, exchange, event_ts, first_value(event_ts - event_ts % {HOUR}) OVER r AS window_start_ms,
               first_value(price) OVER r AS open, max(price) OVER r AS high, min(price) OVER r AS low, price AS close,
               CAST(sum({_decimal("qty")}) OVER r AS DOUBLE) AS base_volume,
               CAST(sum({_decimal("price")} * {_decimal("qty")}) OVER r AS DOUBLE) AS quote_volume,
               {NAME.format("first_value(code) OVER r")} AS candle_exchange
        FROM trades WINDOW r AS {_RUN}""",
    "dedup_trades": f"""{TRADES}
        SELECT DISTINCT exchange, instrument, trade_id, price, qty, event_ts, trade_ts, recv_ts FROM trades
        UNION ALL SELECT CASE WHEN exchange = 'OKX' THEN 'BYBIT' ELSE 'OKX' END, instrument, trade_id, price, qty, event_ts, trade_ts, recv_ts FROM trades""",
    "run_counters": f"""{TRADES}
        SELECT count(*) AS trades_processed, (SELECT count(*) FROM (SELECT DISTINCT instrument, event_ts // {HOUR} FROM trades)) AS candles_emitted FROM trades""",
    "candles_stream_all": _windowed(HOUR),
    "candles_stream_closed": _windowed(HOUR, having=f"HAVING event_ts - event_ts % {HOUR} + {HOUR} <= (SELECT max(event_ts) FROM trades) - {2 * HOUR}"),
    "candles_stream_exchange": _EACH_EXCHANGE,
    "candle_callbacks": f"""{TRADES}
        SELECT count(*) AS candles, CAST(coalesce(sum(hour), 0) AS BIGINT) AS hours FROM (SELECT DISTINCT instrument, event_ts // {HOUR} AS hour FROM trades)
        WHERE hour * {HOUR} + {HOUR} <= (SELECT max(event_ts) FROM trades) - {2 * HOUR}""",
    "feed_candles": _windowed(HOUR, "WHERE trade_id % 50 <> 0"),
    "feed_rejects": f"""{TRADES}
        SELECT 'binance' AS feed, CASE WHEN trade_id % 50 = 0 THEN 'malformed' ELSE 'accepted' END AS outcome, 2 * count(*) AS n, 2 * count(*) AS stamped FROM trades WHERE code = 0 GROUP BY ALL
        UNION ALL SELECT 'bybit', 'accepted', 2 * count(*), 2 * count(*) FROM trades WHERE code = 1 AND trade_id % 50 <> 0
        UNION ALL SELECT 'bybit', 'not_trade', count(*), count(*) FROM trades WHERE code = 1
        UNION ALL SELECT 'okx', CASE WHEN trade_id % 50 = 0 THEN 'bad_number' ELSE 'accepted' END, 2 * count(*), 2 * count(*) FROM trades WHERE code = 2 GROUP BY ALL""",
    "feed_candles_stream": _windowed(HOUR, "WHERE trade_id % 50 <> 0"),
    "feed_candles_lagging": _windowed(HOUR, "WHERE trade_id % 50 <> 0"),
    "live_segments": f"{TRADES} SELECT {SHOWN} FROM trades WHERE code <> 1",
    "candles_rollover": f"""SELECT *, CASE WHEN window_end_ms <= last - {2 * HOUR} THEN 'closed' ELSE 'open' END AS kind
        FROM ({_windowed(HOUR)}), (SELECT max(epoch_us(ts) // 1000) AS last FROM events)""".replace("SELECT *, CASE", "SELECT * EXCLUDE (last), CASE"),
    "candles_multi_stream": " UNION ALL ".join(f"SELECT * FROM ({_windowed(i)})" for i in (HOUR, 4 * HOUR, DAY)),
    "stream_snapshot": _windowed(DAY, having=f"HAVING event_ts - event_ts % {DAY} + {DAY} > (SELECT max(event_ts) FROM trades) - {2 * HOUR}"),
    "stream_counters": f"""{TRADES},
        n AS (
            SELECT count(*) FILTER (code = 0 AND trade_id % 50 = 0) AS malformed, count(*) FILTER (code = 2 AND trade_id % 50 = 0) AS bad_number,
                   count(*) FILTER (code = 1) AS not_trade, count(*) FILTER (trade_id % 50 <> 0) AS trades FROM trades
        )
        SELECT outcome, CAST(n AS BIGINT) AS n FROM (
            SELECT 'malformed' AS outcome, 2 * malformed AS n FROM n UNION ALL SELECT 'bad_number', 2 * bad_number FROM n
            UNION ALL SELECT 'not_trade', not_trade FROM n UNION ALL SELECT 'trades', 2 * trades FROM n
            UNION ALL SELECT 'rows', 2 * (malformed + bad_number + trades) + not_trade FROM n
            UNION ALL SELECT 'missing_field', 0 UNION ALL SELECT 'bad_time', 0
        )""",
    "candles_revised": f"""{TRADES}, w AS (SELECT *, event_ts - event_ts % {HOUR} + {HOUR} AS w FROM trades),
        n AS (
            SELECT instrument, w, count(*) AS trades, count(*) FILTER (trade_id % 10 = 0 AND w <= (SELECT max(event_ts) FROM trades WHERE trade_id % 10 > 0) - {2 * HOUR}) AS late
            FROM w GROUP BY ALL
        )
        SELECT c.*, trades, late FROM ({_windowed(HOUR)}) c JOIN n ON n.instrument = c.instrument AND n.w = c.window_end_ms""",
    # number: of an instrument's ids, all new in the first run; each step tells whether the next one of the second run, in reverse, is forgotten
    "dedup_counted_stream": f"""{TRADES.replace("WITH", "WITH RECURSIVE")},
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY code, instrument ORDER BY recv_ts, event_ts, trade_id) AS number,
                   row_number() OVER (PARTITION BY code, instrument ORDER BY recv_ts DESC, event_ts, trade_id) AS place FROM trades
        ),
        steps(code, instrument, place, n, again) AS (
            SELECT code, instrument, CAST(0 AS BIGINT), count(*), FALSE FROM trades GROUP BY ALL
            UNION ALL
            SELECT code, instrument, p.place, n + CAST(p.number <= n // 500 * 500 - 4 AS BIGINT), p.number <= n // 500 * 500 - 4
            FROM steps JOIN placed p USING (code, instrument) WHERE p.place = steps.place + 1
        )
        SELECT {SHOWN}, recv_ts FROM trades
        UNION ALL SELECT {SHOWN}, 4000000000000 - recv_ts FROM placed JOIN (SELECT code, instrument, place FROM steps WHERE again) USING (code, instrument, place)""",
}
