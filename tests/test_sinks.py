import json
import os

import pytest
from pyspark.sql import Observation

from tickloom.operators import parsers
from tickloom.sources import feeds
from tickloom.streaming import sinks


def message(i, price):
    return json.dumps({"e": "trade", "E": 1000 + i, "s": "btcusdt", "t": i, "p": price, "q": "1", "T": 1000 + i})


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def push(spark, tmp_path, source, name):
    spark.dataSource.register(source)
    trades = parsers.accepted(parsers.parse(feeds.landing(spark, f"file://{tmp_path}/in", 1), "binance_raw")).select("trade_id", "price").repartition(4)
    query = trades.writeStream.format(name).option("path", f"file://{tmp_path}/inbox").option("checkpointLocation", f"file://{tmp_path}/checkpoint")
    query.trigger(availableNow=True).start().awaitTermination()


def test_a_failing_task_delivers_nothing_twice(spark, tmp_path):
    mark = str(tmp_path / "failed")

    class Failing(sinks.Push):
        @classmethod
        def name(cls):
            return "failing_push"

        def streamWriter(self, schema, overwrite):  # noqa: N802
            def check(row):
                # once, in the second micro-batch, after some rows are written
                if row["trade_id"] == 37 and not os.path.exists(mark):
                    open(mark, "w").close()
                    raise RuntimeError("lost")

            return sinks.PushWriter(self.options["path"], schema, overwrite, check)

    for k in range(3):
        land(tmp_path / "in", f"{k}.txt", [message(i, f"{i / 7!r}") for i in range(20 * k, 20 * k + 20)])
    with pytest.raises(Exception, match="lost"):
        push(spark, tmp_path, Failing, "failing_push")
    inbox = f"file://{tmp_path}/inbox"
    assert [b for b, _ in sinks.deliveries(inbox)] == [0]
    push(spark, tmp_path, Failing, "failing_push")
    got = {b: sorted(r["trade_id"] for r in rows) for b, rows in sinks.deliveries(inbox)}
    assert got == {k: list(range(20 * k, 20 * k + 20)) for k in range(3)}
    assert [b for b, _ in sinks.deliveries(inbox, 1)] == [2]
    rows = sinks.delivered(spark, inbox, "trade_id bigint, price double").collect()
    assert sorted(map(tuple, rows)) == [(i, i / 7) for i in range(60)]
    # what the failed attempts wrote is listed nowhere
    lost = sinks.sweep(inbox)
    assert lost <= 4 and sinks.sweep(inbox) == 0
    assert sinks.delivered(spark, inbox, "trade_id bigint, price double").count() == 60


def test_a_batch_that_is_committed_again(spark, tmp_path):
    land(tmp_path / "in", "0.txt", [message(1, "5")])
    push(spark, tmp_path, sinks.Push, "push")
    # the query stopped after the delivery and before its own log had it: the batch is run again
    for name in ("0", ".0.crc"):
        os.remove(tmp_path / "checkpoint" / "commits" / name)
    push(spark, tmp_path, sinks.Push, "push")
    assert [(b, list(rows)) for b, rows in sinks.deliveries(str(tmp_path / "inbox"))] == [(0, [{"trade_id": 1, "price": 5.0}])]
    assert sinks.sweep(str(tmp_path / "inbox")) == 0
    assert sinks.delivered(spark, f"file://{tmp_path}/none", "a int").count() == 0


def test_counters_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    for k in range(2):
        land(tmp_path / "in", f"{k}.txt", [message(k, "5"), "nope", message(9, "x"), '{"e":"other"}', *["nope"] * k])
    counters = sinks.Counters("outcomes")
    spark.streams.addListener(counters)
    try:
        for run in range(2):
            raw = feeds.landing(spark, f"file://{tmp_path}/in", 1)
            found = sinks.observed(parsers.parse(raw, "binance_raw"), "outcomes")
            found.writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
            counters.wait(run + 1)
    finally:
        spark.streams.removeListener(counters)
    seen = Observation("outcomes")
    sinks.observed(parsers.parse(feeds.landed(spark, f"file://{tmp_path}/in"), "binance_raw"), seen).write.format("noop").mode("overwrite").save()
    assert counters.totals == seen.get and counters.totals["trades"] == 2 and counters.totals["malformed"] == 3
    assert counters.input_rows == 9 and len(counters.totals) == 2 + len(sinks.REASONS)
