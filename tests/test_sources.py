import os
import random

import pytest

from tickloom.sources import replay, segments


def brute(text):
    out, parts, depth = [], [], 0
    for line in text.removesuffix("\n").split("\n"):
        if not parts:
            if "{" not in line:
                continue
            line = line[line.index("{") :]
        parts.append(line)
        depth += line.count("{") - line.count("}")
        if depth == 0:
            out.append("\n".join(parts) + "\n")
            parts = []
    return out


def noise(rng, n):
    return ["".join(rng.choice(["{", "}", "{", "}", "é", "", '"'] if rng.random() < 0.7 else ["x"]) for _ in range(rng.randint(0, 5))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_splits_compose(seed):
    rng = random.Random(seed)
    for _ in range(1500):
        lines = noise(rng, rng.randint(0, 14))
        at = sorted(rng.sample(range(len(lines) + 1), min(len(lines) + 1, rng.randint(0, 4))))
        parts = [p for p in (lines[a:b] for a, b in zip([0, *at], [*at, len(lines)], strict=True)) if p]
        found = []
        for i, part in enumerate(parts):
            total, fresh, hits = replay.summary(part)
            found.append({"file": 1, "start": i, "total": total, "fresh": fresh, "depths": list(hits), "ends": list(hits.values())})
        got, pieces = [], {}
        for (_, start, state, origin, closes), part in zip(replay.scan(found), parts, strict=True):
            for kind, text in replay.cut(part, state):
                if kind == "whole":
                    got.append(text)
                elif kind == "head" or closes:
                    pieces.setdefault(start if kind == "tail" else origin, []).append(text)
        assert sorted(got + ["".join(p) for p in pieces.values()]) == sorted(brute("\n".join(lines)))


def test_captures_are_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(9)
    texts = []
    for k in range(3):
        lines = ["# begins"]
        for i in range(1500):
            lines += [f'{{"id": {k * 10_000 + i},', *(f'  "x{j}": {{"é": [{j}]}},' for j in range(rng.randint(0, 4))), '"end": {}}', "", "not {balanced}} at all{" if i % 500 == 499 else "between"]
        # one object over several splits, and one that never ends
        lines += ['{"long":', *("  1," for _ in range(9000)), "0}", '{"open": ', *("  2," for _ in range(6000))]
        texts.append("\n".join(lines) + "\n" * (k % 2))
        (tmp_path / f"{k}.json").write_text(texts[-1])
    (tmp_path / "empty.json").write_text("")
    before = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for c, size in zip(before, ("4096", "1024"), strict=True):
            spark.conf.set(c, size)
        found = replay.json_objects(spark, f"file://{tmp_path}")
        got = sorted(r.value for r in found.collect())
        tasks = replay._splits(spark, f"file://{tmp_path}").rdd.getNumPartitions()
    finally:
        for c, size in before.items():
            spark.conf.set(c, size)
    assert got == sorted(x for t in texts for x in brute(t)) and tasks > 30
    assert sorted(r.value for r in replay.json_objects(spark, f"file://{tmp_path}").collect()) == got


def land(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    (folder / f".{name}").write_text("\n".join(lines) + "\n")
    os.rename(folder / f".{name}", folder / name)


def start(spark, tmp_path, sink, **options):
    raw = segments.segments(spark, f"file://{tmp_path}/in", **options)
    return raw.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()


def test_segments_come_once_and_are_freed(spark, tmp_path):
    got = []

    def keep(frame, batch):
        got.extend((batch, r.feed, r.segment, r.line, r.value) for r in frame.collect())

    def fail(frame, batch):
        frame.count()
        raise RuntimeError("stopped")

    root = tmp_path / "in"
    land(root / "okx", "0001.txt", ["a", "", "b"])
    land(root / "binance" / "lane1", "0001.txt", ["c\r", "é"])
    land(root / "binance" / "lane2", "0005.txt", ["d"])
    land(root / "binance" / "lane2", "_hidden", ["no"])
    with pytest.raises(Exception, match="stopped"):
        start(spark, tmp_path, fail).awaitTermination()
    assert sum(map(len, segments.backlog(f"file://{root}").values())) == 3
    # lands after the failure: the failed batch is made again without it
    land(root / "okx", "0002.txt", ["e"])
    start(spark, tmp_path, keep).awaitTermination()
    assert {x[0] for x in got if x[4] != "e"} == {0} and 0 not in {x[0] for x in got if x[4] == "e"}
    land(root / "binance" / "lane1", "0002.txt", ["f"])
    start(spark, tmp_path, keep, per_task=1).awaitTermination()
    assert sorted(x[4] for x in got) == ["a", "b", "c", "d", "e", "f", "é"]
    assert {x[1:4] for x in got if x[4] in "bd"} == {("okx", "okx/0001.txt", 2), ("binance", "binance/lane2/0005.txt", 0)}
    left = segments.backlog(f"file://{root}")
    # those of the last batch go when the next one is planned
    assert left == {"binance/lane1": ["0002.txt"], "okx": ["0002.txt"]}


def test_segments_that_stay(spark, tmp_path):
    got = []
    land(tmp_path / "in" / "okx", "1.txt", ["a"])
    for _ in range(2):
        start(spark, tmp_path, lambda frame, _: got.extend(r.value for r in frame.collect()), free="false").awaitTermination()
    assert got == ["a"] and segments.backlog(f"{tmp_path}/in") == {"okx": ["1.txt"]}


def test_admission(tmp_path):
    for i in range(5):
        land(tmp_path / "okx", f"{i}.txt", ["x"])
    reader = segments.SegmentReader(f"{tmp_path}", per_trigger=2, per_task=1)
    first = reader.latestOffset()
    assert first == {"okx": "1.txt"}
    assert [p.names for p in reader.partitions({}, first)] == [["0.txt"], ["1.txt"]]
    assert reader.latestOffset() == {"okx": "3.txt"}
    reader.commit(first)
    assert segments.backlog(str(tmp_path)) == {"okx": ["2.txt", "3.txt", "4.txt"]}
    assert segments.SegmentReader(str(tmp_path), per_trigger=2).latestOffset() == {"okx": "3.txt"}
    with pytest.raises(ValueError):
        segments.SegmentReader("x", per_task=0)
