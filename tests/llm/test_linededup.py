import random
import re
import time
from collections import Counter

import pytest

from tickloom.llm import linededup

DOCS = "doc_id long, text string, lang string, rest string, runs int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], DOCS)


def brute_words(rows, n):
    """Words in windows of n words that occur earlier, by comparing all windows."""
    words = {i: re.findall(r"\S+", t) for i, t in rows}
    places = {}
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            key = tuple(w[k : k + n])
            places[key] = min(places.get(key, (i, k)), (i, k))
    gone = {i: {k + j for k in range(len(w) - n + 1) if places[tuple(w[k : k + n])] < (i, k) for j in range(n)} for i, w in words.items()}
    texts = {}
    for i, t in rows:
        pieces = re.findall(r"\s*\S+", t)
        texts[i] = "".join(p for k, p in enumerate(pieces) if k not in gone[i]) + t[len("".join(pieces)) :]
    return texts, gone, words


@pytest.mark.parametrize(("seed", "rates"), [(0, (32, 8, 2)), (1, (4, 2)), (2, (8, 2)), (3, (2,)), (4, ())])
def test_line_dedup_matches_brute_force(spark, monkeypatch, seed, rates):
    monkeypatch.setattr(linededup, "RATES", rates)
    rng = random.Random(seed)
    pool = [[f"{k}{j}" for j in range(rng.randint(2, 14))] for k in range(6)] + [["a"], ["b"]]
    rows = []
    for i in range(30):
        words = [w for _ in range(rng.randint(0, 9)) for w in rng.choice(pool)][rng.randint(0, 3) :]
        rows.append((i, "".join(w + rng.choice([" ", " ", "\n", " \n "]) for w in words)))
    texts, gone, _ = brute_words(rows, 6)
    docs = frame(spark, rows)
    found = linededup.line_dedup(spark, docs, 6)
    assert found.columns == [*docs.columns, "n_removed"]
    for r in found.collect():
        assert (r.text, r.n_removed) == (texts[r.doc_id], len(gone[r.doc_id])), r.doc_id
    assert sum(map(len, gone.values()))


def test_passages_within_lines(spark):
    long = " ".join(f"w{i}" for i in range(50))
    parted = long.replace(" w20 ", "\nw20 ").replace(" w40 ", "\nw40 ")
    u = " ".join(f"u{i}" for i in range(50))
    rows = [(1, f"one line with {long} within it"), (2, f"another {long} line"), (3, f"begins {parted} ends"), (4, long.replace("w25 ", "")), (None, long), (None, long), (5, None), (6, ""), (7, f"x {u}"), (7, f"y z {u}")]
    got = Counter((r.doc_id, r.text, r.n_removed) for r in linededup.line_dedup(spark, frame(spark, rows)).collect())
    assert sum(n for (i, _, cut), n in got.items() if i == 7 and cut == 50) == 1
    assert Counter({k: n for k, n in got.items() if k[0] != 7}) == Counter({(1, rows[0][1], 0): 1, (2, "another line", 50): 1, (3, "begins ends", 50): 1, (4, rows[3][1], 0): 1, (None, "", 50): 2, (5, None, 0): 1, (6, "", 0): 1})
    found = linededup.line_dedup(spark, frame(spark, rows).limit(0))
    assert found.count() == 0 and not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


def test_words_parted_by_other_white_space_or_none(spark):
    rows = []
    for blank in ("\t", "\u00a0", "\u3000", "\u2009"):
        long = blank.join(f"w{ord(blank)}_{i}" for i in range(50))
        rows += [(len(rows), f"a {long}{blank}b"), (len(rows) + 1, f"c {long}{blank}d")]
    for first in (0x4E00, 0xE01):
        long = "".join(chr(first + i) for i in range(50))
        rows += [(len(rows), f"a{long}b"), (len(rows) + 1, f"c{long}d")]
    got = {r.doc_id: (r.text, r.n_removed) for r in linededup.line_dedup(spark, frame(spark, rows)).collect()}
    assert got == {i: (t, 0) if i % 2 == 0 else (f"c{t[-2] if i < 8 else ''}d", 50) for i, t in rows}


def test_long_texts_take_linear_time(spark):
    """100,000 lines each, among them one run of 60 that the second has from the first, one word over and over, and no break at all."""
    first = [f"l{i} l{i + 1}" for i in range(100_000)]
    second = [f"m{i}" for i in range(50_000)] + first[500:560] + [f"n{i}" for i in range(50_000)]
    rows = [(1, "\n".join(first)), (2, "\n".join(second)), (3, "For " * 100_000), (4, "x" * 1_000_000)]
    began = time.perf_counter()
    got = {r.doc_id: (r.n_removed, len(r.text or "")) for r in linededup.line_dedup(spark, frame(spark, rows)).collect()}
    assert time.perf_counter() - began < 60
    assert {i: n for i, (n, _) in got.items()} == {1: 0, 2: 120, 3: 99_999, 4: 0}
    assert got[2][1] == len("\n".join(second)) - sum(len(x) + 1 for x in first[500:560])


def test_every_window_selects_one_place(spark):
    """Stretches part the windows, and equal windows have equal fingerprints."""
    rng = random.Random(8)
    words = [rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(1200)] + ["same"] * 300
    words += words[100:400]
    s = linededup._stretches(spark.createDataFrame([(1, 1, " ".join(words))], "doc long, tie long, text string"), 50).collect()
    place = {i: x.f for x in s for i in range(x.a, x.b + 1)}
    assert sum(x.b - x.a + 1 for x in s) == len(place) == len(words) - 49
    seen = {}
    for i, f in place.items():
        assert seen.setdefault(tuple(words[i : i + 50]), f) == f
    assert sum(x.a < 1150 for x in s) < 1150 / 8
