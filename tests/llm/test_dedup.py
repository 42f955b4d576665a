import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import exactdedup, setsketch
from tickloom.llm.common import WordHasher, joined

DOCS = "doc_id long, text string, lang string, _id long, rest string, n_lines int, band long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", i, "x", 1, 1) for i, t in rows], DOCS)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows, size, percent=80):
    sets = {i: shingles(t, size) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sets, label


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 80))] for _ in range(8)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_match_brute_force(spark, size):
    rows = [*corpus(size), (500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "One\ttwo"), (505, "one two three")]
    sets, label = brute_components(rows, size)
    found = {r.doc_id: r for r in setsketch.near_duplicates(spark, frame(spark, rows), size, 80).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def test_large_bucket_of_near_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 4])):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((i + 1000, " ".join(words)))
    rows.append((7, " ".join(base)))
    _, label = brute_components(rows, 5)
    found = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark, frame(spark, rows)).collect()}
    assert found == label


def families(seed, n):
    """Copies with 0 to 40 of 120 words replaced, most from the text itself, others from a few that were replaced alike before."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    seeds = [base]
    rows = []
    for i in range(n):
        words = list(rng.choice(seeds) if rng.random() < 0.5 else base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 8, 12, 40])):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.05:
            seeds.append(words)
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize(("seed", "small", "levels"), [(1, 16, 6), (2, 2, 6), (3, 2, 1), (4, 1, 0)])
def test_near_copies_beyond_the_threshold(spark, monkeypatch, seed, small, levels):
    monkeypatch.setattr(setsketch, "SMALL", small)
    monkeypatch.setattr(setsketch, "LEVELS", levels)
    monkeypatch.setattr(setsketch, "ROWS_A_SALT", 50)
    rows = families(seed, 260)
    _, label = brute_components(rows, 4)
    assert len(set(label.values())) > 20
    found = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark, frame(spark, rows), 4).collect()}
    assert found == label


def test_finer_buckets_leave_few_pairs(spark):
    """Every linked pair of a large bucket is proven by its hub or a candidate, and candidates grow with the rows, not their square."""
    made = []
    for n in (300, 1200):
        sets = {i: setsketch.shingle_sets(*joined([t.encode()]), 4, WordHasher())[0] for i, t in families(9, n)}
        rows = spark.createDataFrame([(1, i, len(s), n) for i, s in sets.items()], "band long, id long, n long, g long")
        packed = spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in sets.items()], "key long, set binary")
        proven, pairs, large = (x.collect() for x in setsketch._finer(spark, rows, packed, 80))
        near = [(a, b) for a in sets for b in sets if a < b and 9 * len(np.setxor1d(sets[a], sets[b])) <= len(sets[a]) + len(sets[b])] if n == 300 else []
        hub = next(iter({proven[0].a, proven[0].b} & {proven[1].a, proven[1].b}))
        star, found = {x for r in proven for x in (r.a, r.b)} | {hub}, {(r.a, r.b) for r in pairs}
        together = defaultdict(set)
        for r in large:
            together[r.band].add(r.id)
        for a, b in near:
            assert {a, b} <= star or (a, b) in found or any({a, b} <= m for m in together.values())
        made.append(len(pairs) + len(large))
    assert made[1] < 16 * made[0] / 2


def test_near_duplicates_odd_rows(spark):
    docs = frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (None, None)])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in setsketch.near_duplicates(spark, docs).collect())
    assert got == Counter({(None, None, True): 2, (3, 3, True): 1, (9, 3, False): 2})
    stays = setsketch.keep_representatives(spark, docs)
    assert stays.columns == docs.columns and sorted((r.doc_id or 0) for r in stays.collect()) == [0, 0, 3]
    assert setsketch.near_duplicates(spark, docs.limit(0)).count() == 0


def test_near_duplicates_of_texts_that_repeat_an_id(spark):
    x, y = ([f"{c}{i}" for i in range(60)] for c in "xy")
    near = lambda w: " ".join([*w[:-1], "else"])
    # equal sizes, one id: each text has a link of its own, and they aren't linked with each other
    rows = [(5, " ".join(x)), (5, " ".join(y)), (8, near(x)), (9, near(y)), (3, " ".join(["also", *y[1:]]))]
    found = Counter((r.doc_id, r.component_id, r.kept) for r in setsketch.near_duplicates(spark, frame(spark, rows)).collect())
    assert found == Counter({(5, 5, True): 1, (5, 3, False): 1, (8, 5, False): 1, (9, 3, False): 1, (3, 3, True): 1})


def test_rows_that_stay_are_told_by_id_and_text(spark):
    rows = [(5, "x"), (5, "y"), (9, "x"), (None, "x"), (None, "z"), (None, "z"), (7, "t"), (7, "t"), (None, "y")]
    docs = frame(spark, rows)
    stays = exactdedup.keep_first(spark, docs)
    assert stays.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in stays.collect()) == Counter([(5, "y"), (9, "x"), (None, "z"), (7, "t")])
    x = [f"x{i}" for i in range(60)]
    near = [" ".join([*x[:-1], e]) for e in ("a", "b", "c")]
    rows = [(3, near[0]), (5, near[1]), (5, "other"), (6, near[2]), (8, "same"), (8, "same")]
    assert Counter((r.doc_id, r.text) for r in setsketch.keep_representatives(spark, frame(spark, rows)).collect()) == Counter([(3, near[0]), (5, "other"), (8, "same")])
    rows = [(5, near[0]), (5, near[1]), (5, ""), (5, "other")]
    found = [r.text for r in setsketch.keep_representatives(spark, frame(spark, rows)).collect()]
    assert len(found) == 3 and {"", "other"} < set(found)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 1000, np.uint64)) for _ in range(2))
    shared = np.unique(np.concatenate([a[:800], b[:100]]))
    k = setsketch.sketches([a, b, np.union1d(a, b), shared])
    assert (setsketch.merge(k[0], k[1]) == k[2]).all()
    true = len(np.intersect1d(a, shared)) / len(np.union1d(a, shared))
    estimate = setsketch.similarity(k[:1], k[3:], np.array([len(a)]), np.array([len(shared)]))[0]
    assert abs(estimate - true) < 0.12
    assert setsketch.similarity(k[:1], k[:1], np.array([1000]), np.array([1000]))[0] > 0.98


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102)], "a long, b long")
    assert {r.id: r.label for r in setsketch.components(spark, edges).collect()} == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAb \t\n\x0bé"), max_size=30), min_size=1, max_size=6))
def test_shingle_sets_match_words(texts):
    data, off = joined([t.encode() for t in texts])
    for t, s in zip(texts, setsketch.shingle_sets(data, off, 2, WordHasher()), strict=True):
        assert len(s) == len(shingles(t, 2))


def test_minimal_perfect_hash():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 5, 1000, 20_000):
        keys = rng.integers(0, 2**63, (n, 4), np.uint64)
        mph = exactdedup.MinimalPerfectHash(keys)
        assert sorted(mph.slots(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        exactdedup.MinimalPerfectHash(np.concatenate([keys, keys[:1]]))


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return Counter(out)


def test_exact_dedup_matches_brute_force(spark):
    rows = [(i, f"text {i % 7}" if i % 3 else f"own {i}") for i in range(200)] + [(2**60 + 1, "text 1"), (None, "text 2"), (None, "alone"), (300, None), (301, ""), (302, "É"), (302, "É")]
    docs = frame(spark, rows)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.exact_dedup(spark, docs).collect())
    assert got == brute_exact(rows)
    stays = exactdedup.keep_first(spark, docs)
    assert stays.columns == docs.columns
    assert exactdedup.exact_dedup(spark, docs.limit(0)).count() == 0


def test_exact_dedup_salts_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "ROWS_A_TASK", 10)
    rows = [(i, "hot" if i % 3 else f"t{i}") for i in range(90)]
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.exact_dedup(spark, frame(spark, rows)).collect())
    assert got == brute_exact(rows)


def test_exact_dedup_against_a_history(spark):
    # of two corpora: a digest that both have comes twice
    history = exactdedup.history_of(frame(spark, [(1, "old"), (3, "older")])).unionByName(exactdedup.history_of(frame(spark, [(2, "old")])))
    found = exactdedup.exact_dedup(spark, frame(spark, [(10, "old"), (11, "new"), (12, "new"), (13, "single")]), history)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in found.collect()} == {10: (2, 2, False), 11: (12, 2, False), 12: (12, 2, True), 13: (13, 1, True)}


def test_very_long_texts(spark):
    """Two texts of 200,000 words that differ in ten places, and one of a million bytes without a blank, twice."""
    words = [f"w{i}" for i in range(200_000)]
    other = list(words)
    for k in range(10):
        other[k * 19_000] = "x"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, "y" * 1_000_000), (4, "y" * 1_000_000), (5, " ".join(words[:100_000]))]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in setsketch.near_duplicates(spark, frame(spark, rows), 4).collect()}
    assert found == {1: (199_997, 1), 2: (199_997, 1), 3: (1, 3), 4: (1, 3), 5: (99_997, 5)}
    got = {r.doc_id: (r.keep_id, r.kept) for r in exactdedup.exact_dedup(spark, frame(spark, rows)).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (4, False), 4: (4, True), 5: (5, True)}
    assert sorted(r.doc_id for r in setsketch.keep_representatives(spark, frame(spark, rows)).collect()) == [1, 3, 5]
