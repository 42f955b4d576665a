import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash

from tickloom.llm import common, divergence, filteraudit, setsketch, simhash

DOCS = "doc_id long, text string, lang string, source string, n long, rest string, total string, part string, term string"


def frame(spark, rows):
    """(doc_id, text, lang, source), with other columns whose names the operators use."""
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "t") for r in rows], DOCS)


# source divergence


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_divergence(rows, top=200):
    docs = [(lang or "", source or "", terms_of(text)) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        seen = Counter(t for x, _, words in docs if x == lang for t in set(words))
        kept = sorted(t for t, n in seen.items() if n >= 3)
        counts = {s: Counter() for x, s, _ in docs if x == lang}
        for x, s, words in docs:
            if x == lang:
                counts[s].update(w for w in words if w in set(kept))
        whole = sum(counts.values(), Counter())

        def share(c, kept=kept):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        shares, q = {s: share(c) for s, c in counts.items()}, share(whole)

        def ranked(part, source, values):
            order = sorted(values, key=lambda x: (-x[1], x[0].encode()))
            return {(lang, source, part, item, value, k) for k, (item, value) in enumerate(order, 1) if part == "pair" or k <= top}

        for s, p in shares.items():
            out |= ranked("pair", s, [(o, sum((p[t] - r[t]) ** 2 // r[t] for t in kept)) for o, r in shares.items() if o != s])
            out |= ranked("term", s, [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[t] > q[t]])
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "The", "a", "Été", "été", "naïve", "x9y", "don't", "straße", "日本語", "ab", "abc", "zz", "é" * 90] + [f"w{c}{d}" for c in "abcdef" for d in "ghi"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "\n", "-", "\x00"]) for _ in range(rng.randint(0, 30)))
        rows.append((i, text, rng.choice(["en", "en", "fr", None]), rng.choice(["s1", "s1", "s2", "é", "S3", None])))
    return [*rows, (None, None, "de", "s1"), (7, "", "de", None), (7, "lone", "xx", "s1"), (8, "the " * 20_000, "en", "s2")]


@pytest.mark.parametrize(("head", "block", "piece", "pairs"), [(200_000, 1, 1 << 20, 1 << 20), (5, 40, 64, 3), (0, 10_000, 7, 1), (12, 100, 300, 50)])
def test_divergence_matches_brute_force(spark, monkeypatch, head, block, piece, pairs):
    for name, value in (("HEAD_TERMS", head), ("BLOCK_BYTES", block), ("PIECE", piece), ("PAIRS", pairs), ("HELD", 20), ("CODES", 5), ("WORDS_BYTES", 100 if head else 1 << 20), ("WAITING", 500)):
        monkeypatch.setattr(divergence, name, value)
    rows = corpus(head)
    found = divergence.source_divergence(spark, frame(spark, rows).repartition(3))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute_divergence(rows)


def test_divergence_of_little(spark):
    assert divergence.source_divergence(spark, frame(spark, []).limit(0)).count() == 0
    rows = [(1, None, None, None), (2, "a b", None, "s"), (3, "a b", None, "t"), (4, "c", "en", "s")]
    got = {tuple(r) for r in divergence.source_divergence(spark, frame(spark, rows)).collect()}
    assert got == brute_divergence(rows) and {r[4] for r in got} == {0}


def test_shares_of_large_counts(spark):
    found = spark.sql("select 9000000000000000000L as n, 9100000000000000000L as total, 5L as v").select(divergence._share(divergence.F.col("n"))).first()[0]
    assert found == 1 + 10**9 * (9 * 10**18 + 1) // (91 * 10**17 + 5)


def test_automaton_finds_whole_terms_only():
    terms = [b"ab", b"abc", b"b", "é".encode()]
    text = " abc ab  b éb é ab ab a ".encode()
    counts = Counter()
    for at, piece, ends, numbers in divergence.search(divergence.automaton(terms), text):
        counts.update(terms[i] for i in numbers.tolist())
        words, starts = divergence.left_over(piece, ends)
        assert [text[at + s : at + s + len(w)] for s, w in zip(starts, words, strict=True)] == words == ["éb".encode(), b"a"]
    assert counts == {b"ab": 3, b"abc": 1, b"b": 1, "é".encode(): 1}


# filter interactions


def brute_filters(rows, labels):
    docs = []
    for i, (doc_id, text, lang, _) in enumerate(rows):
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        key = lambda x: 1 << 70 if x is None else x
        fails = {"A"} if len(w) < 100 else set()
        fails |= {"B"} if 100 * len(set(w)) < 80 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if any((x[1] or "") == t and key(x[0]) < key(doc_id) for x in rows) else set()
        mine = [x for x in labels if x[0] is not None and x[0] == doc_id]
        docs.append((i, lang or "", fails, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {d[1] for d in docs}:
        own, share, found = [d for d in docs if d[1] == part], Counter(), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                share[f] += len(gone)
                failing = [d for d in own if f in d[2]]
                found.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[2] == {f} for d in own), sum(d[3] for d in gone), sum(d[4] for d in gone)))
        out += [(*x, share[x[1][x[2] - 1]]) for x in found]
    return out


def test_filter_interactions_match_brute_force(spark):
    rng = random.Random(5)
    bodies = [" ".join(rng.choice(["one", "two", "TWO", "a#b", "x"]) + str(rng.randint(0, k)) for _ in range(n)) for n, k in ((99, 500), (100, 500), (120, 30), (150, 10_000), (3, 2), (101, 101))]
    bodies += ["", " \t\n", "ABC def", "ÀÉ abc", "100 %", " one" * 120, "a\x0bb\x1cc " * 60]
    rows = [(rng.randint(0, 90), rng.choice([None, *bodies]), rng.choice(["en", "fr", None, ""]), "s") for _ in range(80)] + [(None, bodies[0], "en", "s"), (None, bodies[0], "fr", "s"), (None, "nowhere else", "fr", "s"), (-5, bodies[1], "en", "s")]
    labels = [(rng.choice([None, *range(90)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filteraudit.filter_interactions(spark, frame(spark, rows).repartition(3), marks).collect()]
    assert sorted(got) == sorted(brute_filters(rows, labels))
    assert filteraudit.filter_interactions(spark, frame(spark, []).limit(0), marks).count() == 0
    without = filteraudit.filter_interactions(spark, frame(spark, rows), marks.limit(0)).collect()
    assert [(r.good_lost, r.toxic_lost) for r in without] == [(0, 0)] * len(got)


def test_zeta():
    counts = np.random.default_rng(1).integers(0, 9, (32, 3))
    for t, left in enumerate(filteraudit.survivors(counts)):
        assert (left == sum(counts[m] for m in range(32) if not m & t)).all()


# simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points):
    """The smallest place that each reaches by links of 4 bits or fewer."""
    label = list(range(len(points)))
    moved = True
    while moved:
        moved = False
        for i, x in enumerate(points):
            least = min(label[j] for j, y in enumerate(points) if (x ^ y).bit_count() <= 4)
            moved, label[i] = moved or least < label[i], least
    return label


def test_fingerprints(spark):
    rng = random.Random(2)
    texts = [None, "", " \n", "One", "one two\tTHREE", "É é a b c", "a b c d " * 9000, " x y z w v", *(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(60))]
    found = {r.doc_id: r.fp % (1 << 64) for r in simhash.fingerprints(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert found == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("small", [0, 1, 3, 256])
def test_links_within_four_bits(spark, small):
    rng = random.Random(small)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(64), n))
    points = [0, (1 << 64) - 1, 1 << 63, 0xF]
    for _ in range(12):
        points.append(rng.getrandbits(64))
        for _ in range(rng.randint(0, 8)):
            points.append(flip(rng.choice(points[-4:]), rng.randint(1, 6)))
    points = list(dict.fromkeys(points))
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in points]
    pairs = simhash.links(spark, spark.createDataFrame(signed, "fp long"), small).collect()
    number = {s[0]: i for i, s in enumerate(signed)}
    near = {frozenset((i, j)) for i, x in enumerate(points) for j, y in enumerate(points[:i]) if (x ^ y).bit_count() <= 4}
    made = [frozenset((number[r.a], number[r.b])) for r in pairs]
    assert set(made) <= near
    if small == 256:
        assert set(made) == near and len(made) == len(near)
    reached = defaultdict(set)
    for a, b in made:
        reached[a].add(b)
        reached[b].add(a)
    label = brute_components(points)
    for i in range(len(points)):
        seen, todo = {i}, [i]
        while todo:
            for j in reached[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert min(seen) == label[i]


def test_links_of_a_family_are_not_its_pairs(spark):
    # all within 4 bits of each other
    points = random.Random(5).sample(simhash.ball(64, 2), 200)
    every = simhash.links(spark, spark.createDataFrame([(simhash._signed(p),) for p in points], "fp long")).cache()
    made = simhash.contracted(simhash.contracted(every)).collect()
    assert len(made) < 3 * len(points) and every.count() < len(points) ** 2 / 4
    reached = {made[0].a}
    for _ in range(len(points)):
        reached |= {x for r in made if r.a in reached or r.b in reached for x in r}
    assert len(reached) == len(points)


def test_links_within_a_key():
    rng = random.Random(6)
    points = np.array(list({0, 1, 3, *(sum(1 << b for b in rng.sample(range(62), 6)) for _ in range(40)), *(7 << 40 | 1 << b for b in range(20))}), np.int64)
    for paired in (0, 100):
        a, b = simhash.linked(points, paired)
        assert all((x ^ y).bit_count() <= 4 for x, y in zip(a.tolist(), b.tolist(), strict=True)) or not paired
        label = {p: p for p in points.tolist()}
        for _ in points:
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                label[x] = label[y] = min(label[x], label[y])
        want = brute_components(points.tolist())
        assert Counter(Counter(label.values()).values()) == Counter(Counter(want).values())
        assert paired or len(a) < len(points)


def test_large_labels_are_not_broadcast(spark, monkeypatch):
    side = spark.range(5000)
    plan = lambda: spark.range(9).join(common.not_broadcast(side, 5000), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan()
    monkeypatch.setattr(common, "BROADCAST_ROWS", 40_000)
    assert "Broadcast" not in plan()


def test_no_join_of_links_or_components_is_broadcast(spark, monkeypatch):
    plans = {}

    def staged(spark, df, tag):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return common.stage_out(spark, df, tag)

    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(setsketch, "stage_out", staged)
    monkeypatch.setattr(simhash, "stage_out", staged)
    body = " ".join(f"w{k}" for k in range(900))
    rows = [(i, f"{body} end{i}", "en", "s") for i in range(30)]
    plans["result"] = simhash.similar_documents(spark, frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    joined = {tag: plan for tag, plan in plans.items() if "Join" in plan and tag != "members"}
    assert {"moved", "labels", "placed", "result"} <= joined.keys() and not any("Broadcast" in plan for plan in joined.values())
    # of large keys every member has 2,081 points, which aren't either
    dense = simhash.links(spark, spark.createDataFrame([(x,) for x in range(8)], "fp long"), 1)
    assert "Broadcast" not in dense._jdf.queryExecution().executedPlan().toString()


def test_similar_documents(spark):
    rng = random.Random(8)
    body = [f"w{rng.randint(0, 400)}" for _ in range(900)]
    rows = [(9, None, "en", "s"), (3, "", "en", "s"), (None, " ", "en", "s"), (12, "one", "en", "s"), (None, "two", "en", "s"), (12, "One", "fr", "s")]
    for i in range(20, 60):
        words = list(body)
        for _ in range(rng.randint(0, 12)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "s"))
    rows += rows[-3:]
    fps = [brute_fingerprint(r[1]) for r in rows]
    label = brute_components(fps)
    least = defaultdict(list)
    for r, k in zip(rows, label, strict=True):
        least[k] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], f"{fp:016x}", min(least[k], default=None)) for r, fp, k in zip(rows, fps, label, strict=True))
    for small in (1, 256):
        assert Counter(tuple(r) for r in simhash.similar_documents(spark, frame(spark, rows), small).collect()) == want
    assert len(set(label)) < len(set(fps))
    assert simhash.similar_documents(spark, frame(spark, []).limit(0)).count() == 0
