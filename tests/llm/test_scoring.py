import random
import re
import zlib

import numpy as np
import pytest

from tickloom.llm import langid, quality, toxicity
from tickloom.llm.common import WordHasher, chunks, joined

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, lang string, p double, letters boolean"


def is_held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "lang", "quality", "toxic").orderBy("doc_id").collect()
    return docs, labels, {r.doc_id: r for r in rows}


def odd(spark):
    long = "word " * 200_000
    rows = [(1, None, None, 0.5, True), (2, "", "en", 0.5, True), (None, "one text", None, None, None), (3, long, "fr", 0.1, False), (4, "same", "de", 0.1, False), (4, "same", "de", 0.1, False), (5, "1234 --", "de", 0.1, False)]
    return spark.createDataFrame(rows, DOCS)


def test_toxicity_held_out(labelled):
    docs, labels, rows = labelled
    found = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).collect()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    apart = [r for r in found if r.held_out]
    toxic = [r for r in apart if rows[r.doc_id].toxic == 1]
    clean = [r for r in apart if rows[r.doc_id].toxic == 0]
    assert np.mean([r.predicted for r in toxic]) > 0.7
    assert np.mean([r.predicted for r in clean]) < 0.06


def test_toxicity_shares_subwords():
    rows = [(f"you are such an idiot person number{i}".encode(), 1) for i in range(60)] + [(f"you are such a lovely person number{i}".encode(), 0) for i in range(60)]
    model = toxicity.train(rows)
    data, off = joined([b"such an idiooot", b"such a lovelyy"])
    misspelt, kind = model.scores(data, off)
    assert misspelt > 0.5 > kind


def test_toxicity_counts_match_between_training_and_scoring():
    data, off = joined([b"An idiot, a b", b"", b"caf\xc3\xa9 noir"])
    ids, ends = toxicity.ngrams(data, off)
    rng = np.random.default_rng(0)
    weight = rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32)
    model = toxicity.ToxicityModel(weight, 0.0)
    for i, score in enumerate(model.scores(data, off)):
        own = weight[ids[ends[i] : ends[i + 1]]]
        assert score == pytest.approx(1 / (1 + np.exp(-(own.mean() if len(own) else 0))), abs=1e-5)


def scored(model, *texts):
    data, off = joined(list(texts))
    return model.scores(data, off, *([WordHasher()] if isinstance(model, quality.QualityModel) else []))


def test_toxicity_matches_plain_loops():
    """Buckets, averages and the softmax by definition, text by text."""
    mask = (1 << 64) - 1

    def final(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    values = [final((b + 1) * 0x9E3779B97F4A7C15 & mask) for b in range(256)]

    def bucket(gram):
        h = len(gram)
        for b in gram:
            h = (h * 0x100000001B3 + values[b]) & mask
        return (h ^ h >> 32) % toxicity.BUCKETS

    rng = np.random.default_rng(1)
    model = toxicity.ToxicityModel(rng.normal(0, 1, toxicity.BUCKETS).astype(np.float32), 0.3)
    texts = [b"You IDIOT! an idiooot, really", b"", b"x", b"ab cd", "Ça va? Größe".encode(), b"a" * 3000]
    for text, score in zip(texts, scored(model, *texts), strict=True):
        grams = []
        for word in "".join(chr(c) if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else " " for c in text.lower()).encode("latin-1").split():
            word = b" " + word + b" "
            grams += [word[i : i + n] for n in (3, 4, 5, 6) for i in range(len(word) - n + 1)]
        z = (sum(float(model.weight[bucket(g)]) for g in grams) / len(grams) if grams else 0) + 0.3
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_quality_matches_plain_loops():
    rows = [(f"good text number {i} of words that go on".encode(), 1) for i in range(30)] + [(f"Bad ### {i} THE THE THE".encode(), 0) for i in range(30)]
    model = quality.train(rows)
    mean, spread, a, b, c, d = (np.asarray(x, np.float64) for x in model.layers)
    hasher = WordHasher()
    texts = [b"good Text 12, THE the the END", b"", b" \n", b"!!", "Größe und Maß".encode()]
    for text, score in zip(texts, scored(model, *texts), strict=True):
        words, last = [], None
        for w in re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x00-\x20\x7f]+", text):
            if w[:1].isdigit():
                ids = [quality.DIGIT]
            else:
                data, off = joined([w.lower()])
                ids = [int(hasher(data, off[:-1], off[1:])[0] % np.uint64(quality.BUCKETS - 4)) + 4]
                letters = w[:1].isalpha() or w[0] >= 128
                if letters and sum(65 <= x <= 90 for x in w) >= 2 and not any(97 <= x <= 122 for x in w):
                    ids.append(quality.UPPER)
                if letters and ids[0] == last:
                    ids.append(quality.REPEAT)
            last = ids[0]
            words += ids
        if not words:
            assert score == model.share == 0.5
            continue
        x = ((sum(model.vectors[i].astype(np.float64) for i in words) + quality.PRIOR * model.center) / (len(words) + quality.PRIOR) - mean) / spread
        z = (sum(np.tanh(sum(x[i] * a[i, j] for i in range(len(x))) + b[j]) * c[j] for j in range(len(c))) + d) / model.temperature
        assert score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_language_matches_plain_loops():
    model = langid.train([(b"the cat and the dog sat on the mat " * 4, "en"), ("der Hund und die Katze saßen auf der Matte ".encode() * 4, "de")])
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    H = langid.HIDDEN

    def states(layer, text):
        h, out = np.zeros(H), []
        for byte in text:
            x, u = layer.W[byte].astype(float), h @ layer.U.astype(float)
            z, s = sigmoid(x[:H] + u[:H]), sigmoid(x[H : 2 * H] + u[H : 2 * H])
            c = np.tanh(x[2 * H :] + s * (u[2 * H :] + layer.r))
            h = (1 - z) * c + z * h
            out.append(h)
        return out

    texts = ["The Hund saß ".encode() * 12, b"", b"x"]
    data, off = joined(texts)
    for text, found in zip(texts, model.pooled(data, off), strict=True):
        total = np.zeros(2)
        low = text.lower()
        for lo in range(0, len(low), langid.SPAN):
            w = langid.WARM
            part = (b" " * w + low + b" " * (langid.SPAN + w))[lo : lo + langid.SPAN + 2 * w]
            ahead, back = states(model.ahead, part)[w:], states(model.back, part[::-1])[::-1][w:]
            for k in range(min(langid.SPAN, len(low) - lo)):
                z = ahead[k] @ model.V[:H] + back[k] @ model.V[H:] + model.b
                total += np.exp(z) / np.exp(z).sum()
        assert found == pytest.approx(total / max(1, len(low)), abs=1e-4)


def test_a_rare_language_is_learned(spark):
    rng = random.Random(4)
    vocabulary = {"en": "the of and to in is was for on that with as it at by from".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem".split(), "xx": "kzq wvx qqk zzv xkw vvq kkx qzw".split()}
    rows = [(i, " ".join(rng.choice(vocabulary[k]) for _ in range(40)), k) for i, k in enumerate(["en"] * 4000 + ["de"] * 4000 + ["xx"] * 12)]
    found = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("doc_id >= 8000").collect()
    assert [r.lang_pred for r in found] == ["xx"] * 12


def test_ties_go_to_the_first_language(spark):
    same = [(b"abc " * 30, "aa"), (b"abc " * 30, "bb")]
    model = langid.train(same)
    model.V[:], model.b[:] = 0, 0
    docs = spark.createDataFrame([(1, "abc"), (2, "abc")], "doc_id long, text string")
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, model).collect()] == [("aa", 0.5)] * 2


def test_short_texts_are_kept_and_junk_is_not(labelled):
    """Held-out rows, whole and their first words."""
    docs, labels, rows = labelled
    model = quality.fit(docs, labels)
    apart = [r for i, r in rows.items() if is_held_out(i) and r.text]
    for n, clean, junk in ((10**6, 0.99, 0.05), (30, 0.99, 0.12), (10, 0.95, 0.35)):
        kept = scored(model, *(" ".join(r.text.split()[:n]).encode() for r in apart)) >= 0.3
        good = np.array([r.quality == 1 for r in apart])
        assert kept[good].mean() >= clean and kept[~good].mean() <= junk
    short = [r for r in apart if r.quality == 1 and len(r.text.split()) <= 12]
    assert len(short) > 10 and (scored(model, *(r.text.encode() for r in short)) >= 0.3).all()


def test_quality_held_out(labelled):
    docs, labels, rows = labelled
    found = quality.quality(docs.join(labels.select("doc_id"), "doc_id"), labels).collect()
    apart = [r for r in found if r.held_out]
    assert all(r.predicted == int(r.score >= 0.3) for r in found)
    assert np.mean([r.predicted == rows[r.doc_id].quality for r in apart]) > 0.98


def test_quality_words_and_marks():
    data, off = joined([b"As As THIS 12 !!", b"", b"As"])
    ids, ends = quality.words(data, off, WordHasher())
    assert ends.tolist() == [0, 7, 7, 8]
    assert ids[2] == quality.REPEAT and ids[4] == quality.UPPER and ids[5] == quality.DIGIT
    assert ids[0] == ids[1] == ids[7]


def test_language_held_out(labelled):
    docs, _, rows = labelled
    some = docs.where("doc_id % 4 = 0")
    truth = {r.doc_id: r.lang for r in some.select("doc_id", "lang").collect()}
    found = [r for r in langid.language_id(some).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in found]) > 0.98


def test_backpropagation_through_time():
    rng = np.random.default_rng(3)
    layer = langid.Direction(rng)
    text = rng.integers(97, 101, (2, 5)).astype(np.uint8)
    for back in (False, True):
        goal = rng.normal(0, 1, (5, 2, langid.HIDDEN)).astype(np.float32)
        grads = layer.learn(text, layer.read(text, back), goal, back)
        for p, g in zip(layer.parameters, grads, strict=True):
            flat, at = p.reshape(-1), int(np.abs(g).argmax())
            kept, step = flat[at], 1e-2
            flat[at] = kept + step
            up = (layer.read(text, back) * goal).sum()
            flat[at] = kept - step
            down = (layer.read(text, back) * goal).sum()
            flat[at] = kept
            assert (up - down) / (2 * step) == pytest.approx(g.reshape(-1)[at], rel=0.05)


def test_every_byte_is_read():
    data, off = joined([b"a" * 130, b"", b"xyz"])
    text, length, doc = langid.stretches(data, off)
    assert length.tolist() == [64, 64, 2, 3] and doc.tolist() == [0, 0, 0, 2]
    w = langid.WARM
    assert text.shape == (4, 64 + 2 * w) and text[0].tobytes() == b" " * w + b"a" * (64 + w)
    assert text[2].tobytes() == b"a" * (w + 2) + b" " * (62 + w) and text[3].tobytes().strip() == b"xyz"


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, empty):
    docs = odd(spark)
    labels = spark.createDataFrame([(2, 0, 1), (3, 1, 0), (3, 1, 0), (4, 1, 1), (None, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    if empty:
        docs, labels = docs.limit(0), labels.limit(0)
    for found in (toxicity.toxicity(docs, labels), quality.quality(docs, labels)):
        rows = found.collect()
        assert len(rows) == (0 if empty else 7)
        assert all(0 <= r.score <= 1 for r in rows)
    rows = langid.language_id(docs).collect()
    assert len(rows) == (0 if empty else 7)
    for r in rows:
        if r.doc_id in (1, 2, 5):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_without_labels(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score < 1e-6 for r in toxicity.toxicity(docs, labels).collect())
    assert all(r.score < 1e-6 for r in quality.quality(docs, labels).collect())
    assert all(r.lang_pred == "und" for r in langid.language_id(docs.withColumn("lang", docs.lang.substr(0, 0))).where("doc_id < 3").collect())


def test_chunks_cover_rows():
    data, off = joined([b"x" * 10, b"", b"y" * 30, b"z"])
    parts = [(lo, hi, d.tobytes()) for lo, hi, d, _ in chunks(data, off, 12)]
    assert [p[:2] for p in parts] == [(0, 2), (2, 3), (3, 4)]
    assert b"".join(p[2] for p in parts) == data.tobytes()
