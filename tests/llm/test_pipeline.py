import subprocess
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import quality
from tickloom.llm.common import WordHasher, joined

from .test_corpus import brute_hits
from .test_dedup import brute_components

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i} of" for i in range(60_000))
GOOD = "The to thednd of, it thinrent thtionnd stsh erblean ansh. Ened handea this thinen tionti, for hawh, heed the ernd."


def folder(spark, path, odd, docs=True):
    """sf0.001's documents with odd rows and columns that clash with the operators' own."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in odd], given.schema)
    every = (given if docs else given.limit(0)).unionByName(more)
    every.withColumns({"rest": F.lit("r"), "_id": F.col("doc_id") + 1, "key": F.lit(1), "score": F.lit(0.0), "_hits": F.lit(7)}).write.parquet(f"{path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{path}/{t}.parquet")
    return path


ODD = [(None, None), (None, None), (90001, None), (90002, ""), (90003, ""), (90004, LONG), (90004, LONG), (90005, LONG + " end"), (90006, GOOD), (90006, f"Another text, of the same id. {GOOD} And its own end, that is not so short."), (None, "null id of the text"), (90007, "null id of the text"), (90008, "x" * 1_000_000)]


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_stages_match_brute_force(spark, tmp_path):
    sf = folder(spark, f"file://{tmp_path}/sf", ODD)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, sf).write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
        after = Counter(rows_of(docs.withColumn("text", F.col("decoded")) if k == 4 else docs))
        if k == 0:
            data, off = joined([(t or "").encode() for _, t in before])
            scores = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels).scores(data, off, WordHasher())
            assert after == Counter(r for r, s in zip(before, scores.tolist(), strict=True) if s >= 0.3)
            assert np.sum(scores < 0.3) > 0
        if k == 1:
            groups = defaultdict(list)
            for i, t in before:
                groups[t or ""].append(i)
            assert Counter(t or "" for _, t in after.elements()) == Counter(set(groups))
            assert all(i == max((x for x in groups[t or ""] if x is not None), default=None) for i, t in after)
        if k == 2:
            named = [(i, t) for i, t in before if i is not None]
            # texts that repeat an id are told apart by a second number
            seen = Counter()
            place = {}
            for i, t in sorted(named, key=str):
                place[i + 10**6 * seen[i]] = (i, t)
                seen[i] += 1
            sets, label = brute_components([(p, t) for p, (_, t) in place.items()], 5)
            groups = defaultdict(list)
            for p in place:
                groups[label[p]].append(place[p])
            kept = defaultdict(list)
            for i, t in after:
                if i is not None:
                    kept[label[next(p for p, x in place.items() if x == (i, t))]].append((i, t))
            assert {g: len(x) for g, x in kept.items()} == dict.fromkeys(groups, 1)
            assert all(x[0][0] == min(i for i, _ in groups[g]) for g, x in kept.items())
            assert Counter(r for r in after.elements() if r[0] is None) == Counter(r for r in before if r[0] is None)
        if k == 3:
            dirty = {(d, n) for (d, n, _, _, _, bad) in brute_hits(before, bench, 10) if bad}
            assert len(after) == len(before) - sum(1 for d, t in before if (d, len(_words(t))) in dirty)
        if k == 4:
            assert after == Counter((i, " ".join([t or ""])) for i, t in before)


def _words(text):
    from .test_corpus import words

    return words(text)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(2, GOOD), (2, GOOD)]])
def test_run_on_few_rows(spark, tmp_path, rows):
    sf = folder(spark, f"file://{tmp_path}/sf", rows, docs=False)
    found = corpus_pipeline.run(spark, sf)
    assert found.count() <= len(rows) and set(found.columns) >= {"doc_id", "ids", "decoded", "rest", "_hits"}


def test_the_file_alone_can_be_imported():
    code = "import sys; sys.modules['tickloom.llm'] = None; import corpus_pipeline; print(len(corpus_pipeline.STAGES))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0], timeout=60).stdout == "5\n"
