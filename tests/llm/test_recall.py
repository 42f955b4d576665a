"""Near-duplicate links against an exact join, on a larger input: only if TICKLOOM_RECALL names a folder of tables, or is 1."""

import os
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import setsketch
from tickloom.llm.common import WordHasher, byte_view, chunks

SF = os.environ.get("TICKLOOM_RECALL", "")
SF = "/root/testdata/check_h" if SF == "1" else SF


def classes(docs, size):
    """doc_ids of each distinct set."""
    out, hasher = defaultdict(list), WordHasher()
    for lo in range(0, len(docs), 2000):
        part = docs[lo : lo + 2000]
        data, off = byte_view(pa.array([t for _, t in part], pa.string()))
        for a, _, d, o in chunks(data, off):
            for k, s in enumerate(setsketch.shingle_sets(d, o, size, hasher)):
                if len(s):
                    out[s.tobytes()].append(part[a + k][0])
    return list(out.values()), [np.frombuffer(k, np.uint64) for k in out]


def exact_links(sets, percent):
    """All pairs by their rarest elements, one of which two alike sets share, verified on full sets."""
    values, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(values))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(r) for r in np.split(rank[place], ends[:-1])]
    index, pairs, scratch = defaultdict(list), [], np.zeros(len(values), bool)
    size = np.array([len(s) for s in sets])
    for i in np.argsort(size, kind="stable").tolist():
        own = size[i]
        met = set()
        for e in ranked[i][: own - (-(-percent * own // 100)) + 1].tolist():
            met.update(index[e])
            index[e].append(i)
        other = np.array([j for j in met if 100 * size[j] >= percent * own], np.int64)
        if len(other):
            scratch[ranked[i]] = True
            both = np.array([scratch[ranked[j]].sum() for j in other])
            scratch[ranked[i]] = False
            pairs += [(i, j) for j in other[100 * both >= percent * (own + size[other] - both)].tolist()]
    return pairs


@pytest.mark.skipif(not SF, reason="takes minutes; set TICKLOOM_RECALL")
@pytest.mark.parametrize("size", [4, 5])
def test_links_are_those_of_an_exact_join(spark, size):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    ids, sets = classes(rows, size)
    label = list(range(len(sets)))

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    links = exact_links(sets, 80)
    for a, b in links:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    smallest = defaultdict(lambda: 1 << 62)
    for k, own in enumerate(ids):
        smallest[root(k)] = min(smallest[root(k)], *own)
    expected = {i: i for i, _ in rows} | {i: smallest[root(k)] for k, own in enumerate(ids) for i in own}
    found = {r.doc_id: r.component_id for r in setsketch.near_duplicates(spark, table, size, 80).select("doc_id", "component_id").collect()}
    wrong = sum(found[i] != c for i, c in expected.items())
    print(f"{len(rows)} documents, {len(sets)} sets, {len(links)} links, {wrong} documents in another component")
    assert wrong <= 0.0005 * len(rows)
