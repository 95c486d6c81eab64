import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import minhash
from palimpsest.llm.components import connected_components


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else {tuple(words)} if words else set()


def plain(docs, k, percent):
    """doc_id to (set size, component) by comparing all pairs."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("seed", [1])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, seed):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    r = random.Random(seed)
    vocabulary, docs = [f"w{i}" for i in range(4000)], []
    for size in (3, 25, 90):
        base = [r.choice(vocabulary) for _ in range(100)]
        for _ in range(size):
            words = list(base)
            for _ in range(r.choice([0, 1, 3, 5, 6, 7, 8])):
                words[r.randrange(100)] = r.choice(vocabulary)
            docs.append(" ".join(words))
    r.shuffle(docs)
    rows = list(enumerate(docs))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == plain(rows, 2, 80)


def test_odd_rows(spark, odd_docs):
    got = minhash.near_duplicates(odd_docs, k=2)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    expected = plain([(r.doc_id, r.text) for r in odd_docs.filter("doc_id is not null").collect()], 2, 80)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.component_id == r.doc_id)
    assert minhash.near_duplicates(odd_docs.limit(0)).count() == 0
    kept = minhash.deduplicate(odd_docs, k=2)
    assert kept.columns == odd_docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(i for i, (_, c) in expected.items() if c == i)
    assert kept.filter("doc_id is null").count() == 2


def test_fixture_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = plain([(r.doc_id, r.text) for r in docs.collect()], 2, 80)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs, k=2).collect()} == expected


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)] + [(7, 7), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u is not None and u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {x.node: x.component for x in got.collect()} == {n: find(n) for n in root} and got.groupBy("node").count().filter(F.col("count") > 1).isEmpty()
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
