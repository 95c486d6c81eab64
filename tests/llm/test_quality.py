import collections
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from palimpsest.llm import quality


def plain(text, at_least=8):
    """The measures; the longest repeat counts from so many words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    inside = {8: set(), 5: set()}
    for k, found in inside.items():
        runs = collections.Counter(tuple(words[i : i + k]) for i in range(n - k + 1))
        for i in range(n - k + 1):
            if runs[tuple(words[i : i + k])] > 1:
                found |= set(range(i, i + k))
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    twice = lambda k: len({tuple(words[i : i + k]) for i in range(n - k + 1)}) < n - k + 1
    longest = next((k for k in range(n, at_least - 1, -1) if twice(k)), 0) if n >= at_least and twice(at_least) else 0
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(inside[8]), len(inside[5]), longest


def keeps(text):
    """The verdict at the defaults."""
    n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    _, _, _, _, repeated, covered, longest = plain(text, max(200, int(0.05 * n)) + 1)
    return n >= 20 and 100 * repeated <= 30 * n and covered <= 0.3 * n and not (longest > 200 and longest > 0.05 * n)


NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def test_measures_against_plain_counting():
    r = random.Random(1)
    texts = [None, "", " ", "a", "a " * 100, "\n\n a\na\n a\n", "é ü é ü " * 9, *("".join(r.choice(["a", "b", " ", "\n", "é", "#", " a b c d e f g h"]) for _ in range(r.randrange(150))) for _ in range(200))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    for text, row in zip(texts, pa.Table.from_batches(list(quality.measure_batches(iter([batch]), "t", 8))).to_pylist(), strict=True):
        assert tuple(row[n] for n in NAMES) == plain(text)
        assert sum(s["length"] for s in row["repeat_spans"]) == row["n_repeat_words"]


def test_verdict_and_filter(spark, odd_docs):
    rows = quality.verdict(quality.measure(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    for row in rows:
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert row.base_failed is failed and row.kept is (not failed)
    kept = quality.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r.doc_id for r in kept.collect()) == [6, 7]
    assert quality.measure(odd_docs.limit(0)).count() == 0


def test_long_repeat_is_rejected(spark):
    words = [f"w{i}" for i in range(2000)]
    passage = [f"p{i}" for i in range(400)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:900] + passage + words[900:] + passage[:220] + passage[:200])), (3, " ".join(words + words[:100]))], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.verdict(quality.measure(docs), max_longest_share=0.05).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, True)}


def test_long_repeat_is_rejected_by_the_limits_of_the_query(spark):
    words = [f"w{i}" for i in range(12000)]
    texts = {1: words + words[:2000], 2: words + words[:300], 3: words[:1000] + words[:120], 4: words[:4000] + words[:250]}
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.verdict(quality.measure(docs)).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (False, True), 4: (False, False)}
    assert sorted(r.doc_id for r in quality.filter_documents(docs).collect()) == [2, 3]


def test_short_phrases_are_rejected_by_the_covered_fraction(spark):
    """Five- to seven-word phrases again and again, never eight words alike: the base rule keeps them, the method does not."""
    r = random.Random(3)
    phrases = [[f"p{i}{j}" for j in range(6)] for i in range(8)]
    looping = [w for i in range(120) for w in [*phrases[r.randrange(8)], f"u{i}", f"v{i}"]]
    some = [w for i in range(120) for w in [*(phrases[r.randrange(8)] if i % 4 == 0 else [f"a{i}{j}" for j in range(6)]), f"u{i}", f"v{i}"]]
    docs = spark.createDataFrame([(1, " ".join(looping)), (2, " ".join(some)), (3, " ".join(looping[:8] * 40))], "doc_id long, text string")
    got = {x.doc_id: (x.base_failed, x.kept) for x in quality.verdict(quality.measure(docs)).collect()}
    assert got == {1: (False, False), 2: (False, True), 3: (True, False)}


def test_the_method_decides_on_documents_of_the_fixture():
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    rows = pa.Table.from_batches(list(quality.measure_batches(iter(docs.combine_chunks().to_batches()), "text"))).select(["doc_id", "text", "n_words", "n_repeat_words", "n_covered_words", "longest_repeat"]).to_pylist()
    base = [x for x in rows if x["n_words"] >= 20 and 100 * x["n_repeat_words"] <= 30 * x["n_words"]]
    rejected = [x for x in base if x["n_covered_words"] > 0.3 * x["n_words"] or x["longest_repeat"] > max(200, 0.05 * x["n_words"])]
    assert 0 < len(rejected) < 0.01 * len(rows)
    assert not any(keeps(x["text"]) for x in rejected[:5])
    labels = pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pydict()
    good = {d for d, q in zip(labels["doc_id"], labels["quality"], strict=True) if q == 1}
    assert not good & {x["doc_id"] for x in rejected}
