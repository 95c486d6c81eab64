"""The pipeline against its stages one by one, on the smallest tables."""

import collections

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import pii
from tests.llm import test_minhash, test_quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "minhash near-dedup", "pii", "mixing", "packing"]
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in rows.items() if test_quality.keeps(t)}
    out = stages["quality rules"](spark, docs, DATA)
    assert out.columns == names and {r.doc_id for r in out.collect()} == set(kept)
    unique = {i for i, (_, c) in test_minhash.plain(list(kept.items()), 5, 80).items() if c == i}
    out = stages["minhash near-dedup"](spark, out, DATA)
    assert out.columns == names and sorted(r.doc_id for r in out.collect()) == sorted(unique)
    out = stages["pii"](spark, out, DATA)
    clean = {i: pii.redact_text(rows[i], pii.find_spans(rows[i])) for i in unique}
    assert out.columns == names and {r.doc_id: r.text for r in out.collect()} == clean
    mixed = stages["mixing"](spark, out, DATA)
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == names and set(copies) <= unique and max(copies.values()) <= 3
    packed = corpus_pipeline.run(spark, DATA).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    ids = {i: len(encode(clean[i], add_special_tokens=False).ids) + 1 for i in copies}
    assert sum(r.length for r in packed) == sum(ids[i] * n for i, n in copies.items())
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_odd_tables(spark, odd_docs, tmp_path):
    """Null, empty, very long and repeated texts, rows without id or source, extra columns with clashing names, and no rows."""
    import random

    r = random.Random(5)
    words = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    long, copied = words(30000), words(60)
    more = [(100, long), (101, copied), (102, copied), (103, words(40) + " +49 30 1234567 x@y.zz"), (104, None), (105, ""), (None, words(50)), (106, "a b " * 4000)]
    rows = [(i, t, "s1" if i else None, "en", 0, "x", "y", True, 1) for i, t in more]
    docs = odd_docs.unionByName(spark.createDataFrame(rows, odd_docs.schema))
    docs.write.parquet(f"{tmp_path}/odd/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/odd/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, read, "")
    assert sorted(x.doc_id or -1 for x in kept.collect()) == [-1, 6, 7, 100, 101, 102, 103]
    unique = stages["minhash near-dedup"](spark, kept, "")
    assert sorted(x.doc_id or -1 for x in unique.collect()) == [-1, 6, 100, 101, 103] and unique.columns == docs.columns
    clean = {x.doc_id: x.text for x in stages["pii"](spark, unique, "").collect()}
    assert clean[103].endswith("<PHONE> <EMAIL>") and clean[100] == long
    packed = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {x.doc_id for x in packed} <= {None, 6, 100, 101, 103} and all(0 < x.length <= 1024 for x in packed)
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
