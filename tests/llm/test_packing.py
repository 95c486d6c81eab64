import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from palimpsest.llm import packing, textkernel
from palimpsest.llm.tokens import Units

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)


def test_units_give_the_ids_of_whole_texts():
    r = random.Random(5)
    parts = ["a", "B", "1", " ", " ", "\n", "\t", "\x0b", " ", " ", "é", "'s", "don't ", "...", "\x1c", "　", "日本", "<|endoftext|>", "\r\n", "x" * 20]
    texts = ["", " ", "  a", "a  b \n\n c", "<|endoftext|> a<|endoftext|>b  <|endoftext|>", *("".join(r.choice(parts) for _ in range(r.randrange(60))) for _ in range(3000))]
    expected = [e.ids for e in WHOLE.encode_batch(texts, add_special_tokens=False)]
    units, got = Units(open(PATH).read()), []
    for c in textkernel.chunks(pa.array(texts), 4096):
        ids, offs = units.encode(c)
        got += [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)]
    assert got == expected


def test_other_tokenizers_are_used_on_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["Hello World  again", "A\nb", "", "é <|endoftext|>"]
    units = Units(open(path).read())
    (c,) = textkernel.chunks(pa.array(texts))
    ids, offs = units.encode(c)
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def one_by_one(lengths, size):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, b in enumerate(bins) if b >= n]
        if fits:
            bins[min(fits, key=bins.__getitem__)] -= n
        else:
            bins.append(size - n)
    return len(bins)


def test_course_is_best_fit_decreasing():
    r = random.Random(2)
    for _ in range(200):
        size = r.choice([7, 16, 50, 64])
        lengths = [r.randint(1, size) for _ in range(r.randint(0, 120))]
        course, bins = packing.best_fit(collections.Counter(lengths), size)
        assert bins == one_by_one(lengths, size)
        used = collections.Counter()
        for length, first, at, each, offset in course.tolist():
            later = [x for x in course.tolist() if x[0] == length and x[1] > first]
            stop = min((x[1] for x in later), default=lengths.count(length))
            for rank in range(first, stop):
                used[at + (rank - first) // each, offset + (rank - first) % each * length] = length
        filled = collections.Counter()
        for (b, offset), length in sorted(used.items()):
            assert filled[b] == offset
            filled[b] += length
        assert sum(filled.values()) == sum(lengths) and max(filled.values(), default=0) <= size


def test_documents_round_trip(spark, odd_docs):
    pieces = packing.pack(odd_docs, PATH, keep=("doc_id", "size")).toPandas()
    for _, of_one in pieces.groupby("sequence_id"):
        at = 0
        for row in of_one.sort_values("offset").itertuples():
            assert row.offset == at and len(row.ids) == 4 * row.length and zlib.crc32(row.ids) == row.ids_crc32
            at += row.length
        assert at <= 1024
    expected = collections.Counter()
    for r in odd_docs.collect():
        ids = [*WHOLE.encode(r.text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[r.doc_id, i, a, np.array(ids[a:b], "<u4").tobytes()] += 1
    got = collections.Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, bytes(r.ids)) for r in pieces.itertuples())
    assert got == expected
    assert packing.pack(odd_docs.limit(0), PATH).count() == 0
