"""Quality rules: base line and word counts, and repetition measured on a suffix array of words.

Every document gets its own word-level suffix array.  Those of all documents of a chunk are built
together by prefix doubling (the first key of a suffix holds its document, so suffixes of different
documents never compare equal); only suffixes that still share their rank are sorted again.  The
longest common prefix of neighbours comes from the ranks kept of each doubling.  The longest repeat
that starts at a position is the larger of its two neighbouring prefixes, and the union of the spans
of all maximal repeated substrings of at least ``min_repeat`` words is the union of these runs.

The verdict limits the covered fraction of the words and the longest repeat.  The base rule looks at
repeats of eight words and more; the covered fraction counts repeats from five words on, so texts that go
round in short phrases fail too, and the longest repeat has a limit that a text can break with little
of it covered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import map_arrow
from palimpsest.llm.textkernel import Chunk, Words, chunks, code_points, span_hashes, words_of

#: A repeat is counted from this many words on.
MIN_REPEAT = 8
#: A document with a larger share of its words inside repeats of at least ``MIN_COVERED`` words is rejected.
MIN_COVERED, MAX_COVERED = 5, 0.30
#: A document of which one repeat is longer, in words, is rejected if it also fills MAX_LONGEST_SHARE of it.
#: Two copies cover twice that share, so it has to stay well under half of MAX_COVERED to reject anything more.
MAX_LONGEST = 200
MAX_LONGEST_SHARE = 0.05
#: Documents with fewer words are rejected.
MIN_WORDS = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered_words long, longest_repeat long, repeat_spans array<struct<start:long,length:long>>"


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 1, in ascending order of the keys."""
    order = np.argsort(keys)
    ordered = keys[order]
    fresh = np.empty(len(keys), bool)
    fresh[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def longest_repeats(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest word sequence from there that its document has twice.

    ``bounds`` has the first word of each document and the number of words.  Ties between equal
    suffixes do not arise: suffixes of one document differ in length.
    """
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    left = bounds[1:][doc] - np.arange(n)
    dense = _ranks(hashes ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    # A suffix's rank is one more than the number of suffixes before its group of equal ones.
    counts = np.bincount(dense)
    rank = (np.cumsum(counts) - counts)[dense] + 1
    levels = [rank]
    h = 1
    todo = np.flatnonzero(counts[dense] > 1)
    while len(todo):
        then = np.where(left[todo] > h, rank[np.minimum(todo + h, n - 1)], 0)
        key = rank[todo] * (n + 1) + then
        order = np.argsort(key)
        key, at = key[order], todo[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        # within one old rank the new groups follow each other in order
        old = rank[at]
        old_first = np.ones(len(old), bool)
        old_first[1:] = old[1:] != old[:-1]
        base = np.maximum.accumulate(np.where(old_first, np.arange(len(old)), 0))
        rank = rank.copy()
        rank[at] = old + heads[group] - base
        levels.append(rank)
        h *= 2
        size = np.diff(np.append(heads, len(key)))
        todo = at[size[group] > 1]
    suffix = np.empty(n, np.int64)
    suffix[rank - 1] = np.arange(n)
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    same = doc[a] == doc[b]
    a0 = a.copy()
    for level in range(len(levels) - 1, -1, -1):
        step, r = 1 << level, levels[level]
        ai, bi = np.minimum(a, n - 1), np.minimum(b, n - 1)
        hit = same & (a < n) & (b < n) & (doc[ai] == doc[a0]) & (doc[bi] == doc[a0]) & (r[ai] == r[bi])
        hit &= (left[ai] >= step) & (left[bi] >= step)
        a, b = a + step * hit, b + step * hit
    lcp = a - a0
    out = np.empty(n, np.int64)
    out[suffix] = np.maximum(np.append(lcp, 0), np.append(0, lcp))
    return out


def _covered(run: np.ndarray, least: int, n: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` words."""
    long = np.flatnonzero(run >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, long, 1)
    np.subtract.at(edge, long + run[long], 1)
    return np.cumsum(edge[:-1]) > 0


def _per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def _dup_lines(c: Chunk, w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same document."""
    breaks = np.append(np.flatnonzero(c.buf == 10), len(c.buf))
    begin = np.unique(np.concatenate([breaks[:-1] + 1, c.offs[:-1]]))
    begin = begin[begin < len(c.buf)]
    doc = np.searchsorted(c.offs, begin, "right") - 1
    stop = np.minimum(breaks[np.searchsorted(breaks, begin)], c.offs[doc + 1])
    keep = np.searchsorted(w.starts, begin) < np.searchsorted(w.starts, stop)
    begin, stop, doc = begin[keep], stop[keep], doc[keep]
    key = span_hashes(c.buf, begin, stop) ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    total = np.bincount(doc, minlength=c.n)
    _, at = np.unique(key, return_index=True)
    return total - np.bincount(doc[at], minlength=c.n)


def _spans(covered: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets per document, starts and lengths of the runs of covered words."""
    if not len(covered):
        return np.zeros(len(bounds), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.zeros(len(covered) + 1, bool)
    cut[bounds] = True
    start, end = covered.copy(), covered.copy()
    start[1:] &= ~covered[:-1] | cut[1:-1]
    end[:-1] &= ~covered[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    return np.searchsorted(starts, bounds), starts - bounds[doc], ends - starts


def measure_batches(batches: Iterator[pa.RecordBatch], column: str, min_repeat: int = MIN_REPEAT, min_covered: int = MIN_COVERED) -> Iterator[pa.RecordBatch]:
    """The input's columns with the measures of the text column appended."""
    for batch in batches:
        for c in chunks(batch.column(column)):
            w = words_of(c)
            n_words = np.diff(w.bounds)
            points = code_points(c.buf)
            chars = np.zeros(len(w.starts) + 1, np.int64)
            np.cumsum(points[w.ends] - points[w.starts], out=chars[1:])
            run = longest_repeats(w.hashes, w.bounds)
            covered = _covered(run, min_repeat, len(run))
            longest = np.zeros(c.n, np.int64)
            full = np.flatnonzero(n_words)
            if len(full):
                longest[full] = np.maximum.reduceat(run, w.bounds[full])
            longest[longest < min_repeat] = 0
            symbols = np.zeros(len(c.buf) + 1, np.int64)
            np.cumsum(_SYMBOL[c.buf], out=symbols[1:])
            offs, starts, lens = _spans(covered, w.bounds)
            spans = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.StructArray.from_arrays([pa.array(starts), pa.array(lens)], ["start", "length"]))
            part = batch.slice(c.first, c.n)
            columns = [
                n_words, chars[w.bounds[1:]] - chars[w.bounds[:-1]], symbols[c.offs[1:]] - symbols[c.offs[:-1]],
                _dup_lines(c, w), _per_document(covered, w.bounds), _per_document(_covered(run, min_covered, len(run)), w.bounds), longest,
            ]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, *(pa.array(x, pa.int64()) for x in columns), spans],
                [*part.schema.names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat", "repeat_spans"],
            )


def _drop_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.drop_columns(["__text"])


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_repeat: int = MIN_REPEAT, min_covered: int = MIN_COVERED) -> DataFrame:
    """Measures of each document beside the columns named in ``keep``.

    n_repeat_words, longest_repeat and repeat_spans count repeats of at least ``min_repeat`` words,
    n_covered_words the words inside repeats of at least ``min_covered``.

    One row per input row, repeated rows included.  A null or empty text has no words and measures
    of zero; an empty table gives an empty result; columns not named in ``keep`` do not take part,
    so they may have any name.
    """
    source = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1])
    return map_arrow(source, lambda it: _drop_text(measure_batches(it, "__text", min_repeat, min_covered)), f"{fields}, {MEASURES}")


def verdict(
    measured: DataFrame,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
    max_longest_share: float = MAX_LONGEST_SHARE,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """Adds base_failed (too few words, or too many inside 8-word repeats) and kept.

    kept is false where base_failed, or where repeats of the shorter kind cover more than
    ``max_covered`` of the words, or where the longest repeat has over ``max_longest`` words and over ``max_longest_share``
    of the document.
    """
    words = F.col("n_words")
    failed = (words < min_words) | (100 * F.col("n_repeat_words") > 30 * words)
    covered = F.col("n_covered_words") > F.lit(max_covered) * words
    longest = (F.col("longest_repeat") > max_longest) & (F.col("longest_repeat") > F.lit(max_longest_share) * words)
    return measured.withColumns({"base_failed": failed, "kept": ~(failed | covered | longest)})


def filter_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass, with the columns they came with."""
    names = docs.columns
    marked = docs.select(*(F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(names)))
    at = f"__c{names.index(text)}"
    kept = verdict(measure(marked, at, tuple(marked.columns))).filter("kept")
    return kept.select(*(F.col(f"__c{i}").alias(n) for i, n in enumerate(names)))


def sql() -> str:
    """The measures and the verdict over documents, for DuckDB: repeated windows instead of suffix arrays."""
    inside = lambda k: f"""
  SELECT r, count(DISTINCT place) AS n FROM (
    SELECT r, unnest(range(i, i + {k})) AS place FROM (
      SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(list_slice(ws, i, i + {k} - 1), ' ')) AS times FROM (SELECT r, ws, unnest(range(1, n_words - {k} + 2)) AS i FROM w)
    ) WHERE times > 1
  ) GROUP BY r"""  # noqa: E731
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT *, len(ws)::BIGINT AS n_words FROM d
), l AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), a AS ({inside(MIN_REPEAT)}
), b AS ({inside(MIN_COVERED)}
), m AS (
  SELECT w.r, ws, n_words, greatest({MAX_LONGEST} + 1, floor({MAX_LONGEST_SHARE}::DOUBLE * n_words)::BIGINT + 1) AS k FROM w JOIN a ON a.r = w.r AND a.n > {MAX_LONGEST}
), g AS (
  SELECT r, bool_or(times > 1) AS long FROM (
    SELECT r, count(*) OVER (PARTITION BY r, hash(list_slice(ws, i, i + k - 1))) AS times FROM (SELECT r, ws, k, unnest(range(1, n_words - k + 2)) AS i FROM m)
  ) GROUP BY r
), x AS (
  SELECT doc_id, n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(a.n, 0)::BIGINT AS n_repeat_words, coalesce(b.n, 0)::BIGINT AS n_covered_words, coalesce(g.long, false) AS long
  FROM w LEFT JOIN l USING (r) LEFT JOIN a USING (r) LEFT JOIN b USING (r) LEFT JOIN g USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words OR n_covered_words > {MAX_COVERED}::DOUBLE * n_words OR long) AS kept, n_covered_words
FROM x
"""
