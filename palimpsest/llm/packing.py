"""Best-fit decreasing packing of tokenised documents into sequences.

Best-fit decreasing treats pieces of equal length alike, so its whole course follows from the number
of pieces of each length: at most as many numbers as a sequence has tokens, whatever the corpus.
The driver packs these counts: open bins of equal remaining capacity are kept as ranges of bin
numbers, and a segment tree over the capacities finds the tightest that still holds a length in
logarithmic time.  The course it returns says, for each length, which ranks go to which bins; the
pieces get their rank within their length by counts of (length, hash bucket) summed up in order, so
no length is ever sorted in one task.  The bins are exactly those of a run over all pieces at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scratch import cut, map_arrow
from palimpsest.llm.textkernel import chunks
from palimpsest.llm.tokens import shared_units

SEQUENCE = 1024
#: Id after each document.
END = 2
BUCKETS = 1024

PIECES = "piece int, start long, length long, ids_crc32 long"


class CapacityTree:
    """Segment tree over capacities 0..most that tells which of them have open bins."""

    def __init__(self, most: int):
        self._leaves = 1 << most.bit_length()
        self._any = bytearray(2 * self._leaves)

    def set(self, capacity: int, present: bool) -> None:
        i = self._leaves + capacity
        self._any[i] = present
        while i := i >> 1:
            self._any[i] = self._any[2 * i] | self._any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity with an open bin that is at least ``least``."""
        i = self._leaves + least
        while not self._any[i]:
            while i & 1:
                i >>= 1
            if i == 0:
                return None
            i += 1
        while i < self._leaves:
            i = 2 * i + (not self._any[2 * i])
        return i - self._leaves


def best_fit(counts: Mapping[int, int], size: int = SEQUENCE) -> tuple[np.ndarray, int]:
    """The course of best-fit decreasing over pieces of the given lengths, and the number of bins.

    Rows (length, first rank, bin, pieces a bin, offset): from that rank on, pieces of that length fill
    bins from that one on, so many each, the first of them at that offset.
    """
    tree = CapacityTree(size)
    open_: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
    course: list[tuple[int, int, int, int, int]] = []
    bins = 0

    def put(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            open_[capacity].append((first, number))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = size, bins
                number = -(-left // (size // length))
                bins += number
            else:
                first, number = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(number, left // each)
            if full:
                course.append((length, rank, first, each, size - capacity))
                put(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            rest = number - full
            if rest and left:
                course.append((length, rank, first + full, left, size - capacity))
                put(capacity - left * length, first + full, 1)
                full, rest, left = full + 1, rest - 1, 0
            put(capacity, first + full, rest)
    return np.array(course, np.int64).reshape(-1, 5), bins


def piece_batches(batches: Iterator[pa.RecordBatch], column: str, content: str, size: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """The input's columns without the text, once for each piece, and the piece's place and digest."""
    units = shared_units(content)
    for batch in batches:
        at_text = batch.schema.get_field_index(column)
        for c in chunks(batch.column(column)):
            ids, offs = units.encode(c)
            n = np.diff(offs) + 1
            stream = np.empty(len(ids) + c.n, np.uint32)
            stops = np.cumsum(n)
            stream[stops - 1] = end
            inner = np.ones(len(stream), bool)
            inner[stops - 1] = False
            stream[inner] = ids
            pieces = -(-n // size)
            rows = np.repeat(np.arange(c.n), pieces)
            piece = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            head = n - (pieces - 1) * size
            start = np.where(piece > 0, head[rows] + (piece - 1) * size, 0)
            length = np.where(piece > 0, size, head[rows])
            begin = (stops - n)[rows] + start
            raw = stream.astype("<u4", copy=False).view(np.uint8).data
            spans = list(zip((4 * begin).tolist(), (4 * (begin + length)).tolist(), strict=True))
            digest = np.fromiter((zlib.crc32(raw[a:b]) for a, b in spans), np.int64, len(spans))
            part = batch.slice(c.first, c.n).take(pa.array(rows))
            kept = [(name, part.column(i)) for i, name in enumerate(part.schema.names) if i != at_text]
            columns = [*(x for _, x in kept), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(digest)]
            names = [*(x for x, _ in kept), "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)


def _placed(batches: Iterator[pa.RecordBatch], course: np.ndarray, span: int) -> Iterator[pa.RecordBatch]:
    """Adds sequence_id and offset to pieces with length and __rank."""
    key = course[:, 0] * span + course[:, 1]
    order = np.argsort(key)
    course, key = course[order], key[order]
    for batch in batches:
        length, rank = (batch.column(x).to_numpy() for x in ("length", "__rank"))
        row = course[np.searchsorted(key, length * span + rank, "right") - 1]
        place = rank - row[:, 1]
        each = row[:, 3]
        kept = [x for x in batch.schema.names if x != "__rank"]
        columns = [*(batch.column(x) for x in kept), pa.array(row[:, 2] + place // each), pa.array(row[:, 4] + place % each * length)]
        yield pa.RecordBatch.from_arrays(columns, [*kept, "sequence_id", "offset"])


def pack(
    docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = SEQUENCE, end: int = END, with_ids: bool = True
) -> DataFrame:
    """Pieces of the documents with sequence_id and offset, filled without gaps from 0.

    ``tokenizer`` is the path of a tokenizer file that the driver can read.  A document is its ids
    and ``end``; only one of more than ``size`` ids is cut, into pieces of ``size`` of which the first
    may be shorter.  A null or empty text is ``end`` alone.  The result has the columns in ``keep``,
    piece, start, length, ids_crc32, with ``with_ids`` the ids (little-endian unsigned 32-bit), and
    the place.  Equal rows are packed each; an empty table gives an empty result; columns not in
    ``keep`` take no part.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = f.read()
    marked = docs.select(*(F.col(f"`{k}`").alias(f"__c{i}") for i, k in enumerate(keep)), F.col(f"`{text}`").alias("__text"))
    kept = [f.name for f in marked.schema if f.name != "__text"]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema if f.name != "__text")
    shape = ", ".join(x for x in (fields, PIECES, "ids binary" if with_ids else "") if x)
    pieces = cut(map_arrow(marked, lambda it: piece_batches(it, "__text", content, size, end, with_ids), shape))
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most size rows
    course, _ = best_fit(counts, size)
    bucket = F.pmod(F.xxhash64(*kept, "piece", "start", "ids_crc32"), F.lit(BUCKETS))
    dealt = pieces.withColumn("__bucket", bucket)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("n")).select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy(*kept, "piece", "ids_crc32"))
    ranked = dealt.withColumn("__within", within).join(heads, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__before") + F.col("__within") - 1).select(*pieces.columns, "__rank")
    span = 1 + max(counts.values(), default=0)
    placed = map_arrow(ranked, lambda it: _placed(it, course, span), f"{shape}, sequence_id long, offset long")
    return placed.select(*(F.col(f"__c{i}").alias(k) for i, k in enumerate(keep)), *[c for c in placed.columns if c not in kept])
