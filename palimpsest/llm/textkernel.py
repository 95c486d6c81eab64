"""Vectorised text kernel shared by the corpus operators.

Everything works on the raw UTF-8 buffer of an Arrow string column, so a batch of documents is cut
into words and hashed with a fixed number of numpy passes and no Python loop over words.  A word is
a maximal run of bytes other than space and TAB..CR; those separators are ASCII, hence byte
boundaries and code point boundaries agree.

Batches are processed in chunks of about ``CHUNK_BYTES`` of text so that a Python worker's memory
does not depend on the Arrow batch size; a longer document forms a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text handled at once by a Python worker, in bytes.
CHUNK_BYTES = 1 << 18

_U = np.uint64
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_BASE = _U(0x9E6C63D0876A9A47)
_powers = np.cumprod(np.full(64, _BASE, np.uint64))
_downs = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def powers(n: int) -> np.ndarray:
    """At least n successive powers of the hash base."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), _BASE, np.uint64))
    return _powers


def _inverse_powers(n: int) -> np.ndarray:
    """At least n successive powers of the hash base's inverse modulo 2**64, from the power 0 on."""
    global _downs
    if len(_downs) < n:
        factors = np.full(max(n, 2 * len(_downs)), pow(int(_BASE), -1, 1 << 64), np.uint64)
        factors[0] = 1
        _downs = np.cumprod(factors)
    return _downs


@dataclass
class Chunk:
    """Some documents of a batch: their rows, bytes, and byte offsets (one more than rows)."""

    first: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> str:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes().decode("utf-8", "replace")


@dataclass
class Words:
    """Words of a chunk: byte spans, hashes, and per document the index of its first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray | None
    bounds: np.ndarray


def column_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offs


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Successive runs of whole documents of about ``size`` bytes."""
    buf, offs = column_buffer(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + size, "right")) - 1
        to = min(n, max(at + 1, to))
        yield Chunk(at, buf[offs[at] : offs[to]], offs[at : to + 1] - offs[at])
        at = to


def words_of(c: Chunk, fold_case: bool = False, hashed: bool = True) -> Words:
    """Words of every document of a chunk; ``fold_case`` hashes A-Z as a-z."""
    inside = ~_SEPARATOR[c.buf]
    size = len(c.buf)
    first = np.zeros(size + 1, bool)
    first[c.offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:size]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:size]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    bounds = np.searchsorted(starts, c.offs)
    return Words(starts, ends, span_hashes(c.buf, starts, ends, fold_case) if hashed else None, bounds)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit hash of each of the disjoint, ascending, nonempty byte spans."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    values = _FOLDED if fold_case else _BYTES
    if len(buf) <= 4 * CHUNK_BYTES:
        # sums over the whole buffer; a word's place in it is divided out again
        up, down = powers(len(buf)), _inverse_powers(len(buf))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(values[buf] * up[: len(buf)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + lens.astype(np.uint64))
    heads = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(heads, lens)
    at = place + np.repeat(starts, lens)
    value = values[buf[at]]
    value *= powers(int(lens.max()))[place]
    return mix(np.add.reduceat(value, heads) + lens.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each position; the last k - 1 wrap and are to be ignored."""
    n = len(hashes)
    around = np.resize(hashes, n + k - 1) if n else hashes
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _U(0xD1342543DE82EF95)
        out += around[j : j + n]
    out += _U(k)
    return mix(out)


def code_points(buf: np.ndarray) -> np.ndarray:
    """Prefix count of code points: entry i is the number that begin before byte i."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out
