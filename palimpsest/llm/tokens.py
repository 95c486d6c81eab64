"""Token ids of whole texts, computed once for each distinct unit of a worker's documents.

Byte-level BPE files split a text before merging, and never across the place where white space begins
after other characters.  A text is therefore cut there into units (white space and the word after
it), each distinct unit is tokenised once by the ``tokenizers`` library and kept, and the ids of a
document are put together by numpy.  A text with white space other than the ASCII kinds is one unit.
"""

from __future__ import annotations

import json
from itertools import chain, repeat

import numpy as np
import tiktoken

from palimpsest.llm.textkernel import _SEPARATOR, Chunk, span_hashes

#: Units that a worker keeps at most, then it starts anew; longer units than this, in bytes, are not kept.
KEEP, LONGEST = 300_000, 64
_BLANKS = {bytes([x]) for x in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)}


#: Fixed value: the pattern by which byte-level files of this kind split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _merger(model: dict) -> tiktoken.Encoding | None:
    """The same merges in a faster library, if the ids are in the order of the merges."""
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model.get("merges", ())]
    vocab = model.get("vocab", {})
    if not pairs or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[x] for x in token): i for token, i in vocab.items() if i < 256 + len(pairs)}
    return tiktoken.Encoding("units", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(pairs) else None


def shared_units(content: str) -> Units:
    """One tokenizer a worker process for the same file."""
    key = hash(content)
    if key not in _units:
        _units[key] = Units(content)
    return _units[key]


_units: dict[int, Units] = {}


class Units:
    """Tokenises chunks of texts; made from the content of a tokenizer file."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_str(content)
        shape = json.loads(content)
        split = shape.get("pre_tokenizer") or {}
        self._by_unit = not shape.get("normalizer") and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        self._bytes = np.zeros(self._tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in self._tokenizer.get_vocab().items():
            self._bytes[i] = len(token)  # a byte-level token has one character for each byte
        self._special = [x["content"].encode() for x in shape.get("added_tokens") or ()]
        self._merger = _merger(shape["model"]) if self._by_unit else None
        self._forget()

    def _forget(self) -> None:
        self._known: dict[int, int] = {}
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._from = np.zeros(1 << 14, np.int64)
        self._n = np.zeros(1 << 14, np.int64)
        self._count = 0

    def _tokenized(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts in a row, and how many each has."""
        if self._by_unit:
            # No token crosses from one unit to the next where that begins with white space.
            joined = b"".join(raw)
            text = joined.decode("utf-8", "replace")
            if self._merger is not None and not any(x in joined for x in self._special):
                ids = self._merger.encode_to_numpy(text, disallowed_special=())
            else:
                ids = np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            upto, stops = np.cumsum(self._bytes[ids]), np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            at = np.searchsorted(upto, stops)
            if len(ids) and upto[-1] == len(joined) and (upto[np.minimum(at, len(ids) - 1)] == stops).all():
                return ids, np.diff(at + 1, prepend=0)
        got = [e.ids for e in self._tokenizer.encode_batch([x.decode("utf-8", "replace") for x in raw], add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(n.sum())), n

    def _add(self, raw: list[bytes]) -> int:
        """Tokenises texts; the index of the first of their entries."""
        first = self._count
        apart = [i for i, x in enumerate(raw) if x[:1] not in _BLANKS]
        order = np.array([i for i, x in enumerate(raw) if x[:1] in _BLANKS] + apart, np.int64)
        ids, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        cut = len(raw) - len(apart)
        for part in ([raw[i] for i in order[:cut]], *([raw[i]] for i in apart)):
            if part:
                more, each = self._tokenized(part)
                ids, n = np.append(ids, more), np.append(n, each)
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while self._count + len(n) > len(self._n):
            self._n, self._from = (np.concatenate([x, np.zeros_like(x)]) for x in (self._n, self._from))
        self._ids[self._used : self._used + len(ids)] = ids
        self._from[first + order] = self._used + np.cumsum(n) - n
        self._n[first + order] = n
        self._used += len(ids)
        self._count += len(n)
        return first

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a chunk's texts in a row, and the offsets of each text's."""
        if self._count > KEEP:
            self._forget()
        if not len(c.buf):
            return np.zeros(0, np.uint32), np.zeros(c.n + 1, np.int64)
        blank = _SEPARATOR[c.buf]
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        whole = np.unique(np.searchsorted(c.offs, _other_space(c.buf), "right") - 1) if self._by_unit else np.arange(c.n)
        for row in whole.tolist():
            begins[c.offs[row] : c.offs[row + 1]] = False
        heads = c.offs[:-1][np.diff(c.offs) > 0]
        begins[heads] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(c.buf))
        keys, at, inverse = np.unique(span_hashes(c.buf, starts, ends), return_index=True, return_inverse=True)
        entry = np.fromiter(map(self._known.get, keys.tolist(), repeat(-1)), np.int64, len(keys))
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            raw = c.buf.tobytes()
            spans = list(zip(starts[at[fresh]].tolist(), ends[at[fresh]].tolist(), strict=True))
            first = self._add([raw[s:e] for s, e in spans])
            entry[fresh] = first + np.arange(len(fresh))
            self._known.update((k, first + i) for i, (k, (s, e)) in enumerate(zip(keys[fresh].tolist(), spans, strict=True)) if e - s <= LONGEST)
        entry = entry[inverse]
        n = self._n[entry]
        upto = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=upto[1:])
        ids = self._ids[np.repeat(self._from[entry] - upto[:-1], n) + np.arange(int(upto[-1]))]
        return ids, upto[np.searchsorted(starts, c.offs)]


def _other_space(buf: np.ndarray) -> np.ndarray:
    """Places of bytes that may begin white space outside ASCII, or of the ASCII separators 1C to 1F."""
    after = np.append(buf[1:], 0)
    lead = (buf == 0xC2) & ((after == 0x85) | (after == 0xA0)) | (buf == 0xE1) & (after == 0x9A)
    lead |= (buf == 0xE2) & ((after == 0x80) | (after == 0x81)) | (buf == 0xE3) & (after == 0x80)
    return np.flatnonzero(lead | ((buf >= 0x1C) & (buf <= 0x1F)))
