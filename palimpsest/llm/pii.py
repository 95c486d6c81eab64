"""Personal data: patterns propose spans, checksums confirm them, context words adjust a score.

Base kinds (email, ip, card, phone) are always reported once their validator accepts them; the
context only moves their score.  The further kinds (iban, ssn, and phone numbers without a leading
plus) are reported when their score reaches ``MIN_SCORE``: an IBAN by its mod-97 check digits unless
words nearby speak of something else, the others only beside words that speak of them.

A batch is first searched for digits and ``@`` on its bytes; only documents that hold one are decoded.
The patterns are written so that a scan takes linear time: a run of characters that failed is never
scanned again from its middle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.scratch import map_arrow
from palimpsest.llm.textkernel import chunks

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
MIN_SCORE = 0.6
#: Code points before and after a span in which context words are looked for.
CONTEXT = 48

# Words that raise a kind's score, and words that lower it.
RAISE = {
    "email": ("email", "e-mail", "mail", "contact", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
LOWER = ("version", "isbn", "order", "invoice", "serial", "example", "release", "chapter")
#: Score of a validated span without context.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "local_phone": 0.3}

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(?:@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?+")
_IP = re.compile(r"[0-9]++(?:(?:\.[0-9]++){3})?+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL = re.compile(r"(?<![0-9+.-])\(?0[0-9](?:[ ()./-]{0,2}[0-9]){7,12}(?![0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")

SPAN = "array<struct<kind:string,start:int,end:int,score:double,base:boolean>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("base", pa.bool_())]))


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the check digits of an IBAN without blanks are right."""
    return int("".join(str(int(x, 36)) for x in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(x for x in s if "0" <= x <= "9")


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans of IBANs; upper-case words and numbers that follow one are left out until the check digits are right."""
    m = _IBAN.search(text)
    while m:
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 0, -1) if m[0][i] == " ")]
        codes = ((e, text[m.start() : e].replace(" ", "")) for e in ends)
        end = next((e for e, code in codes if 15 <= len(code) <= 34 and mod97(code)), None)
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 4)


def _proposed(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Validated spans with the name of their prior."""
    if "@" in text:
        for m in _EMAIL.finditer(text):
            if "@" in m[0]:
                yield "email", m.start(), m.end(), "email"
    for m in _IP.finditer(text):
        if "." in m[0] and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end(), "ip"
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end(), "card"
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end(), "phone"
    for start, end in _ibans(text):
        yield "iban", start, end, "iban"
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end(), "ssn"
    for m in _LOCAL.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end(), "local_phone"


def find_spans(text: str) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, whether base) by start and then kind; code points, end exclusive."""
    out: list[tuple[str, int, int, float, bool]] = []
    for kind, start, end, prior in _proposed(text):
        near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT])}
        score = PRIOR[prior] + 0.35 * (not near.isdisjoint(RAISE[kind])) - 0.25 * (not near.isdisjoint(LOWER))
        base = prior in BASE_KINDS
        if base or score >= MIN_SCORE:
            out.append((kind, start, end, min(1.0, max(0.0, round(score, 2))), base))
    firm = sorted((s, e) for kind, s, e, _, base in out if base or kind == "iban")
    starts = np.array([s for s, _ in firm])
    ends = np.maximum.accumulate([e for _, e in firm]) if firm else starts
    kept = []
    for kind, start, end, score, base in out:
        i = int(np.searchsorted(starts, end)) if firm else 0
        if base or kind == "iban" or not (i and ends[i - 1] > start):
            kept.append((kind, start, end, score, base))
    return sorted(kept, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _suspect(buf: np.ndarray) -> np.ndarray:
    """Bytes without which a document holds nothing of interest: digits and @."""
    return np.flatnonzero(((buf >= 48) & (buf <= 57)) | (buf == 64))


def span_batches(batches: Iterator[pa.RecordBatch], column: str, redacted: bool) -> Iterator[pa.RecordBatch]:
    """The input's columns with ``spans``, and the text with its spans replaced if asked for."""
    for batch in batches:
        for c in chunks(batch.column(column)):
            found: list[list[dict]] = [[] for _ in range(c.n)]
            changed: dict[int, str] = {}
            rows = np.unique(np.searchsorted(c.offs, _suspect(c.buf), "right") - 1)
            for i in rows.tolist():
                text = c.text(i)
                spans = find_spans(text)
                found[i] = [{"kind": k, "start": s, "end": e, "score": p, "base": b} for k, s, e, p, b in spans]
                if redacted and spans:
                    changed[i] = redact_text(text, spans)
            part = batch.slice(c.first, c.n)
            columns, names = list(part.columns), list(part.schema.names)
            if redacted:
                old = part.column(column)
                if changed:
                    new = old.to_pylist()
                    for i, text in changed.items():
                        new[i] = text
                    columns[names.index(column)] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, _SPAN)], [*names, "__spans"])


def redact_text(text: str, spans: list[tuple[str, int, int, float, bool]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its (first) kind in angle brackets."""
    out, at, last = [], 0, -1
    for kind, start, end, *_ in spans:
        if start >= last:
            out += [text[at:start], f"<{kind.upper()}>"]
        last = at = max(last, end)
    return "".join([*out, text[at:]])


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``spans``: kind, start, end (code points, end exclusive), score, base.

    One row per input row, repeated rows included; a null or empty text has no spans; an empty table
    gives an empty result; other columns take no part.  Spans are sorted by start, then kind.
    """
    source = docs.select(*(F.col(f"`{k}`") for k in keep), F.col(f"`{text}`").alias("__text"))
    kept = source.drop("__text")
    names = [*kept.columns, "spans"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in span_batches(it, "__text", False):
            yield b.drop_columns(["__text"]).rename_columns(names)

    return map_arrow(source, run, f"{_fields(kept)}, spans {SPAN}" if keep else f"spans {SPAN}")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find``'s spans: n_<kind> and base_sha256 of the base kinds, all spans and their scores as text."""
    base = F.filter("spans", lambda s: s["base"])
    written = lambda a: F.concat_ws(",", F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = {f"n_{k}": number(k) for k in BASE_KINDS}
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *(v.alias(k) for k, v in counts.items()), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), scores)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by ``<KIND>``; the columns stay as they were.

    ``length``, if the table has that column, is set to the new number of code points where a text
    changed.
    """
    names = docs.columns
    at = f"__c{names.index(text)}"
    marked = docs.select(*(F.col(f"`{n}`").alias(f"__c{i}") for i, n in enumerate(names)))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in span_batches(it, at, True):
            spans = b.column(b.num_columns - 1)
            yield b.drop_columns(["__spans"]).append_column("__hit", pa.array(spans.value_lengths().to_numpy(False) > 0))

    out = map_arrow(marked, run, f"{_fields(marked)}, __hit boolean")
    if length in names:
        n = f"__c{names.index(length)}"
        out = out.withColumn(n, F.when(F.col("__hit"), F.length(at).cast(marked.schema[n].dataType)).otherwise(F.col(n)))
    return out.select(*(F.col(f"__c{i}").alias(n) for i, n in enumerate(names)))
