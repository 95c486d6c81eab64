"""Typed column expressions with the language's equality and truth.

A stored value is always text; only ``timestamp``, literals and comparisons have other types, so the
type of every expression is known before it runs.  Types: null, bool, int, float, string, map.
"""

from __future__ import annotations

import string as letters
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two floats closer than this are equal: the spacing of doubles at one.
EPSILON = 2.220446049250313e-16
#: From this many bytes on, a string equals any that begins with it, ASCII case aside.
PREFIX = 6

SPARK_TYPES = {"null": "string", "bool": "boolean", "int": "bigint", "float": "double", "string": "string", "map": "string"}


@dataclass(frozen=True)
class Value:
    """A column with its static type; maps are folded before they become columns."""

    type: str
    column: Column
    entries: dict | None = None


def literal(kind: str, value: object) -> Value:
    """A literal's value."""
    return Value(kind, F.lit(value).cast(SPARK_TYPES[kind]))


def null() -> Value:
    """The value of a missing property."""
    return literal("null", None)


def _fold(c: Column) -> Column:
    return F.translate(c, letters.ascii_uppercase, letters.ascii_lowercase)


def _same_text(a: Column, b: Column) -> Column:
    """Equal, or one of at least PREFIX bytes begins the other, ASCII case aside."""
    x, y = _fold(a), _fold(b)
    begins = lambda p, whole, raw: (F.octet_length(raw) >= PREFIX) & F.startswith(whole, p)
    return (a == b) | begins(x, y, a) | begins(y, x, b)


def _whole_number(text: Column) -> Column:
    """The integer that a text spells out in full, else null."""
    return F.when(text.rlike(r"^[+-]?[0-9]+\z"), text.try_cast("bigint"))


def equal(a: Value, b: Value) -> Column:
    """The language's equality: true or false, never null.

    Nulls equal each other and nothing else; numbers of different kinds are never equal; an integer
    equals a text that spells it out; all other pairs of different types differ.
    """
    kinds = {a.type, b.type}
    if "map" in kinds:
        return F.lit(False)
    if a.type == b.type == "null":
        return F.lit(True)
    if "null" in kinds:
        return (b if a.type == "null" else a).column.isNull()
    if kinds == {"string"}:
        rule = _same_text(a.column, b.column)
    elif kinds == {"float"}:
        rule = F.abs(a.column - b.column) < EPSILON
    elif len(kinds) == 1:
        rule = a.column == b.column
    elif kinds == {"int", "string"}:
        text, number = (a, b) if a.type == "string" else (b, a)
        rule = _whole_number(text.column) == number.column
    else:
        rule = F.lit(False)
    return (a.column.isNull() & b.column.isNull()) | F.coalesce(rule, F.lit(False))


def strictly_equal(stored: Value, wanted: Value) -> Column:
    """Equality of a node's property filter: same type and same value; null matches what is missing."""
    if wanted.type == "null":
        return stored.column.isNull()
    if stored.type != wanted.type:
        return F.lit(False)
    return F.coalesce(stored.column == wanted.column, F.lit(False))


def truth(v: Value) -> Column:
    """Whether a value counts as true."""
    if v.type == "map":
        return F.lit(bool(v.entries))
    if v.type == "null":
        return F.lit(False)
    test = v.column if v.type == "bool" else v.column != F.lit("" if v.type == "string" else 0)
    return F.coalesce(test, F.lit(False))


def stored_text(kind: str, value: object) -> str:
    """The text under which a literal is stored: null as the empty text, floats without exponent."""
    if kind == "null":
        return ""
    if kind == "bool":
        return "true" if value else "false"
    if kind == "float":
        plain = format(Decimal(repr(value)), "f")
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    return str(value)
