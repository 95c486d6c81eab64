"""Typed columns for expressions, given what the variables stand for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from palimpsest.errors import ExecutionError
from palimpsest.functions.values import SPARK_TYPES, Value, equal, literal, null, truth
from palimpsest.language.syntax import Binary, Expression, Item, Literal, MapLiteral, Property, Variable
from palimpsest.operators.state import column_of

#: Properties that every commit has; they hide keys of the same name.
OWN = {"hash": "string", "message": "string", "timestamp": "int", "root_hamt": "string"}


class Unbound(ExecutionError):
    """A variable that no pattern binds."""

    def __init__(self, name: str):
        super().__init__(f"unbound variable '{name}'")


@dataclass
class Bound:
    """A commit in a row: the prefix of its columns and the keys that these include."""

    prefix: str
    keys: list[str] = field(default_factory=list)

    def property(self, name: str) -> Value:
        kind = OWN.get(name)
        if kind:
            return Value(kind, F.col(self.prefix + name))
        return Value("string", F.col(self.prefix + column_of(name, self.keys))) if name in self.keys else null()


Scope = dict[str, Bound]


def evaluate(e: Expression, scope: Scope) -> Value:
    """The value of an expression; raises ``Unbound``."""
    if isinstance(e, Literal):
        return literal(e.type, e.value)
    if isinstance(e, MapLiteral):
        return Value("map", null().column, {k: evaluate(v, scope) for k, v in e.entries.items()})
    if isinstance(e, Variable):
        return _bound(e, scope).property("hash")
    if isinstance(e, Property):
        if isinstance(e.of, Variable):
            return _bound(e.of, scope).property(e.name)
        inside = evaluate(e.of, scope)
        return (inside.entries or {}).get(e.name) or null()
    a, b = evaluate(e.left, scope), evaluate(e.right, scope)
    if e.op == "AND":
        return Value("bool", truth(a) & truth(b))
    if e.op == "OR":
        return Value("bool", truth(a) | truth(b))
    return Value("bool", equal(a, b) if e.op == "=" else ~equal(a, b))


def _bound(v: Variable, scope: Scope) -> Bound:
    if v.name not in scope:
        raise Unbound(v.name)
    return scope[v.name]


def parts(e: Expression | None) -> Iterator[Expression]:
    """An expression and all within it."""
    if e is None:
        return
    yield e
    if isinstance(e, MapLiteral):
        for v in e.entries.values():
            yield from parts(v)
    elif isinstance(e, Property):
        yield from parts(e.of)
    elif isinstance(e, Binary):
        yield from parts(e.left)
        yield from parts(e.right)


def names_used(e: Expression | None) -> set[str]:
    """Variables that an expression names."""
    return {p.name for p in parts(e) if isinstance(p, Variable)}


def keys_used(expressions: list[Expression], variable: str) -> list[str]:
    """Properties of a variable that some expressions read, other than every commit's own."""
    read = {p.name for e in expressions for p in parts(e) if isinstance(p, Property) and isinstance(p.of, Variable) and p.of.name == variable}
    return sorted(read)


def conjuncts(e: Expression | None) -> list[Expression]:
    """What must all be true for the expression to be true."""
    if e is None:
        return []
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, Binary) and e.op == "AND" else [e]


def label(item: Item, place: int) -> str:
    """A result column's name: alias, variable or property, else its place."""
    e = item.expression
    return item.alias or (e.name if isinstance(e, Variable | Property) else f"col{place}")


def project(items: list[Item], value_of: Callable[[Expression], Value]) -> list[F.Column]:
    """Result columns of a SELECT."""
    out = []
    for i, item in enumerate(items):
        v = value_of(item.expression)
        out.append(v.column.cast(SPARK_TYPES[v.type]).alias(label(item, i)))
    return out
