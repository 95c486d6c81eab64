"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Target:
    """HEAD, BRANCH name, COMMIT hash or TAG name."""

    kind: str
    name: str = ""


@dataclass(frozen=True)
class Literal:
    """A null, bool, int, float or string, told apart by ``type``."""

    type: str
    value: object


@dataclass(frozen=True)
class MapLiteral:
    entries: dict[str, Expression]


@dataclass(frozen=True)
class Variable:
    name: str


@dataclass(frozen=True)
class Property:
    of: Expression
    name: str


@dataclass(frozen=True)
class Binary:
    """op: =, !=, AND or OR."""

    op: str
    left: Expression
    right: Expression


Expression = Literal | MapLiteral | Variable | Property | Binary


@dataclass(frozen=True)
class Node:
    variable: str | None = None
    label: str | None = None
    properties: dict[str, Expression] = field(default_factory=dict)


@dataclass(frozen=True)
class Hops:
    """The multiplier of an edge: bounds as written, None where open; ``exact`` for a single number."""

    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class Edge:
    """type: PARENT, CHILD, ANCESTOR or DESCENDANT; the arrow's direction has no effect on results."""

    type: str
    outgoing: bool
    hops: Hops | None = None


@dataclass(frozen=True)
class Pattern:
    """Nodes and the edges between them, one edge fewer."""

    nodes: list[Node]
    edges: list[Edge]


@dataclass(frozen=True)
class Traversal:
    """ANCESTORS of one target, MERGE_BASE or SHORTEST_PATH of two."""

    kind: str
    targets: list[Target]


@dataclass(frozen=True)
class Item:
    expression: Expression
    alias: str | None = None


@dataclass(frozen=True)
class Query:
    context: Target | None = None
    patterns: list[Pattern] | None = None
    traversal: Traversal | None = None
    where: Expression | None = None
    select: list[Item] | None = None


@dataclass(frozen=True)
class Commit:
    payload: dict[str, Expression]
    message: str | None = None
    parents: list[Target] | None = None


@dataclass(frozen=True)
class CreateBranch:
    name: str
    start: Target | None = None


@dataclass(frozen=True)
class DeleteBranch:
    name: str


@dataclass(frozen=True)
class Checkout:
    target: Target


@dataclass(frozen=True)
class Merge:
    source: Target
    into: Target
    strategy: str = "FAST_FORWARD"


@dataclass(frozen=True)
class Diff:
    left: Target
    right: Target
    path: str | None = None


Statement = Query | Commit | CreateBranch | DeleteBranch | Checkout | Merge | Diff


@dataclass(frozen=True)
class CreateCollection:
    name: str
    keys: list[tuple[str, str]]


@dataclass(frozen=True)
class CreateIndex:
    collection: str
    path: str
    type: str = "STRING"


@dataclass(frozen=True)
class DropIndex:
    collection: str
    path: str


Migration = CreateCollection | CreateIndex | DropIndex
