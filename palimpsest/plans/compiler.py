"""Queries as DataFrames: anchors, patterns, traversals and projections.

Only what a query reads is rebuilt: state keys are gathered from the whole query and filtered in the
change log, and the parts of a WHERE that concern one variable are applied to that variable's commits
before any edge is followed.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.errors import BranchNotFound, CommitNotFound, ExecutionError, InvalidTarget
from palimpsest.functions.values import literal, strictly_equal, truth
from palimpsest.language.syntax import Edge, Expression, Literal, Node, Pattern, Query, Target, Variable
from palimpsest.operators import paths, reach, walks
from palimpsest.operators.graph import Graph
from palimpsest.operators.state import EMPTY_ROOT, commit_states, digest, states
from palimpsest.plans.scope import OWN, Bound, Scope, Unbound, conjuncts, evaluate, keys_used, names_used, parts, project

SUMMARY = ("hash", "message", "timestamp")


def resolve(graph: Graph, target: Target) -> int:
    """The commit_id that a target stands for."""
    if target.kind == "TAG":
        raise ExecutionError(f"tags are not implemented yet (TAG {target.name})")
    if target.kind == "COMMIT":
        return resolve_hash(graph, target.name)
    name = graph.head if target.kind == "HEAD" else target.name
    row = graph.refs.filter(F.col("name") == name).select("commit_id").first()
    if row is None:
        raise BranchNotFound(name)
    return int(row[0])


def resolve_hash(graph: Graph, digits: str) -> int:
    """The commit of a full hash or of a prefix that only one has."""
    digits = digits.lower()
    if len(digits) == 64:
        row = graph.commits.filter(F.col("hash") == digits).select("commit_id").first()
        if row is None:
            raise CommitNotFound(digits)
        return int(row[0])
    found = graph.commits.filter(F.startswith("hash", F.lit(digits))).select("commit_id").limit(2).collect()
    if len(found) != 1:
        raise InvalidTarget(f"{'ambiguous hash prefix' if found else 'no commit with hash prefix'} '{digits}'")
    return int(found[0][0])


def with_properties(graph: Graph, commits: DataFrame | None, prefix: str, keys: list[str], root: bool) -> DataFrame:
    """Commits under prefixed names: id, lane, pos, every commit's own properties, and state keys."""
    rows = commit_states(graph, keys)
    if commits is not None:
        rows = rows.join(commits.select("commit_id"), "commit_id", "left_semi")
    if root:
        roots = digest(states(graph, rows.select(F.col("commit_id").alias("id"), "lane", "pos")))
        rows = rows.join(roots.withColumnRenamed("id", "commit_id"), "commit_id", "left").withColumn("root", F.coalesce("root", F.lit(EMPTY_ROOT)))
    own = [F.col("commit_id").alias(f"{prefix}id"), *(F.col(c).alias(prefix + c) for c in ("lane", "pos", "hash", "message")), F.col("ts").alias(f"{prefix}timestamp")]
    if root:
        own.append(F.col("root").alias(f"{prefix}root_hamt"))
    return rows.select(*own, *(F.col(c).alias(prefix + c) for c in rows.columns if c.startswith("__state_")))


def bounds(edge: Edge) -> tuple[int, int]:
    """Least and most steps of an edge; open ends are bounded."""
    if edge.hops is None:
        return (1, 1) if edge.type in ("PARENT", "CHILD") else (1, walks.OPEN_BOUND)
    least, most = edge.hops.least, edge.hops.most
    return (1 if least is None else least, walks.OPEN_BOUND if most is None else most)


class MatchPlan:
    """One query's MATCH over a graph."""

    def __init__(self, graph: Graph, query: Query, context: int):
        self.graph, self.query = graph, query
        self.tops = reach.reachable(graph)
        ranges = self.tops
        if query.context is not None and query.context.kind == "COMMIT":  # branches are reached as it is
            ranges = reach.reach(graph, graph.tips().unionByName(graph.places([context])))
        self.universe = reach.within(graph.commits, ranges)
        self.read = [*([query.where] if query.where is not None else []), *(i.expression for i in query.select or [])]

    def result(self) -> DataFrame:
        """The union of all patterns' rows."""
        out: DataFrame | None = None
        for pattern in self.query.patterns or []:
            rows = self.pattern(pattern)
            if rows is None:
                continue
            if out is None:
                out = rows
            elif self.query.select:
                out = out.union(rows)
            else:
                out = out.unionByName(rows, allowMissingColumns=True)
        if out is None:
            raise ExecutionError("no pattern of the query binds its variables")
        return out

    def pattern(self, pattern: Pattern) -> DataFrame | None:
        """Projected rows of one pattern; None if it has none and can't be projected."""
        scope: Scope = {}
        names = [n.variable or f"_{2 * i}" for i, n in enumerate(pattern.nodes)]
        unbound = names_used(self.query.where) - set(names)
        tests = [] if unbound else conjuncts(self.query.where)
        rows, rest = self._first(pattern.nodes[0], names[0], scope, tests)
        if unbound:  # an error in WHERE keeps no row
            rows = rows.filter(F.lit(False))
        for i, edge in enumerate(pattern.edges):
            rows, rest = self._step(rows, edge, pattern.nodes[i + 1], names[i], names[i + 1], scope, rest)
        for test in rest:
            rows = rows.filter(truth(evaluate(test, scope)))
        if self.query.select is None:
            return rows.select(*(F.col(f"{scope[n].prefix}hash").alias(n) for n in dict.fromkeys(names)))
        try:
            return rows.select(*project(self.query.select, lambda e: evaluate(e, scope)))
        except Unbound:
            if rows.isEmpty():
                return None
            raise

    def _bind(self, node: Node, name: str, scope: Scope, tests: list[Expression], commits: DataFrame | None) -> tuple[DataFrame, list[Expression]]:
        """Candidates for a node, and the tests that remain."""
        read = [*self.read]
        keys = sorted({*keys_used(read, name), *node.properties} - OWN.keys())
        root = "root_hamt" in {*keys_used(read, name), *node.properties}
        bound = scope[name] = Bound(f"n{len(scope)}_", keys)
        rows = with_properties(self.graph, commits, bound.prefix, keys, root)
        rows = self._filtered(rows, node, bound)
        own = [t for t in tests if names_used(t) == {name}]
        for test in own:
            rows = rows.filter(truth(evaluate(test, scope)))
        return rows, [t for t in tests if t not in own]

    def _filtered(self, rows: DataFrame, node: Node, bound: Bound) -> DataFrame:
        for key, wanted in node.properties.items():
            if not isinstance(wanted, Literal):
                raise ExecutionError("node properties must be literals")
            rows = rows.filter(strictly_equal(bound.property(key), literal(wanted.type, wanted.value)))
        return rows

    def _first(self, node: Node, name: str, scope: Scope, tests: list[Expression]) -> tuple[DataFrame, list[Expression]]:
        return self._bind(node, name, scope, tests, self.universe)

    def _step(
        self, rows: DataFrame, edge: Edge, node: Node, came: str, name: str, scope: Scope, tests: list[Expression]
    ) -> tuple[DataFrame, list[Expression]]:
        at = scope[came].prefix
        pairs = self._pairs(rows.select(F.col(f"{at}id").alias("src"), F.col(f"{at}lane").alias("lane"), F.col(f"{at}pos").alias("pos")), edge)
        moved = rows.join(pairs, rows[f"{at}id"] == pairs["src"]).drop("src")
        if name in scope:
            bound = scope[name]
            bound_again = moved.filter(F.col("dst") == F.col(f"{bound.prefix}id")).drop("dst")
            return self._filtered(bound_again, node, bound), tests
        candidates, rest = self._bind(node, name, scope, tests, None)
        return moved.join(candidates, moved["dst"] == candidates[f"{scope[name].prefix}id"]).drop("dst"), rest

    def _pairs(self, sources: DataFrame, edge: Edge) -> DataFrame:
        """src, dst of an edge from the given commits."""
        least, most = bounds(edge)
        down = edge.type in ("PARENT", "ANCESTOR")
        if (least, most) != (1, 1):
            return walks.walks(self.graph, sources.distinct(), least, most, down, None if down else self.tops).select("src", "dst")
        edges = self.graph.edges
        src, dst = ("child", "parent") if down else ("parent", "child")
        if not down:
            inside = reach.within(self.graph.commits, self.tops).select(F.col("commit_id").alias("child"))
            edges = edges.join(inside, "child", "left_semi")
        # partitioned for the join that follows, so the distinct adds no shuffle
        return edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).repartition("src").dropDuplicates(["src", "dst"])


def _single(graph: Graph, query: Query, commits: DataFrame, variable: str, value_of: Callable[[Expression, Scope], object] | None = None) -> tuple[DataFrame, Scope]:
    """Some commits bound to one variable."""
    expressions = [*([query.where] if query.where is not None else []), *(i.expression for i in query.select or [])]
    plain = {e.name for e in expressions if isinstance(e, Variable)} if value_of else set()
    keys = sorted({*keys_used(expressions, variable), *plain} - OWN.keys())
    root = any(getattr(p, "name", "") == "root_hamt" for e in expressions for p in parts(e))
    bound = Bound("n0_", keys)
    return with_properties(graph, commits, "n0_", keys, root), {variable: bound}


def use(graph: Graph, query: Query) -> DataFrame:
    """A query of one commit, HEAD's unless USE names another."""
    target = resolve(graph, query.context or Target("HEAD"))
    rows, scope = _single(graph, query, graph.places([target]), "_")
    if query.where is not None:
        rows = rows.filter(truth(evaluate(query.where, scope)))
    if query.select:
        return rows.select(*project(query.select, lambda e: evaluate(e, scope)))
    return rows.select(*(F.col(f"n0_{c}").alias(c) for c in SUMMARY))


def traverse(graph: Graph, query: Query) -> DataFrame:
    """A TRAVERSE; rows are in order of hash for ancestors, of steps for a path."""
    assert query.traversal is not None
    if query.where is not None:
        warnings.warn("WHERE has no effect after TRAVERSE", stacklevel=2)
    kind = query.traversal.kind
    ids = [resolve(graph, t) for t in query.traversal.targets]
    order = "n0_hash"
    if kind == "ANCESTORS":
        commits = reach.within(graph.commits, reach.reach(graph, graph.places(ids)))
    elif kind == "MERGE_BASE":
        commits = paths.merge_base(graph, *ids)
    else:
        commits = paths.shortest_path(graph, *ids)
        if commits.isEmpty():
            ends = {r["commit_id"]: r["hash"] for r in graph.commits.filter(F.col("commit_id").isin(ids)).select("commit_id", "hash").collect()}
            raise ExecutionError(f"no path between {ends[ids[0]]} and {ends[ids[1]]}")
    rows, scope = _single(graph, query, commits, "hash", evaluate)
    if kind == "MERGE_BASE":
        scope["_"] = scope["hash"]
    if kind == "SHORTEST_PATH":
        rows = rows.join(commits.select(F.col("commit_id").alias("n0_id"), "step"), "n0_id")
        order = "step"
    rows = rows.orderBy(order)
    if query.select is None:
        return rows.select(*(F.col(f"n0_{c}").alias(c) for c in ("hash", "timestamp", "message")))
    bare = lambda e: scope["hash"].property(e.name) if isinstance(e, Variable) else evaluate(e, scope)
    return rows.select(*project(query.select, bare))


def compile_query(graph: Graph, query: Query) -> DataFrame:
    """The rows of a query."""
    if query.patterns is not None:
        return MatchPlan(graph, query, resolve(graph, query.context or Target("HEAD"))).result()
    return traverse(graph, query) if query.traversal is not None else use(graph, query)
