"""Random commit graphs against plain walks over them."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import paths, reach, state, walks
from palimpsest.sources.repository import Repository


class Plain:
    """The same history in dictionaries."""

    def __init__(self):
        self.parents, self.states = {}, {}

    def ancestors(self, c):
        seen, todo = set(), [c]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += self.parents[x]
        return seen

    def children(self, inside):
        out = {}
        for c in inside:
            for p in self.parents[c]:
                out.setdefault(p, []).append(c)
        return out

    def walks(self, start, least, most, step):
        found, level = {}, {start}
        for depth in range(1, most + 1):
            level = {n for x in level for n in step(x)}
            for n in level:
                if depth >= max(1, least) and n != start:
                    found.setdefault(n, depth)
        return found

    def merge_base(self, a, b):
        want, seen, todo = self.ancestors(a), {b}, deque([b])
        while todo:
            x = todo.popleft()
            if x in want:
                return x
            for p in self.parents[x]:
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return None

    def distance(self, a, b, inside):
        children, seen, todo = self.children(inside), {a: 0}, deque([a])
        while todo:
            x = todo.popleft()
            for n in [*self.parents[x], *children.get(x, [])]:
                if n not in seen:
                    seen[n] = seen[x] + 1
                    todo.append(n)
        return seen.get(b)


def build(spark, path, seed, n=22):
    r = random.Random(seed)
    repo, plain = Repository.init(spark, path), Plain()
    repo.set_flush_every(10**6)
    at = [repo.head()[1]]
    plain.parents[0], plain.states[0] = [], {}
    for i in range(1, n):
        parents = [] if r.random() < 0.05 else r.sample(range(i), min(i, r.choice([1, 1, 1, 1, 2, 3])))
        if r.random() < 0.5 and parents:
            parents[0] = i - 1
            parents = list(dict.fromkeys(parents))
        base = parents[0] if parents and r.random() < 0.85 else r.choice([None, r.randrange(i)])
        puts = {r.choice("abc"): str(r.randrange(4)) for _ in range(r.randrange(3))}
        at.append(repo.commit([at[p] for p in parents], None if base is None else at[base], puts, f"c{i}", timestamp=i))
        plain.parents[i], plain.states[i] = parents, {**({} if base is None else plain.states[base]), **puts}
    for k in range(3):
        repo.branches[f"b{k}"] = at[r.randrange(n)].commit_id
    return repo, plain, r


@pytest.mark.parametrize("seed", range(2))
def test_random_graph(spark, tmp_path, seed):
    repo, plain, r = build(spark, str(tmp_path / "r"), seed)
    g = repo.graph().settled()
    tips = set(repo.branches.values())
    inside = set().union(*(plain.ancestors(t) for t in tips))
    assert {x.commit_id for x in reach.within(g.commits, reach.reachable(g)).collect()} == inside
    every = state.states(g, g.commits.select(F.col("commit_id").alias("id"), "lane", "pos")).collect()
    rebuilt = {c: {} for c in plain.states}
    for x in every:
        rebuilt[x.id][x.key] = x.value
    assert rebuilt == plain.states
    keys = ["a", "b"]
    for x in state.commit_states(g, keys).collect():
        assert [x[state.column_of(k, keys)] for k in keys] == [plain.states[x.commit_id].get(k) for k in keys]
    sources = g.commits.select(F.col("commit_id").alias("src"), "lane", "pos")
    for least, most in ((1, 64), (2, 3)):
        down = {(x.src, x.dst): x.depth for x in walks.walks(g, sources, least, most, True).collect()}
        assert down == {(s, d): n for s in plain.parents for d, n in plain.walks(s, least, most, plain.parents.__getitem__).items()}
        children = plain.children(inside)
        up = {(x.src, x.dst): x.depth for x in walks.walks(g, sources, least, most, False, reach.reachable(g)).collect()}
        assert up == {(s, d): n for s in plain.parents for d, n in plain.walks(s, least, most, lambda x: children.get(x, [])).items()}
    for _ in range(3):
        a, b = r.randrange(22), r.randrange(22)
        base = paths.merge_base(g, a, b).first()
        assert (base and base.commit_id) == plain.merge_base(a, b)
        assert reach.is_ancestor(g, a, b) == (a in plain.ancestors(b))
        way = [x.commit_id for x in paths.shortest_path(g, a, b).orderBy("step").collect()]
        length = plain.distance(a, b, inside)
        assert len(way) == (0 if length is None else length + 1)
        children = plain.children(inside)
        assert all(y in plain.parents[x] or y in children.get(x, []) for x, y in zip(way, way[1:], strict=False))


def test_long_lane_in_chunks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "CHUNK", 8)
    repo = Repository.init(spark, str(tmp_path / "r"))
    repo.set_flush_every(10**6)
    tip = repo.head()[1]
    for i in range(100):
        tip = repo.commit([tip], tip, {f"k{i % 30}": str(i)}, f"c{i}")
    repo.update_branch("main", tip)
    g = repo.graph()
    last = {x.commit_id: x for x in state.commit_states(g, ["k0", "k7"]).collect()}
    for i, c in enumerate(range(1, 101)):
        expected = [str(max((j for j in range(i + 1) if j % 30 == k), default=-1)) for k in (0, 7)]
        assert [last[c][0 + 7], last[c][8]] == [None if e == "-1" else e for e in expected]
    assert [x.step for x in walks.history(g, tip.commit_id, 64).orderBy("step").collect()] == list(range(64))
    far = walks.walks(g, g.places([tip.commit_id]).withColumnRenamed("commit_id", "src"), 1, 64, True)
    assert far.count() == 64 and {r.key: r.value for r in state.replay(walks.history(g, tip.commit_id, 1000), g.ops).collect()} == {f"k{k}": str(90 + k if k < 10 else 60 + k) for k in range(30)}
