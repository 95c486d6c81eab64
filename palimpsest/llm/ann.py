"""Nearest neighbours by largest inner product, with vantage-point trees.

1. Equal vectors are one point with its smallest ids.
2. Rows are dealt to shards by direction and length: a vantage-point tree over the directions of at most
   ``SAMPLE`` vectors (those of smallest id hash) tells the leaf, the power of two above the norm the
   class.  A shard of more than ``SHARD`` rows is split by id hash, so none outgrows a task.
3. Each query first searches the shards of largest bound.  Its k-th best score there then rules out all
   shards whose bound, by the triangle inequality along the tree and the class's norm, lies below it.
4. In a shard vectors get one more component that makes all norms equal; nearest by Euclidean distance
   is then largest by inner product for every query.  The shard's own tree splits at the median distance
   to a vantage point.  A query first descends to its own side; the other is skipped if the triangle
   inequality says that its distance there, times ``factor``, exceeds the k-th best so far.

Factor one is exact; larger factors skip more, shards and sides alike.  Only the deal is fitted on a
sample: every row is indexed.  Vectors are scaled by powers of two, which changes no digit, so that
norms and products neither overflow nor vanish; the score is the sum of products in order of components,
in double precision, and leaves are ranked by it alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.scratch import cut, map_arrow, ship

K, SHARD, QUERIES, LEAF, SAMPLE = 20, 8192, 8192, 128, 4096
#: Relative slack of comparisons, so that rounding never skips an equal neighbour.
SLACK = 1e-10
#: Scores of such powers of two neither overflow nor lose digits; beyond them nothing is skipped.
SAFE = 900
#: Norms of a class over its power of two; norms near a power of two, such as one, are of one class.
SHORT, LONG = np.sqrt(0.125) * (1 - SLACK), np.sqrt(0.5) * (1 + SLACK)


@dataclass
class Node:
    """Inner nodes have a vantage point, the median distance and two sides; leaves have points or a number."""

    points: np.ndarray | None = None
    vantage: np.ndarray | None = None
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    number: int = 0


def build(points: np.ndarray, least: int = LEAF, rows: np.ndarray | None = None) -> Node:
    """Tree over the rows of an array of points, with leaves of at most ``least``."""
    rows = np.arange(len(points)) if rows is None else rows
    if len(rows) <= least:
        return Node(points=rows)
    centre = points[rows].mean(axis=0)
    vantage = points[int(rows[((points[rows] - centre) ** 2).sum(axis=1).argmax()])]
    distance = np.sqrt(((points[rows] - vantage) ** 2).sum(axis=1))
    order = np.argsort(distance, kind="stable")
    half = len(rows) // 2
    radius = float(distance[order[half]])
    if distance[order[0]] == distance[order[-1]]:  # all equally far: nothing to split by
        return Node(points=rows)
    return Node(None, vantage, radius, build(points, least, rows[order[:half]]), build(points, least, rows[order[half:]]))


def numbered(node: Node, at: int = 0) -> int:
    """Numbers the leaves from ``at`` on, drops their points and returns the next number."""
    if node.vantage is None:
        node.points, node.number = None, at
        return at + 1
    return numbered(node.outside, numbered(node.inside, at))  # type: ignore[arg-type]


def leaf_of(node: Node, units: np.ndarray) -> np.ndarray:
    """The leaf that each direction falls into."""
    out = np.zeros(len(units), np.int64)
    todo = [(node, np.arange(len(units)))]
    while todo:
        at, who = todo.pop()
        if at.vantage is None:
            out[who] = at.number
            continue
        near = np.sqrt(((units[who] - at.vantage) ** 2).sum(axis=1)) < at.radius
        todo += [(at.inside, who[near]), (at.outside, who[~near])]  # type: ignore[list-item]
    return out


def least_distances(node: Node, leaves: int, units: np.ndarray) -> np.ndarray:
    """For each direction and leaf, a distance that no direction of the leaf comes below."""
    out = np.zeros((len(units), leaves))
    todo = [(node, np.zeros(len(units)))]
    while todo:
        at, least = todo.pop()
        if at.vantage is None:
            out[:, at.number] = least
            continue
        away = np.sqrt(((units - at.vantage) ** 2).sum(axis=1))
        todo += [(at.inside, np.maximum(least, away - at.radius)), (at.outside, np.maximum(least, at.radius - away))]  # type: ignore[list-item]
    return out


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with a largest component from 0.5 to 1, and the powers of two that were taken out."""
    power = np.frexp(np.abs(vectors).max(axis=1, initial=0))[1].astype(np.int64)
    half = power // 2  # in two steps: 2 ** -power itself may overflow
    return np.ldexp(np.ldexp(vectors, -half[:, None]), -(power - half)[:, None]), power


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and the class of each vector: its norm over 2 ** class lies between ``SHORT`` and ``LONG``."""
    small, power = scaled(vectors)
    norm = np.sqrt((small**2).sum(axis=1))
    return small / np.where(norm > 0, norm, 1)[:, None], power + np.frexp(norm * np.sqrt(0.5))[1] + 1


class Search:
    """Searches one tree of a shard for many queries at once; keeps each query's k best (score, row).

    ``points`` are the shard's vectors over 2 ** ``grade``; each query comes as its scaled vector and
    power.  Rows that score below ``floor`` need not be found.
    """

    def __init__(self, points: np.ndarray, grade: int, names: np.ndarray, queries: np.ndarray, powers: np.ndarray, floor: np.ndarray, k: int, factor: float):
        self.flat, self.names, self.queries, self.powers, self.floor, self.factor = points, names, queries, powers + grade, floor, factor
        self.best = np.full((len(queries), k), -np.inf)
        self.rows = np.full((len(queries), k), -1, np.int64)
        self.lengths = np.sqrt((points**2).sum(axis=1))
        self.most = self.lengths.max()
        self.lifted = np.concatenate([points / self.most, np.sqrt(np.maximum(1 - (self.lengths / self.most) ** 2, 0))[:, None]], axis=1)
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.units = np.concatenate([queries / self.norms[:, None], np.zeros((len(queries), 1))], axis=1)
        self.safe = np.abs(self.powers) < SAFE

    def _limit(self, who: np.ndarray) -> np.ndarray:
        """The inner product of query and point, both scaled, that a row has to reach."""
        least = np.maximum(self.best[who, -1], self.floor[who])
        known = self.safe[who] & np.isfinite(least)
        return np.where(known, np.ldexp(np.where(known, least, 0.0), -np.where(known, self.powers[who], 0)), -np.inf)

    def visit(self, node: Node, who: np.ndarray) -> None:
        if not len(who):
            return
        if node.points is not None:
            self._scan(node.points, who)
            return
        away = np.sqrt(((self.units[who] - node.vantage) ** 2).sum(axis=1))
        near = away < node.radius
        self.visit(node.inside, who[near])  # type: ignore[arg-type]
        self.visit(node.outside, who[~near])  # type: ignore[arg-type]
        # unit query and lifted point have norm one: squared distance 2 - 2 * score
        reach = np.sqrt(np.maximum(2 - 2 * self._limit(who) / (self.norms[who] * self.most) + 2 * SLACK, 0)) * (1 + SLACK)
        cross = self.factor * np.abs(away - node.radius) <= reach
        self.visit(node.outside, who[near & cross])  # type: ignore[arg-type]
        self.visit(node.inside, who[~near & cross])  # type: ignore[arg-type]

    def _scan(self, rows: np.ndarray, who: np.ndarray) -> None:
        for at in range(0, len(who), 1024):
            part = who[at : at + 1024]
            # a fast product leaves out pairs that can't be among the best; the order is that of the exact scores
            bound = self.queries[part] @ self.flat[rows].T + SLACK * self.norms[part][:, None] * self.lengths[rows][None, :]
            near = bound >= self._limit(part)[:, None]
            some = near.any(axis=1)
            part, near = part[some], near[some]
            if not len(part):
                continue
            who_at, row_at = np.nonzero(near)
            exact = np.zeros(len(who_at))
            for j in range(self.flat.shape[1]):
                exact += self.queries[part[who_at], j] * self.flat[rows[row_at], j]
            score = np.full(near.shape, -np.inf)
            score[who_at, row_at] = np.ldexp(exact, self.powers[part[who_at]])
            both = np.concatenate([self.best[part], score], axis=1)
            names = np.concatenate([self.rows[part], np.where(near, rows[None, :], -1)], axis=1)
            k = self.best.shape[1]
            order = np.lexsort((self.names[names], -both), axis=1)[:, :k]
            self.best[part], self.rows[part] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)


def search_shard(
    ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score) of the k best of a shard for each query, its own id left out."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    unique, inverse = np.unique(vectors, axis=0, return_inverse=True)
    inverse = inverse.reshape(-1)
    grade = int(directions(unique)[1].max())
    half = grade // 2
    points = np.ldexp(np.ldexp(unique, -half), -(grade - half))
    by_vector = np.argsort(inverse, kind="stable")
    heads = np.searchsorted(inverse[by_vector], np.arange(len(unique) + 1))
    asked, powers = scaled(queries)
    floor = np.full(len(queries), -np.inf) if floor is None else floor
    with np.errstate(over="ignore", under="ignore"):
        search = Search(points, grade, ids[by_vector[heads[:-1]]], asked, powers, floor, k + 1, factor)
        search.visit(build(search.lifted), np.arange(len(queries)))
    # each found vector stands for its k + 1 smallest ids: one of them may be the query's own
    who, column = np.nonzero(search.rows >= 0)
    found, score = search.rows[who, column], search.best[who, column]
    number = np.minimum(np.diff(heads)[found], k + 1)
    place = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    names = ids[by_vector[np.repeat(heads[found], number) + place]]
    who, score = np.repeat(who, number), np.repeat(score, number)
    other = names != query_ids[who]
    who, names, score = who[other], names[other], score[other]
    order = np.lexsort((names, -score, who))
    who, names, score = who[order], names[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    keep = rank < k
    return query_ids[who[keep]], names[keep], score[keep]


RESULT = "query_id long, vec_id long, score double"


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length as one array, from the column's buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _search_group(table: pa.Table, k: int, factor: float) -> pa.Table:
    table = table.combine_chunks()
    is_query = table.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
    got = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if is_query.any() and not is_query.all():
        vectors, ids = _vectors(table.column("vector")), table.column("vec_id").to_numpy()
        floor = table.column("floor").to_numpy()[is_query]
        got = list(search_shard(ids[~is_query], vectors[~is_query], ids[is_query], vectors[is_query], k, factor, floor))
    return pa.table([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])


class Deal:
    """The deal of vectors to shards: a tree for each length of vectors, and the rows of each shard."""

    def __init__(self, sample: list[np.ndarray], parts: int):
        self.trees: dict[int, tuple[Node, int]] = {}
        self.shards: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for width in {len(v) for v in sample}:
            units = directions(np.array([v for v in sample if len(v) == width]))[0]
            tree = build(units, max(1, -(-len(units) // parts)))
            self.trees[width] = tree, numbered(tree)

    def tree(self, width: int) -> tuple[Node, int]:
        return self.trees.get(width, (Node(), 1))

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their length, leaf and class."""
        for batch in batches:
            widths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False).astype(np.int64)
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                units, grade = directions(_vectors(part.column("vector")))
                columns = [np.full(len(units), width, np.int64), leaf_of(self.tree(width)[0], units), grade.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, columns)], [*part.schema.names, "width", "leaf", "grade"])

    def know(self, rows: list[tuple[int, int, int, int]]) -> None:
        """Notes (width, leaf, grade, count) of the shards."""
        for width in {r[0] for r in rows}:
            self.shards[width] = tuple(np.array([r[i] for r in rows if r[0] == width]) for i in (1, 2, 3))  # type: ignore[assignment]

    def asked(self, batches: Iterator[pa.RecordBatch], k: int, factor: float, first: bool) -> Iterator[pa.RecordBatch]:
        """Queries with the shards to search: at first those of largest bound with over k rows, later the others that reach ``floor``."""
        for batch in batches:
            widths = pc.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False).astype(np.int64)
            for width in np.unique(widths).tolist():
                part = batch.filter(pa.array(widths == width))
                small, power = scaled(_vectors(part.column("vector")))
                norm = np.sqrt((small**2).sum(axis=1))
                leaf, grade, count = self.shards[width]
                least = np.minimum(factor * least_distances(*self.tree(width), small / norm[:, None])[:, leaf], 2.0)
                cosine = np.minimum(1 - least**2 / 2 + SLACK, 1.0) * norm[:, None]
                with np.errstate(over="ignore", under="ignore"):
                    # a negative cosine weighs least with the shortest vectors of the class
                    bound = np.nextafter(np.ldexp(cosine * np.where(cosine < 0, SHORT, LONG), power[:, None] + grade), np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")
                before = np.cumsum(count[order], axis=1) - count[order]
                near = np.zeros(bound.shape, bool)
                np.put_along_axis(near, order, before <= k, axis=1)
                if first:
                    who, where = np.nonzero(near)
                else:
                    floor = part.column("floor").to_numpy()
                    who, where = np.nonzero(~near & ((bound >= floor[:, None]) | np.isinf(floor)[:, None]))
                rows = part.take(pa.array(who))
                columns = [np.full(len(who), width, np.int64), leaf[where], grade[where]]
                yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x.astype(np.int64)) for x in columns)], [*rows.schema.names, "width", "leaf", "grade"])


_SHARD = ("width", "leaf", "grade")


def nearest(
    embeddings: DataFrame, is_query: str, k: int = K, factor: float = 1.0, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, queries: int = QUERIES
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product with each query row.

    ``is_query`` is an SQL condition on the table.  A query's own id is no candidate; ties go to the
    smaller id; with fewer candidates all are returned.  Null or zero vectors, and those with a null,
    NaN or infinite component, take no part, nor do rows without id; vectors meet those of their own
    length only.  Rows of one id are all candidates; of several query rows of one
    id the least vector asks.  A score beyond the range of doubles is infinite.
    Other columns take no part; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    values = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    rows = embeddings.select(F.col(f"`{key}`").cast("long").alias("vec_id"), values.alias("vector"), F.coalesce(F.expr(is_query), F.lit(False)).alias("is_query"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    asked = rows.filter("is_query").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    # of equal vectors no query needs more than the k + 1 smallest ids
    alike = Window.partitionBy("vector").orderBy("vec_id")
    points = rows.select("vec_id", "vector").withColumn("n", F.row_number().over(alike)).filter(F.col("n") <= k + 1).drop("n")
    n = rows.count()
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect() if n > shard else []
    deal = Deal([np.array(r["vector"]) for r in sample], max(1, -(-n // shard)))
    fields = "vec_id long, vector array<double>"
    ship(spark)
    placed = cut(map_arrow(points, deal.place, f"{fields}, width long, leaf long, grade long"))
    # as many rows as the tree has leaves, times the classes of norms
    sizes = placed.groupBy(*_SHARD).agg(F.count("*").alias("n")).collect()
    deal.know([tuple(r) for r in sizes])
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = F.create_map(*(F.lit(x) for r in sizes if r["n"] > shard for x in (f"{r['width']}|{r['leaf']}|{r['grade']}", -(-r["n"] // shard)))) if any(r["n"] > shard for r in sizes) else None
    split = F.lit(1) if parts is None else F.coalesce(F.try_element_at(parts, F.concat_ws("|", *_SHARD)), F.lit(1))
    held = placed.withColumns({"part": F.pmod(F.xxhash64("vec_id"), split).cast("int"), "is_query": F.lit(False), "floor": F.lit(0.0)})

    def searched(asking: DataFrame, first: bool) -> DataFrame:
        where = map_arrow(asking, lambda it: deal.asked(it, k, factor, first), f"{fields}, floor double, width long, leaf long, grade long")
        where = where.withColumns({"part": F.explode(F.sequence(F.lit(0), split - 1)), "is_query": F.lit(True)})
        # blocks of about ``queries``: known only after the deal, so counted for each shard
        where = cut(where)
        blocks = where.groupBy(*_SHARD, "part").agg(F.ceil(F.count("*") / queries).cast("int").alias("blocks"))
        where = where.join(blocks, [*_SHARD, "part"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
        copies = held.join(blocks, [*_SHARD, "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return cut(copies.unionByName(where).groupBy(*_SHARD, "part", "block").applyInArrow(lambda t: _search_group(t, k, factor), RESULT))

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    found = searched(asked.withColumn("floor", F.lit(float("-inf"))), True)
    if len(sizes) > 1:
        reached = ranked(found).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        again = asked.join(reached, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = found.unionByName(searched(again, False))
    return ranked(found).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours that were found."""
    hit = truth.join(found, ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, truth.count())


#: The result of ``nearest`` over embeddings, for DuckDB: products summed in order of components.
SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), s AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), m AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM s q JOIN s c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM m
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
