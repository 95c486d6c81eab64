import numpy as np
import pytest

from palimpsest.llm import ann


def plain(ids, vectors, at, k):
    out = []
    for i in at:
        score = np.zeros(len(vectors))
        for j in range(vectors.shape[1]):
            score += vectors[i, j] * vectors[:, j]
        out += [(ids[i], ids[o], score[o]) for o in [o for o in np.lexsort((ids, -score)) if ids[o] != ids[i]][:k]]
    return sorted(out)


@pytest.mark.parametrize("whole", [True, False])
def test_tree_is_exact_at_factor_one(monkeypatch, whole):
    monkeypatch.setattr(ann, "LEAF", 8)
    r = np.random.default_rng(0)
    for _ in range(25):
        n = int(r.integers(1, 300))
        v = r.integers(-2, 3, (n, 3)).astype(float) if whole else r.normal(size=(n, 5))
        ids = r.permutation(n * 3)[:n]
        at = r.choice(n, min(n, 7), replace=False)
        got = ann.search_shard(ids, v, ids[at], v[at], 5, 1.0)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == plain(ids, v, at, 5)


def test_table_recall_and_exactness(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    truth = plain(ids, v, np.flatnonzero(ids % 20 == 0), 20)
    got = ann.nearest(table, "vec_id % 20 = 0", shard=128, queries=10)
    assert sorted((r.query_id, r.vec_id, r.score) for r in got.collect()) == truth
    assert got.filter("rank between 1 and 20").count() == len(truth)
    relaxed = ann.nearest(table, "vec_id % 20 = 0", factor=1.3)
    assert ann.recall(relaxed, spark.createDataFrame([(int(a), int(b)) for a, b, _ in truth], "query_id long, vec_id long")) >= 0.9


def test_odd_vectors(spark):
    same = [(i, [1.0, 2.0]) for i in range(30)]
    rows = [*same, (100, None), (101, []), (102, [0.0, 0.0]), (103, [1.0, None]), (104, [float("nan"), 1.0]), (105, [float("inf"), 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0, 3.0]), (140, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' AS score", "1 AS rank", "2 AS shard")
    got = ann.nearest(df, "vec_id % 20 = 0").collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert by == {0: [140, *range(1, 20)], 20: [140, *range(19)], 140: list(range(20))}
    assert ann.nearest(df.limit(0), "true").count() == 0


@pytest.mark.parametrize("scale", [1e3, 1e4, 1e6, 1e8, 1e150])
def test_one_large_norm_leaves_the_order_of_the_others(scale):
    r = np.random.default_rng(5)
    v = r.normal(size=(1500, 16))
    v /= np.sqrt((v**2).sum(axis=1))[:, None]
    v[700] *= scale
    ids, at = r.permutation(1500), np.arange(0, 1500, 50)
    got = ann.search_shard(ids, v, ids[at], v[at], 20, 1.0)
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == plain(ids, v, at, 20)


@pytest.mark.parametrize("size", [1e160, 1e-170, 1e-320])
def test_components_near_the_ends_of_the_range(size):
    r = np.random.default_rng(6)
    v = r.normal(size=(600, 8)) * np.where(r.random((600, 1)) < 0.5, size, 1.0)
    v = v[(v != 0).any(axis=1)]
    ids, at = r.permutation(len(v)), np.arange(0, len(v), 50)
    got = ann.search_shard(ids, v, ids[at], v[at], 20, 1.0)
    small, power = ann.scaled(v)
    assert (np.abs(small).max(axis=1) >= 0.5).all() and (np.abs(small).max(axis=1) < 1).all()
    expected = []
    for i in at:
        with np.errstate(over="ignore", under="ignore"):
            score = np.ldexp(sum(small[i, j] * small[:, j] for j in range(8)), power[i] + power)
        expected += [(ids[i], ids[o], score[o]) for o in [o for o in np.lexsort((ids, -score)) if ids[o] != ids[i]][:20]]
    assert sorted(zip(*(x.tolist() for x in got), strict=True)) == sorted(expected)


def test_shards_against_plain_search(spark, monkeypatch):
    r = np.random.default_rng(7)
    centres = r.normal(size=(12, 6)) * 3
    v = np.concatenate([centres[i % 12] + r.normal(size=(1, 6)) * 0.3 for i in range(600)])
    v[::9] *= 40.0
    v[::50] *= 1e5
    v[100:180] = v[100]  # one vector many times
    ids = r.permutation(3000)[:600]
    df = spark.createDataFrame([(int(i), [float(c) for c in x]) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>")
    got = ann.nearest(df, "vec_id % 20 = 0", k=5, shard=40, queries=3).collect()
    assert sorted((x.query_id, x.vec_id, x.score) for x in got) == plain(ids, v, np.flatnonzero(ids % 20 == 0), 5)
    relaxed = ann.nearest(df, "vec_id % 20 = 0", k=5, shard=40, factor=1.5)
    assert ann.recall(relaxed, spark.createDataFrame([(x.query_id, x.vec_id) for x in got], "query_id long, vec_id long")) >= 0.9


def test_bounds_hold_for_every_row():
    r = np.random.default_rng(8)
    units = ann.directions(r.normal(size=(400, 5)))[0]
    tree = ann.build(units[:200], 10)
    leaves = ann.numbered(tree)
    leaf, least = ann.leaf_of(tree, units), ann.least_distances(tree, leaves, units)
    away = np.sqrt(((units[:, None] - units[None]) ** 2).sum(axis=2))
    assert leaves > 10 and (least[:, leaf] <= away + 1e-12).all()


def test_sql_gives_the_same_rows(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet'")
    got = ann.nearest(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "vec_id % 20 = 0", shard=100).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(ann.SQL).fetchall())
