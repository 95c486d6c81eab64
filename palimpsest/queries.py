"""Registered queries over the ingested graphs, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import shared
from palimpsest.engine import Engine, QueryResult
from palimpsest.language.parser import parse
from palimpsest.language.syntax import Query, Target
from palimpsest.operators import index, paths, reach, state, walks
from palimpsest.operators.graph import Graph
from palimpsest.plans.compiler import compile_query, resolve, resolve_hash
from palimpsest.sources import ingest, schema
from palimpsest.sources.repository import Repository

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLES: dict[str, str] = {}

# The graphs as SQL: commits(id, hash, ts, message, chain, pos), edges(child, parent, ordinal),
# ops(id, chain, pos, key, value, seq), refs(name, id), and state(id, event_type, value): what a commit sees.
EVENTS = """
WITH RECURSIVE chained AS (
  SELECT event_id + 1 AS id, user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, sha256('ev|' || event_id) AS hash,
    epoch_us(ts) // 1000 AS ts, 'event ' || event_id AS message, event_type, event_id, value::DECIMAL(18,2)::VARCHAR AS value, json_extract_string(props, '$.k') AS k
  FROM events
), commits AS (
  SELECT id, hash, ts, message, chain, pos FROM chained UNION ALL SELECT 0, sha256('genesis'), 0, 'genesis', -1, 0
), edges AS (
  SELECT id AS child, coalesce(lag(id) OVER (PARTITION BY chain ORDER BY pos), 0) AS parent, 0 AS ordinal FROM chained
), ops AS (
  SELECT id, chain, pos, u.key, u.value FROM chained, LATERAL (
    VALUES ('event_type', event_type), ('value', value), ('props.k', k), ('last.' || event_type, event_id::VARCHAR)) AS u(key, value)
), refs AS (
  SELECT 'u' || chain AS name, max_by(id, pos) AS id FROM chained GROUP BY chain UNION ALL SELECT 'main', 0
), state AS (
  SELECT c.id, c.chain, c.pos, c.hash, c.ts, c.message, s.event_type, s.value FROM commits c LEFT JOIN chained s ON s.id = c.id
)"""
MERGED = EVENTS.replace("SELECT 0, sha256('genesis'), 0, 'genesis', -1, 0\n", """SELECT 0, sha256('genesis'), 0, 'genesis', -1, 0
  UNION ALL SELECT DISTINCT 1000000000000 + chain % 5, sha256('merge|' || (chain % 5)), 0, 'merge ' || (chain % 5), -2, 0 FROM chained
  UNION ALL SELECT 1000000000005, sha256('merge|top'), 0, 'merge top', -2, 0
""").replace("0 AS ordinal FROM chained\n", """0 AS ordinal FROM chained
  UNION ALL SELECT 1000000000000 + chain % 5, max_by(id, pos), row_number() OVER (PARTITION BY chain % 5 ORDER BY chain) - 1 FROM chained GROUP BY chain
  UNION ALL SELECT 1000000000005, m, row_number() OVER (ORDER BY m) - 1 FROM (SELECT DISTINCT 1000000000000 + chain % 5 AS m FROM chained)
""").replace("SELECT 'main', 0", "SELECT 'main', 1000000000005")  # fmt: skip


def register(name: str, oracle: str | None = None) -> Callable[[Run], Run]:
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def language(name: str, source: str, oracle: str, merged: bool = False) -> None:
    """Registers a query of the language over the events graph."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        query = parse(source)
        assert isinstance(query, Query)
        return compile_query((ingest.merged_events if merged else ingest.events)(spark, sf_dir).settled(), query)

    register(name, (MERGED if merged else EVENTS) + oracle)(run)


# anchors and projection
language("match_where_state", 'MATCH (c:Commit) WHERE c.event_type = "purchase" SELECT c.hash, c.message', "SELECT hash, message FROM state WHERE event_type = 'purchase'")
language("match_project_alias", "MATCH (c) SELECT c AS commit_hash, c.timestamp AS at, c.value, 7 AS seven, c.nothing", "SELECT hash AS commit_hash, ts AS at, value, 7::BIGINT AS seven, NULL::VARCHAR AS nothing FROM state")
language("match_default_columns", "MATCH (a)-[:PARENT]->(b)", "SELECT p.hash AS a, q.hash AS b FROM edges JOIN commits p ON p.id = child JOIN commits q ON q.id = parent")
language("use_branch_summary", "USE BRANCH u3", "SELECT c.hash, message, ts AS timestamp FROM refs JOIN commits c USING (id) WHERE name = 'u3'")
language("use_select", "USE BRANCH u3 SELECT _.event_type, _.timestamp AS at", "SELECT event_type, ts AS at FROM refs JOIN state USING (id) WHERE name = 'u3'")

# predicates
language("where_eq_prefix", 'MATCH (c) WHERE c.message = "EVENT 12" SELECT c.message', "SELECT message FROM commits WHERE lower(message) LIKE 'event 12%' OR (length(message) >= 6 AND starts_with('event 12', lower(message)))")
language("where_neq_missing", 'MATCH (c) WHERE c.event_type != "view" SELECT c.hash', "SELECT hash FROM state WHERE event_type IS DISTINCT FROM 'view'")
language("where_null", "MATCH (c) WHERE c.event_type = null SELECT c.message", "SELECT message FROM state WHERE event_type IS NULL")
language("where_int_text", 'MATCH (c) WHERE c.timestamp = "0" OR c.value = 12 SELECT c.message', "SELECT message FROM state WHERE ts = 0 OR (regexp_full_match(value, '[+-]?[0-9]+') AND TRY_CAST(value AS BIGINT) = 12)")
language("where_float_text", "MATCH (c) WHERE c.value = 1.5 SELECT c.message", "SELECT message FROM state WHERE false")
language("where_and_or", 'MATCH (c) WHERE (c.event_type = "view" OR c.event_type = "click") AND c.message != "event 3" SELECT c.message', "SELECT message FROM state WHERE event_type IN ('view', 'click') AND message NOT LIKE 'event 3%'")
language("where_truthiness", "MATCH (c) WHERE c.event_type AND c.timestamp SELECT c.message", "SELECT message FROM state WHERE event_type <> '' AND ts <> 0")
language("where_nested_null", "MATCH (c) WHERE c.props.k = null SELECT c.hash", "SELECT hash FROM commits")
language("node_props_strict", 'MATCH (c {event_type: "signup", message: "event 7"}) SELECT c.hash', "SELECT hash FROM state WHERE event_type = 'signup' AND message = 'event 7'")
language("node_props_missing", "MATCH (c {event_type: null}) SELECT c.hash", "SELECT hash FROM state WHERE event_type IS NULL")
language("node_props_timestamp", "MATCH (c {timestamp: 0}) SELECT c.message", "SELECT message FROM commits WHERE ts = 0")

# edges; hops along chains are differences of position, the genesis lies one below position 1
_CHAIN = """, up AS (
  SELECT a.id AS src, b.id AS dst, a.pos - b.pos AS hops FROM commits a JOIN commits b ON a.chain = b.chain AND b.pos < a.pos
  UNION ALL SELECT id, 0, pos FROM commits WHERE chain >= 0
)"""
_NAMES = " JOIN commits a ON a.id = src JOIN commits b ON b.id = dst"
language("edge_parent", 'MATCH (a {event_type: "view"})-[:PARENT]->(b) SELECT a.message AS child, b.message AS parent', "SELECT s.message AS child, b.message AS parent FROM edges JOIN state s ON s.id = child JOIN commits b ON b.id = parent WHERE s.event_type = 'view'")
language("edge_child", 'MATCH (a)->(b) WHERE b.event_type = "view" SELECT a.message AS parent, b.message AS child', "SELECT b.message AS parent, s.message AS child FROM edges JOIN state s ON s.id = child JOIN commits b ON b.id = parent WHERE s.event_type = 'view'")
language("edge_ancestor_default", "MATCH (a)-[:ANCESTOR]->(b {message: \"genesis\"}) SELECT a.message", _CHAIN + "SELECT a.message FROM up" + _NAMES + " WHERE hops BETWEEN 1 AND 64 AND dst = 0")
language("edge_descendant_default", "MATCH (a {message: \"genesis\"})-[:DESCENDANT]->(b) SELECT b.message", _CHAIN + "SELECT a.message FROM up" + _NAMES + " WHERE hops BETWEEN 1 AND 64 AND dst = 0")
language("hop_exact", "MATCH (a)-[:ANCESTOR*70]->(b) SELECT a.message AS a, b.message AS b", _CHAIN + "SELECT a.message AS a, b.message AS b FROM up" + _NAMES + " WHERE hops = 70")
language("hop_range", "MATCH (a)<-[:PARENT*2..4]-(b) SELECT a.message AS a, b.message AS b", _CHAIN + "SELECT a.message AS a, b.message AS b FROM up" + _NAMES + " WHERE hops BETWEEN 2 AND 4")
language("hop_open", "MATCH (a)-[:CHILD*60..]->(b) SELECT a.message AS a, b.message AS b", _CHAIN + "SELECT b.message AS a, a.message AS b FROM up" + _NAMES + " WHERE hops BETWEEN 60 AND 64")
language("hop_zero", "MATCH (a)-[:ANCESTOR*0]->(b) SELECT a, b", _CHAIN + "SELECT a.hash AS a, b.hash AS b FROM up" + _NAMES + " WHERE hops = 0")
language("chain_two_edges", 'MATCH (a {event_type: "purchase"})-[:PARENT]->(b)-[:PARENT]->(c {event_type: "view"}) SELECT a.message AS a, b.message AS b, c.message AS c', "SELECT a.message AS a, b.message AS b, c.message AS c FROM edges e JOIN edges f ON f.child = e.parent JOIN state a ON a.id = e.child JOIN commits b ON b.id = e.parent JOIN state c ON c.id = f.parent WHERE a.event_type = 'purchase' AND c.event_type = 'view'")
language("repeated_variable", "MATCH (a)-[:PARENT]->(b)-[:CHILD]->(a) SELECT a.message AS a, b.message AS b", "SELECT a.message AS a, b.message AS b FROM edges JOIN commits a ON a.id = child JOIN commits b ON b.id = parent")
language("comma_union", 'MATCH (c {event_type: "signup"}), (c {event_type: "error"}) SELECT c.message, c.event_type', "SELECT message, event_type FROM state WHERE event_type IN ('signup', 'error')")
language("anonymous_node", "MATCH ()-[:PARENT]->(b) SELECT _0.message AS a, b.message AS b", "SELECT a.message AS a, b.message AS b FROM edges JOIN commits a ON a.id = child JOIN commits b ON b.id = parent")
_WALK = """, walk AS (
  SELECT 1000000000005 AS id, 0 AS depth UNION SELECT parent, depth + 1 FROM walk JOIN edges ON child = walk.id WHERE depth < {most}
)"""
language("merge_hops", "MATCH (a {merged: \"top\"})-[:ANCESTOR*2..5]->(b) SELECT b.message", _WALK.format(most=5) + "SELECT DISTINCT message FROM walk JOIN commits USING (id) WHERE depth BETWEEN 2 AND 5", merged=True)

# traversals
language("ancestors", "TRAVERSE ANCESTORS(BRANCH u3) SELECT hash, message", "SELECT hash, message FROM commits WHERE id = 0 OR chain = 3")
language("ancestors_merged", "TRAVERSE ANCESTORS(HEAD)", _WALK.format(most=1000) + "SELECT DISTINCT hash, ts AS timestamp, message FROM walk JOIN commits USING (id)", merged=True)
language("merge_base", "TRAVERSE MERGE_BASE(BRANCH u3, BRANCH u7) SELECT hash, message", "SELECT hash, message FROM commits WHERE id = 0")
language("merge_base_asymmetric", "TRAVERSE MERGE_BASE(BRANCH u3, HEAD) SELECT message", "SELECT message FROM refs JOIN commits USING (id) WHERE name = 'u3'", merged=True)
language("shortest_path", "TRAVERSE SHORTEST_PATH(BRANCH u3, BRANCH u8) SELECT message", "SELECT message FROM commits WHERE id IN (1000000000003) UNION ALL SELECT message FROM refs JOIN commits USING (id) WHERE name IN ('u3', 'u8')", merged=True)
language("shortest_path_chain", "TRAVERSE SHORTEST_PATH(BRANCH u3, BRANCH u7) SELECT message", "SELECT message FROM commits WHERE id = 0 OR chain IN (3, 7)")


def _tip(graph: Graph, branch: str) -> int:
    return resolve(graph, Target("BRANCH", branch))


@register("within_depth", EVENTS + "SELECT hash, t.pos - c.pos AS depth FROM (SELECT pos FROM refs JOIN commits USING (id) WHERE name = 'u3') t JOIN commits c ON (c.chain = 3 OR c.id = 0) AND t.pos - c.pos BETWEEN 1 AND 20")
def within_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return walks.within_depth(g, _tip(g, "u3"), 20).join(g.commits, F.col("dst") == F.col("commit_id")).select("hash", "depth")


@register("history_64", EVENTS + "SELECT step, hash FROM (SELECT row_number() OVER (ORDER BY pos DESC) - 1 AS step, hash FROM commits WHERE chain = 3 OR id = 0) WHERE step < 64")
def history_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return walks.history(g, _tip(g, "u3"), 64).join(g.commits, "commit_id").select("step", "hash")


@register("is_ancestor", EVENTS + "SELECT n, EXISTS (SELECT 1 FROM commits WHERE chain = 3 AND id = n OR n = 0 AND id = 0) AS below FROM (SELECT id AS n FROM refs WHERE name IN ('u3', 'u7', 'main'))")
def ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    inside = reach.reach(g, g.places([_tip(g, "u3")]))
    tips = g.refs.filter(F.col("name").isin("u3", "u7", "main")).select("commit_id").join(g.commits, "commit_id")
    return tips.join(inside, "lane", "left").select(F.col("commit_id").alias("n"), F.coalesce(F.col("pos") <= F.col("top"), F.lit(False)).alias("below"))


@register("hash_prefix", EVENTS + "SELECT hash, message FROM commits WHERE hash LIKE substr(sha256('ev|5'), 1, 12) || '%'")
def hash_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    digits = spark.range(1).select(F.sha2(F.lit("ev|5"), 256).substr(1, 12)).first()[0]
    return g.commits.filter(F.col("commit_id") == resolve_hash(g, digits.upper())).select("hash", "message")


_LAST = "SELECT id, key, value, writer FROM (SELECT t.id, o.key, o.value, o.id AS writer, row_number() OVER (PARTITION BY t.id, o.key ORDER BY o.pos DESC) AS r FROM refs t JOIN commits c ON c.id = t.id JOIN ops o ON o.chain = c.chain AND o.pos <= c.pos WHERE {who}) WHERE r = 1"


@register("checkout_state", EVENTS + "SELECT key, value FROM (" + _LAST.format(who="t.name = 'u3'") + ")")
def checkout_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return state.state_at(g, _tip(g, "u3")).select("key", "value")


@register("checkout_all_tips", EVENTS + "SELECT id, key, value, writer FROM (" + _LAST.format(who="true") + ")")
def checkout_all_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return state.states(g, g.tips().withColumnRenamed("commit_id", "id")).select("id", "key", "value", F.col("commit_id").alias("writer"))


@register("point_get", EVENTS + "SELECT key, value FROM (" + _LAST.format(who="t.name = 'u3'") + ") WHERE key = 'props.k'")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return state.state_at(g, _tip(g, "u3"), ["props.k"]).select("key", "value")


@register("last_writer", EVENTS + "SELECT key, writer, sha256(key || value) AS leaf FROM (" + _LAST.format(who="t.name = 'u3'") + ")")
def last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return state.state_at(g, _tip(g, "u3")).select("key", F.col("commit_id").alias("writer"), F.sha2(F.concat("key", "value"), 256).alias("leaf"))


_DIFF = "SELECT CASE WHEN l.value IS NULL THEN '+' WHEN r.value IS NULL THEN '-' ELSE '~' END AS op, key, l.value AS left_value, r.value AS right_value FROM (" + _LAST.format(who="t.name = 'u3'") + ") l FULL JOIN (" + _LAST.format(who="t.name = 'u7'") + ") r USING (key) WHERE l.value IS DISTINCT FROM r.value"


def _diff(spark: SparkSession, sf_dir: str, path: str | None) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return state.diff(g, _tip(g, "u3"), _tip(g, "u7"), path).select("op", "key", F.col("left").alias("left_value"), F.col("right").alias("right_value"))


@register("diff_branches", EVENTS + _DIFF)
def diff_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir, None)


@register("diff_path", EVENTS + _DIFF + " AND (key = 'last' OR key LIKE 'last.%')")
def diff_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir, "last")


_SCHEMA = "COLLECTION events\nKEY event_type STRING\nKEY value STRING\nINDEX events.by_props_k PATH props.k TYPE STRING\nINDEX events.by_event_type PATH event_type TYPE STRING\n"


@register("index_entries", EVENTS + "SELECT id AS commit_id, i.index_name, i.key, event_type || chr(31) || value AS pk FROM chained, LATERAL (VALUES ('events.by_props_k', k), ('events.by_event_type', event_type)) AS i(index_name, key) WHERE i.key IS NOT NULL")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.entries(ingest.events(spark, sf_dir), schema.load(_SCHEMA))


@register("index_lookup", EVENTS + "SELECT event_type || chr(31) || value AS pk FROM chained WHERE id = (SELECT id FROM refs WHERE name = 'u3')")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    tip = _tip(g, "u3")
    key = state.state_at(g, tip, ["event_type"]).select("value").first()[0]
    return index.lookup(g, schema.load(_SCHEMA), tip, "events.by_event_type", key)


_TURNS = """
WITH t AS (SELECT *, conv_id * 1000 + turn + 1 AS id FROM conversations), commits AS (
  SELECT id, sha256('cv|' || conv_id || '|' || turn) AS hash, turn AS ts, conv_id, role, length(text)::VARCHAR AS n_chars FROM t
)"""


@register("conversation_replies", _TURNS + "SELECT b.hash AS reply, a.n_chars AS asked, b.n_chars AS answered FROM commits a JOIN commits b ON a.conv_id = b.conv_id AND b.ts = a.ts + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def conversation_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = parse('MATCH (a {role: "user"})-[:CHILD]->(b {role: "assistant"}) SELECT b AS reply, a.n_chars AS asked, b.n_chars AS answered')
    return compile_query(ingest.conversations(spark, sf_dir).settled(), query)  # type: ignore[arg-type]


@register("merge_base_paths", MERGED + "SELECT hash FROM refs JOIN commits USING (id) WHERE name = 'u8'")
def merge_base_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.merged_events(spark, sf_dir).settled()
    merge = resolve_hash(g, spark.range(1).select(F.sha2(F.lit("merge|3"), 256)).first()[0])
    return paths.merge_base(g, merge, _tip(g, "u8")).select("hash")


# statements on a repository of their own; the tables they read have a fixed number of rows


def _fresh(spark: SparkSession) -> Repository:
    return Repository.init(spark, shared.temporary(spark))


def _asked(repo: Repository, source: str) -> DataFrame:
    result = Engine(repo).execute_one(source)
    assert isinstance(result, QueryResult)
    return result.df


def _tips(repo: Repository) -> DataFrame:
    """branch, key, value of every branch's state."""
    g = repo.graph()
    found = state.states(g, g.tips().withColumnRenamed("commit_id", "id"))
    return g.refs.join(found.select("id", "key", "value"), F.col("commit_id") == F.col("id")).select(F.col("name").alias("branch"), "key", "value")


@register("commit_regions", "SELECT r_name AS name, r_regionkey::VARCHAR AS number, 'region ' || r_regionkey AS message FROM region UNION ALL SELECT NULL, NULL, 'genesis'")
def commit_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _fresh(spark)
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect()
    # a commit with all keys new; then one that keeps the key of the one before unless it is put again
    Engine(repo).execute("; ".join(f'COMMIT {{name: "{r.r_name}", number: {r.r_regionkey}}} MESSAGE "region {r.r_regionkey}"' for r in regions))
    return _asked(repo, "MATCH (c) SELECT c.name AS name, c.number AS number, c.message AS message")


@register("commit_nested", "SELECT * FROM (VALUES ('a', '1'), ('deep.flag', 'true'), ('deep.lower.text', 'x'), ('pi', '3.5')) AS t(key, value)")
def commit_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _fresh(spark)
    Engine(repo).execute('COMMIT {pi: 3.50, a: 1, deep: {flag: true, lower: {text: "x"}}}')
    return state.state_at(repo.graph(), repo.head()[1].commit_id).select("key", "value")


@register("branch_states", "SELECT * FROM (VALUES ('main', 'x', '1'), ('main', 'y', 'm'), ('side', 'x', '2'), ('side', 'z', 's')) AS t(branch, key, value)")
def branch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _fresh(spark)
    Engine(repo).execute(
        'COMMIT {x: 1} MESSAGE "both"; CREATE BRANCH side; CREATE BRANCH gone; DELETE BRANCH gone; CHECKOUT BRANCH side; COMMIT {x: 2, z: "s"} MESSAGE "s"; CHECKOUT BRANCH main; COMMIT {y: "m"} MESSAGE "m"'
    )
    return _tips(repo)


@register("merge_fast_forward", "SELECT * FROM (VALUES ('genesis'), ('one'), ('two')) AS t(message)")
def merge_fast_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _fresh(spark)
    Engine(repo).execute(
        'CREATE BRANCH ahead; CHECKOUT BRANCH ahead; COMMIT {k: "v"} MESSAGE "one"; COMMIT {k: "w"} MESSAGE "two"; CHECKOUT BRANCH main; MERGE BRANCH ahead INTO BRANCH main STRATEGY FAST_FORWARD'
    )
    return _asked(repo, "TRAVERSE ANCESTORS(BRANCH main) SELECT message")


@register("commit_base_apart", "SELECT * FROM (VALUES ('far', 'a', '1'), ('far', 'b', '3'), ('main', 'a', '1'), ('main', 'b', '2')) AS t(branch, key, value)")
def commit_base_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _fresh(spark)
    repo.set_flush_every(10)
    root = repo.head()[1]
    first = repo.commit([root], root, {"a": "1"}, "first")
    repo.update_branch("main", repo.commit([first], first, {"b": "2"}, "second"))
    # its parent is the newest commit, its state that of the first
    repo.create_branch("far", repo.commit([repo.head()[1]], first, {"b": "3"}, "state of another"))
    return _tips(repo)


@register("equal_commits", "SELECT 2::BIGINT AS commits, 1::BIGINT AS of_one_hash")
def equal_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _fresh(spark)
    root = repo.head()[1]
    for _ in range(3):
        made = repo.commit([root], root, {"a": "1"}, "same", timestamp=7)
    return repo.graph().commits.agg(F.count("*").alias("commits"), F.count_if(F.col("hash") == made.hash).alias("of_one_hash"))


@register("schema_indexes", "SELECT * FROM (VALUES ('items.by_meta_prefs_theme', 'meta.prefs.theme', 'dark', 'item-1')) AS t(index_name, path, key, pk)")
def schema_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    repo = _fresh(spark)
    repo.files.write("migrations/001.eql", "CREATE COLLECTION items KEY id STRING; CREATE INDEX ON items (id);")
    repo.files.write("migrations/002.eql", 'CREATE INDEX ON items PATH "meta.prefs.theme" TYPE STRING; DROP INDEX ON items (id);')
    repo.migrate()
    Engine(repo).execute('COMMIT {id: "item-1", meta: {prefs: {theme: "dark"}}}')
    paths = spark.createDataFrame([(i.name, i.path) for _, i in repo.schema().indexes()], "index_name string, path string")
    return index.entries(repo.graph(), repo.schema()).join(paths, "index_name").select("index_name", "path", "key", "pk")


@register("linear_replay", EVENTS + "SELECT key, value FROM (" + _LAST.format(who="t.name = 'u3'") + ")")
def linear_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ingest.events(spark, sf_dir)
    return state.replay(walks.history(g, _tip(g, "u3"), 1 << 30), g.ops)
