"""The queries of the graph engine over the star-schema tables, and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph._ship import ship
from quillgraph.model import PropertyGraph, Table
from quillgraph.operators import paths, statistics, traversal
from quillgraph.plans.languages import LANGUAGES
from quillgraph.plans.planner import build
from quillgraph.sources import change_log
from quillgraph.sources.generators import synthetic
from quillgraph.sources.star_schema import EDGE_SPAN, KEYS, LINES, SPAN, load, node_id, with_reverse

_LINES = f"select *, {4 * EDGE_SPAN} + l_orderkey * {LINES} + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as id from lineitem"
_EDGES_BY_ID = f"""
  select cast(n_nationkey as bigint) as id, {1 * SPAN} + n_nationkey as src, {0 * SPAN} + n_regionkey as dst, 1.0::double as weight from nation union all
  select {1 * EDGE_SPAN} + c_custkey, {2 * SPAN} + c_custkey, {1 * SPAN} + c_nationkey, 1.0 from customer union all
  select {2 * EDGE_SPAN} + s_suppkey, {3 * SPAN} + s_suppkey, {1 * SPAN} + s_nationkey, 1.0 from supplier union all
  select {3 * EDGE_SPAN} + o_orderkey, {2 * SPAN} + o_custkey, {5 * SPAN} + o_orderkey, o_totalprice from orders union all
  select id, {5 * SPAN} + l_orderkey, {4 * SPAN} + l_partkey, l_extendedprice from ({_LINES}) union all
  select distinct {5 * EDGE_SPAN} + l_partkey * {KEYS} + l_suppkey, {4 * SPAN} + l_partkey, {3 * SPAN} + l_suppkey, 1.0 from lineitem"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_EPS = "2.220446049250313e-16"
_FIELD = {"int": "i", "float": "d", "text": "s", "bool": "b"}

_ALL_NODES = f"""
  select {0 * SPAN} + r_regionkey as id, 'Region' as label from region union all
  select {1 * SPAN} + n_nationkey, 'Nation' from nation union all
  select {2 * SPAN} + c_custkey, 'Customer' from customer union all
  select {3 * SPAN} + s_suppkey, 'Supplier' from supplier union all
  select {4 * SPAN} + p_partkey, 'Part' from part union all
  select {5 * SPAN} + o_orderkey, 'Order' from orders"""
_ALL_EDGES = f"""
  select {1 * SPAN} + n_nationkey as src, {0 * SPAN} + n_regionkey as dst, 'IN_REGION' as label, 1.0::double as weight from nation union all
  select {2 * SPAN} + c_custkey, {1 * SPAN} + c_nationkey, 'LIVES_IN', 1.0 from customer union all
  select {3 * SPAN} + s_suppkey, {1 * SPAN} + s_nationkey, 'BASED_IN', 1.0 from supplier union all
  select {2 * SPAN} + o_custkey, {5 * SPAN} + o_orderkey, 'PLACED', o_totalprice from orders union all
  select {5 * SPAN} + l_orderkey, {4 * SPAN} + l_partkey, 'CONTAINS', l_extendedprice from lineitem union all
  select distinct {4 * SPAN} + l_partkey, {3 * SPAN} + l_suppkey, 'SUPPLIED_BY', 1.0 from lineitem"""


def _graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    ship(spark)
    return load(spark, sf_dir)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLE_SQL[name] = sql


def _run(text: str, language: str, columns: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: columns(build(_graph(spark, sf_dir), LANGUAGES[language].parse(text)))


def _plain(*names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*names)


def _with_prop(key: str, kind: str, *names: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select(*names, F.col("properties")[key][_FIELD[kind]].alias("prop"))


def _both(name: str, simple: str, cypher: str, columns: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query in each language; both must give the same."""
    _add(name, _run(simple, "simple", columns), sql)
    _add(f"cypher_{name}", _run(cypher, "cypher", columns), sql)


_CUSTOMER, _ORDER = 2 * SPAN, 5 * SPAN
_both("match_nodes_all", "MATCH NODE", "MATCH (n) RETURN n", _plain("id", "label"), f"select id, label from ({_ALL_NODES})")
_both("match_nodes_label", 'MATCH NODE WHERE label = "Customer"', "MATCH (n:Customer) RETURN n", _plain("id", "label"), f"select {_CUSTOMER} + c_custkey as id, 'Customer' as label from customer")
_both("match_nodes_missing_label", 'MATCH NODE WHERE label = "Robot"', "MATCH (n:Robot) RETURN n", _plain("id", "label"), f"select id, label from ({_ALL_NODES}) where false")

# each comparison on a property of each kind
for _op, _name in (("=", "eq"), ("!=", "neq"), ("<", "lt"), ("<=", "lteq"), (">", "gt"), (">=", "gteq")):
    for _kind, _key, _literal, _code, _table, _id in (("float", "c_acctbal", "5000.5", 2, "customer", "c_custkey"), ("int", "p_size", "25", 4, "part", "p_partkey"), ("text", "c_mktsegment", '"BUILDING"', 2, "customer", "c_custkey")):
        _lit = _literal.replace('"', "'")
        _sql = f"{_key} {_op} {_lit}" if _kind != "float" or _op not in ("=", "!=") else f"abs({_key} - {_lit}) {'<' if _op == '=' else '>='} {_EPS}"
        _both(
            f"match_nodes_{_name}_{_kind}",
            f"MATCH NODE WHERE props.{_key} {_op} {_literal}",
            f"MATCH (n) WHERE n.{_key} {_op} {_literal} RETURN n",
            _with_prop(_key, _kind, "id"),
            f"select {_code * SPAN} + {_id} as id, {_key if _kind != 'int' else f'cast({_key} as bigint)'} as prop from {_table} where {_sql}",
        )
_both(
    "match_nodes_int_as_float",
    "MATCH NODE WHERE props.p_size >= 24.5",
    "MATCH (n) WHERE n.p_size >= 24.5 RETURN n",
    _with_prop("p_size", "int", "id"),
    f"select {4 * SPAN} + p_partkey as id, cast(p_size as bigint) as prop from part where p_size >= 24.5",
)
_both("match_nodes_kinds_differ", 'MATCH NODE WHERE props.p_size != "x"', 'MATCH (n) WHERE n.p_size != "x" RETURN n', _plain("id", "label"), f"select id, label from ({_ALL_NODES}) where false")
_both(
    "match_nodes_label_and_props",
    'MATCH NODE WHERE label = "Customer" AND props.c_acctbal > 0 AND props.c_nationkey <= 10 AND props.c_mktsegment != "BUILDING"',
    'MATCH (c:Customer) WHERE c.c_acctbal > 0 AND c.c_nationkey <= 10 AND c.c_mktsegment != "BUILDING" RETURN c',
    _with_prop("c_acctbal", "float", "id", "label"),
    f"select {_CUSTOMER} + c_custkey as id, 'Customer' as label, c_acctbal as prop from customer where c_acctbal > 0 and c_nationkey <= 10 and c_mktsegment <> 'BUILDING'",
)
_both("match_nodes_missing_prop_neq", "MATCH NODE WHERE props.s_acctbal != 1", "MATCH (n) WHERE n.s_acctbal != 1 RETURN n", _plain("id"), f"select {3 * SPAN} + s_suppkey as id from supplier where abs(s_acctbal - 1) >= {_EPS}")
_edge = _plain("src", "dst", "label", "weight")
_both("match_edges_all", "MATCH EDGE", "MATCH (a)-[r]->(b) RETURN r", _edge, f"select src, dst, label, weight from ({_ALL_EDGES})")
_both("match_edges_label", 'MATCH EDGE WHERE label = "PLACED"', "MATCH (a)-[r:PLACED]->(b) RETURN r", _edge, f"select src, dst, label, weight from ({_ALL_EDGES}) where label = 'PLACED'")
_both("match_edges_weight_range", "MATCH EDGE WHERE weight > 1000 AND weight <= 50000.5", "MATCH (a)-[r]->(b) WHERE r.weight > 1000 AND r.weight <= 50000.5 RETURN a, r, b", _edge, f"select src, dst, label, weight from ({_ALL_EDGES}) where weight > 1000 and weight <= 50000.5")
_both("match_edges_label_weight", 'MATCH EDGE WHERE label = "CONTAINS" AND weight < 2000', "MATCH (a)-[r:CONTAINS]->(b) WHERE r.weight < 2000 RETURN r", _edge, f"select src, dst, label, weight from ({_ALL_EDGES}) where label = 'CONTAINS' and weight < 2000")
_both(
    "match_edges_props",
    'MATCH EDGE WHERE props.l_quantity >= 45 AND props.l_returnflag = "R"',
    'MATCH (a)-[r]->(b) WHERE r.l_quantity >= 45 AND r.l_returnflag = "R" RETURN r',
    _with_prop("l_quantity", "float", "src", "dst"),
    f"select {_ORDER} + l_orderkey as src, {4 * SPAN} + l_partkey as dst, l_quantity as prop from lineitem where l_quantity >= 45 and l_returnflag = 'R'",
)
_add("get_node", _run(f"GET NODE N{_CUSTOMER + 1}", "simple", _with_prop("c_name", "text", "id", "label")), f"select {_CUSTOMER} + c_custkey as id, 'Customer' as label, c_name as prop from customer where c_custkey = 1")
_add("get_node_missing", _run("GET NODE N999999999999999", "simple", _plain("id", "label")), f"select id, label from ({_ALL_NODES}) where false")
_add("get_edge_missing", _run("GET EDGE E999999999999999", "simple", _plain("src", "dst")), f"select src, dst from ({_ALL_EDGES}) where false")
_add("get_edge", _run("GET EDGE E0", "simple", _plain("id", "label")), "select cast(0 as bigint) as id, 'IN_REGION' as label")
_line = 4 * EDGE_SPAN + LINES + 2
_add("get_edge_of_line", _run(f"GET EDGE E{_line}", "simple", _with_prop("l_quantity", "float", "id", "src", "dst", "weight")), f"select id, {_ORDER} + l_orderkey as src, {4 * SPAN} + l_partkey as dst, l_extendedprice as weight, l_quantity as prop from ({_LINES}) where id = {_line}")
_both(
    "match_edges_eq_float",
    "MATCH EDGE WHERE props.l_discount = 0.05 AND props.l_quantity != 7.0",
    "MATCH (a)-[r]->(b) WHERE r.l_discount = 0.05 AND r.l_quantity != 7.0 RETURN r",
    _with_prop("l_discount", "float", "src", "dst"),
    f"select {_ORDER} + l_orderkey as src, {4 * SPAN} + l_partkey as dst, l_discount as prop from lineitem where abs(l_discount - 0.05) < {_EPS} and abs(l_quantity - 7.0) >= {_EPS}",
)
_both("count_nodes", "COUNT NODES", "COUNT NODES", _plain("count"), f"select count(*) as count from ({_ALL_NODES})")
_both("count_edges", "COUNT EDGES", "COUNT EDGES", _plain("count"), f"select count(*) as count from ({_ALL_EDGES})")


def _on(function: Callable[..., DataFrame], *args) -> Query:
    return lambda spark, sf_dir: function(_graph(spark, sf_dir), *args)


_add("label_stats", _on(statistics.label_stats), f"select label, count(*) as n from ({_ALL_NODES}) group by label")
_add("label_count", _on(statistics.label_count, "Order"), "select count(*) as n from orders")
_add("node_ids_by_label", _on(statistics.node_ids_by_label, "Part"), f"select {4 * SPAN} + p_partkey as id from part")
_add("distinct_labels", _on(statistics.all_labels), f"select distinct label from ({_ALL_NODES})")
_add(
    "property_keys",
    _on(statistics.property_keys),
    "select column_name as key from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders') and column_name <> 'o_orderdate' group by column_name",
)
_add("field_cardinality", _on(statistics.field_cardinality, "p_size"), "select 'p_size' as key, count(distinct p_size) as n from part")
_add("neighbors_out", _on(statistics.neighbors_out, _CUSTOMER + 1), f"select dst as node_id, id as edge_id, weight from ({_EDGES_BY_ID}) where src = {_CUSTOMER + 1}")
_add("neighbors_in", _on(statistics.neighbors_in, SPAN + 3), f"select src as node_id, id as edge_id, weight from ({_EDGES_BY_ID}) where dst = {SPAN + 3}")
_add("out_degree", _on(statistics.out_degree), f"select src as node_id, count(*) as n from ({_ALL_EDGES}) group by src")
_add("in_degree", _on(statistics.in_degree), f"select dst as node_id, count(*) as n from ({_ALL_EDGES}) group by dst")
_add("all_node_ids", _on(statistics.all_node_ids), f"select id from ({_ALL_NODES})")
_add("all_edge_ids", _on(statistics.all_edge_ids), f"select id from ({_EDGES_BY_ID})")
_add("contains_node", _on(statistics.contains_node, _CUSTOMER + 1), f"select count(*) > 0 as found from ({_ALL_NODES}) where id = {_CUSTOMER + 1}")
_add("orphan_nodes", _on(statistics.orphan_nodes), f"with e as ({_ALL_EDGES}) select id from ({_ALL_NODES}) n where id not in (select src from e) and id not in (select dst from e)")



def _of_regions(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph with its first edge table only, so that many nodes have no edges."""
    g = _graph(spark, sf_dir)
    return PropertyGraph(spark, g.node_tables, g.edge_tables[:1])


_add("orphan_nodes_of_regions", lambda s, d: statistics.orphan_nodes(_of_regions(s, d)), f"select id from ({_ALL_NODES}) where label not in ('Nation', 'Region') or (label = 'Nation' and id - {SPAN} not in (select n_nationkey from nation)) or (label = 'Region' and id not in (select n_regionkey from nation))")
_add(
    "label_stats_order",
    lambda s, d: s.createDataFrame([(k, r.label, r.n) for k, r in enumerate(statistics.label_stats(_graph(s, d)).collect())], "pos long, label string, n long"),  # one row a label
    f"select row_number() over (order by n desc, label) - 1 as pos, label, n from (select label, count(*) as n from ({_ALL_NODES}) group by label)",
)
_add("property_keys_order", lambda s, d: s.createDataFrame([(k, r.key) for k, r in enumerate(statistics.property_keys(_graph(s, d)).collect())], "pos long, key string"), "select row_number() over (order by key) - 1 as pos, key from (select distinct column_name as key from information_schema.columns where table_name in ('region', 'nation', 'customer', 'supplier', 'part', 'orders') and column_name <> 'o_orderdate')")

_WALK = f"""with recursive e as ({_ALL_EDGES}),
  walk(node_id, level) as (select id, 0 from ({_ALL_NODES}) where id = {_CUSTOMER + 1} union select e.dst, walk.level + 1 from walk join e on e.src = walk.node_id)"""
_add("bfs_levels", _on(traversal.bfs_levels, _CUSTOMER + 1), f"{_WALK} select node_id, min(level) as level from walk group by node_id")
_both("bfs_reachable", f"TRAVERSE BFS FROM N{_CUSTOMER + 1}", f"TRAVERSE BFS FROM N{_CUSTOMER + 1}", _plain("node_id"), f"{_WALK} select distinct node_id from walk")
_both("dfs_reachable", f"TRAVERSE DFS FROM N{_CUSTOMER + 1}", f"TRAVERSE DFS FROM N{_CUSTOMER + 1}", _plain("node_id"), f"{_WALK} select distinct node_id from walk")
_BOTH_WAYS = f"""with recursive e as (select distinct src, dst from ({_ALL_EDGES}) union select distinct dst, src from ({_ALL_EDGES})),
  walk(node_id, level) using key (node_id) as (select id, 0 from ({_ALL_NODES}) where id = {_CUSTOMER + 1} union
    select e.dst, min(walk.level) + 1 from walk join e on e.src = walk.node_id left join recurring.walk r on r.node_id = e.dst where r.node_id is null group by e.dst)"""
_add("bfs_levels_cyclic", lambda s, d: traversal.bfs_levels(with_reverse(_graph(s, d)), _CUSTOMER + 1), f"{_BOTH_WAYS} select node_id, level from walk")
_ROUTES = f"""with recursive e as ({_ALL_EDGES}),
  route(node_id, dist) as (select id, cast(0 as double) from ({_ALL_NODES}) where id = {_CUSTOMER + 1} union all select e.dst, route.dist + e.weight from route join e on e.src = route.node_id)"""
_add("shortest_distances", lambda s, d: paths.distances(_graph(s, d), _CUSTOMER + 1).select("node_id", "dist"), f"{_ROUTES} select node_id, min(dist) as dist from route group by node_id")
_add("shortest_distance", lambda s, d: build(_graph(s, d), LANGUAGES["simple"].parse(f"PATH FROM N{_CUSTOMER + 1} TO N1")).orderBy(F.desc("pos")).limit(1).select("node_id", "dist"), f"{_ROUTES} select node_id, min(dist) as dist from route where node_id = 1 group by node_id")
_both("shortest_path_missing", f"PATH FROM N{_CUSTOMER + 1} TO N999999999999999", f"PATH FROM N{_CUSTOMER + 1} TO N999999999999999", _plain("node_id"), f"select id as node_id from ({_ALL_NODES}) where false")
# back from the goal, by the predecessor with the smallest (distance, id)
_PATH = f"""{_ROUTES}, d as (select node_id, min(dist) as dist from route group by node_id),
  p as (select e.dst as node_id, e.src as pred, row_number() over (partition by e.dst order by u.dist, e.src) as k
        from ({_ALL_EDGES}) e join d u on u.node_id = e.src join d v on v.node_id = e.dst where u.dist + e.weight = v.dist),
  back(node_id, steps) as (select node_id, 0 from d where node_id = 1 union all select p.pred, back.steps + 1 from back join p on p.node_id = back.node_id and p.k = 1)
select cast((select max(steps) from back) - steps as int) as pos, back.node_id, d.dist from back join d using (node_id)"""
_both("shortest_path_nodes", f"PATH FROM N{_CUSTOMER + 1} TO N1", f"PATH FROM N{_CUSTOMER + 1} TO N1", _plain("pos", "node_id", "dist"), _PATH)
# in a graph without cycles a node is discovered by the smallest path: breadth first, of the shortest by edge ids; depth first, of
# all, the last edge first, a path before those that go on from it
_PATHS = f"""with recursive e as ({_EDGES_BY_ID}),
  route(node_id, level, way) as (select id, 0, []::bigint[] from ({_ALL_NODES}) where id = {_CUSTOMER + 1} union all select e.dst, route.level + 1, list_append(route.way, e.id) from route join e on e.src = route.node_id)"""
_BFS = f"""{_PATHS}, first as (select node_id, min(level) as level from route group by node_id),
  least as (select node_id, level, min(way) as way from route join first using (node_id, level) group by node_id, level)
select row_number() over (order by level, way) - 1 as pos, node_id, level from least"""
_DFS = f"""{_PATHS}, least as (select node_id, min(list_transform(way, lambda x: -x)) as way from route group by node_id)
select row_number() over (order by way) - 1 as pos, node_id from least"""
_both("bfs_order", f"TRAVERSE BFS FROM N{_CUSTOMER + 1}", f"TRAVERSE BFS FROM N{_CUSTOMER + 1}", _plain("pos", "node_id", "level"), _BFS)
_both("dfs_order", f"TRAVERSE DFS FROM N{_CUSTOMER + 1}", f"TRAVERSE DFS FROM N{_CUSTOMER + 1}", _plain("pos", "node_id"), _DFS)


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of users: each upserts its user with the event's type as label; a type of purchase deletes it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    empty = F.lit(None).cast(change_log.CHANGES.rpartition("properties ")[2])
    return e.select(F.lit("log").alias("file"), F.col("event_id").alias("place"), F.when(F.col("event_type") == "purchase", "delete_node").otherwise("upsert_node").alias("op"), F.col("user_id").alias("id"), F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"), F.col("event_type").alias("label"), F.lit(None).cast("double").alias("weight"), empty.alias("properties"))


_add(
    "oplog_replay",
    lambda s, d: change_log.replay(_event_log(s, d))[0].select("id", "label"),
    "select user_id as id, arg_max(event_type, event_id) as label from events group by user_id having arg_max(event_type, event_id) <> 'purchase'",
)


_add(
    "synthetic_population",
    lambda s, d: build(synthetic(s), LANGUAGES["simple"].parse("MATCH NODE WHERE props.population > 5000000")).select("id"),
    "select i as id from range(10000) t(i) where (i % 10000) * 1000 + 50000 > 5000000",
)
_add(
    "synthetic_age",
    lambda s, d: build(synthetic(s), LANGUAGES["cypher"].parse("MATCH (p:Person) WHERE p.age > 30 RETURN p")).select("id"),
    "select 10000 + i as id from range(50000) t(i) where 20 + i % 60 > 30",
)
_add("synthetic_coastal", lambda s, d: build(synthetic(s), LANGUAGES["simple"].parse("MATCH NODE WHERE props.coastal = true")).select("id"), "select i as id from range(10000) t(i) where i % 3 = 0")
_add("synthetic_bfs", lambda s, d: traversal.bfs_levels(PropertyGraph(s, synthetic(s).node_tables, synthetic(s).edge_tables[:1]), 10_007), "select 10007 as node_id, 0 as level union all select 7, 1")


def _map_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same question to the map layout: typed columns and tagged values must agree."""
    g = _graph(spark, sf_dir)
    general = PropertyGraph(spark, [Table(g.nodes())], [Table(g.edges())])
    return build(general, LANGUAGES["simple"].parse('MATCH NODE WHERE label = "Customer" AND props.c_acctbal > 0')).select("id", F.col("properties")["c_acctbal"]["d"].alias("prop"))


_add("match_nodes_map_layout", _map_layout, f"select {_CUSTOMER} + c_custkey as id, c_acctbal as prop from customer where c_acctbal > 0")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = 'MATCH NODE WHERE label = "Customer" AND props.c_acctbal > 0'
    return _run(text, "simple", _with_prop("c_acctbal", "float", "id", "label"))(spark, sf_dir)


from quillgraph import registry_sessions  # noqa: E402  adds its own

registry_sessions.register(_add)
