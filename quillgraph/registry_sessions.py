"""Queries that run what changes a graph: logs and their formats, sessions, transactions, compaction, the server, reports.

Each begins with an empty folder below spark.checkpoint.dir and fills it from the star-schema tables.
"""

from __future__ import annotations

import contextlib
import io
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import workload
from quillgraph._ship import ship
from quillgraph.errors import GraphError, NodeNotFound
from quillgraph.model import PropertyGraph, tagged_column
from quillgraph.operators import statistics
from quillgraph.operators.rounds import shared_folder
from quillgraph.plans.languages import LANGUAGES
from quillgraph.plans.planner import GraphStatistics, build, describe
from quillgraph.repl import Repl
from quillgraph.server import Client, GraphServer
from quillgraph.session import Config, LoggedGraph, Metrics
from quillgraph.shared import SharedGraph
from quillgraph.sources import change_log
from quillgraph.sources.star_schema import SPAN, load
from quillgraph.streaming import log_stream

_QUIET = {"slow_query_warn_ms": 1e12}


def _folder(spark: SparkSession) -> str:
    ship(spark)
    return f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"


def _opened(spark: SparkSession, form: str = "json", **config) -> LoggedGraph:
    return LoggedGraph.open(spark, _folder(spark), Config(form=form, **(_QUIET | {"auto_compact_after_writes": 0} | config)))


def _again(graph: LoggedGraph) -> LoggedGraph:
    return LoggedGraph.open(graph.spark, graph.storage.path, graph.config)


# ---- regions and nations by single changes and transactions


def _regions(spark: SparkSession, sf_dir: str, form: str, **config) -> LoggedGraph:
    """Regions as nodes 0 to 4 one by one, then nations as nodes 5 to 29 with an edge each in one transaction, then changes:
    region 1 and nation 3 go, so does the edge of nation 7; what is rolled back, or fails, leaves no trace but its ids."""
    db = _opened(spark, form, **config)
    for r in spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").collect():
        db.insert_node("Region", {"key": r.r_regionkey, "name": r.r_name})
    txn = db.begin_transaction()
    for n in spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").collect():
        node = txn.insert_node("Nation", {"key": n.n_nationkey, "name": n.n_name, "half": n.n_nationkey / 2, "even": n.n_nationkey % 2 == 0, "nothing": None})
        txn.insert_edge(node, n.n_regionkey, "IN_REGION", 1.5 * n.n_nationkey)
    db.commit_transaction(txn)
    db.delete_node(1)
    change = db.begin_transaction()
    change.delete_node(5 + 3)
    change.delete_edge(7)
    change.delete_node(12345)
    db.commit_transaction(change)
    away = db.begin_transaction()
    away.insert_node("Never")
    db.rollback_transaction(away)
    failing = db.begin_transaction()
    failing.insert_edge(failing.insert_node("Never"), 1, "TO")
    with contextlib.suppress(NodeNotFound):
        db.commit_transaction(failing)
    with contextlib.suppress(NodeNotFound):
        db.insert_edge(1, 0, "TO")
    db.insert_node("Last")
    return db


_NODES = """select cast(r_regionkey as bigint) as id, 'Region' as label, r_name as name, cast(null as double) as half, cast(null as boolean) as even from region where r_regionkey <> 1 union all
  select 5 + n_nationkey, 'Nation', n_name, n_nationkey / 2, n_nationkey % 2 = 0 from nation where n_nationkey <> 3 union all select 32, 'Last', null, null, null"""
_EDGES = "select cast(n_nationkey as bigint) as id, cast(5 + n_nationkey as bigint) as src, cast(n_regionkey as bigint) as dst, 'IN_REGION' as label, 1.5 * n_nationkey::double as weight from nation where n_regionkey <> 1 and n_nationkey not in (3, 7)"


def _shown(graph: PropertyGraph) -> DataFrame:
    p = F.col("properties")
    return graph.nodes().select("id", "label", p["name"]["s"].alias("name"), p["half"]["d"].alias("half"), p["even"]["b"].alias("even"))


def _edges_shown(graph: PropertyGraph) -> DataFrame:
    return graph.edges().select("id", "src", "dst", "label", "weight")


def _texts(spark: SparkSession, rows: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rows)), "pos long, said string")


def _values(*rows: str) -> str:
    """SQL of the rows of :func:`_texts`; what stands in double braces is an expression."""
    parts = []
    for k, row in enumerate(rows):
        pieces = row.split("{{")
        text = ["'" + pieces[0].replace("'", "''") + "'"]
        for piece in pieces[1:]:
            expression, _, rest = piece.partition("}}")
            text += [f"({expression})", "'" + rest.replace("'", "''") + "'"]
        parts.append(f"select {k}::bigint as pos, {' || '.join(text)} as said")
    return " union all ".join(parts)


def _answers(db: LoggedGraph) -> list[str]:
    out = [db.execute(q) for q in ("COUNT NODES", "COUNT EDGES", "GET NODE N1", "GET NODE N32", "cypher: MATCH (n:Nation) WHERE n.half > 11.5 RETURN n", "GET EDGE E7", "PATH FROM N5 TO N0", "PATH FROM N0 TO N5")]
    return [*out, db.execute("MATCH NODE", limit=3).splitlines()[0], str(len(db.execute("MATCH NODE", limit=0).splitlines()))]


_ANSWERS = _values(
    "Count: {{select count(*) from region r where r_regionkey <> 1 }}".replace("select count(*) from region r where r_regionkey <> 1 ", f"select count(*) from ({_NODES})"),
    f"Count: {{{{select count(*) from ({_EDGES})}}}}",
    "(not found)",
    "(N32 :Last)",
    "Nodes (1):\n  (N29 :Nation) {even: true, half: 12, key: 24, name: \"{{select n_name from nation where n_nationkey = 24}}\", nothing: null}",
    "(not found)",
    "Path (0.00): N5 → N{{select n_regionkey from nation where n_nationkey = 0}}",
    "(empty)",
    "Nodes (3):",
    f"{{{{select count(*) + 1 from ({_NODES})}}}}",
)


# ---- whole tables through the formats


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers and nations as nodes, LIVES_IN as edges, in the general schema."""
    g = load(spark, sf_dir)
    nodes = [t for t in g.node_tables if t.label in ("Customer", "Nation")]
    of = PropertyGraph(spark, nodes, [t for t in g.edge_tables if t.label == "LIVES_IN"])
    return of.nodes(), of.edges()


def _round_trip(form: str) -> Callable[[SparkSession, str], PropertyGraph]:
    def run(spark: SparkSession, sf_dir: str) -> PropertyGraph:
        nodes, edges = _customers(spark, sf_dir)
        at = _folder(spark)
        if form == "json":
            change_log.write_json(nodes, edges, at)
            return change_log.graph_of(spark, at)
        change_log.write_binary(nodes, edges, at)
        return change_log.graph_of(spark, f"{at}/*/part-*", "binary")

    return run


def _compacted(spark: SparkSession, sf_dir: str) -> LoggedGraph:
    db = _opened(spark)
    nodes, edges = _customers(spark, sf_dir)
    db.storage.compact(nodes, edges, {"node": 10 * SPAN, "edge": 10 * SPAN})
    return _again(db)


_CUSTOMERS = f"select {2 * SPAN} + c_custkey as id, 'Customer' as label, c_acctbal as balance, c_mktsegment as segment from customer union all select {SPAN} + n_nationkey, 'Nation', null, null from nation"


def _customer_columns(graph: PropertyGraph) -> DataFrame:
    p = F.col("properties")
    return graph.nodes().select("id", "label", p["c_acctbal"]["d"].alias("balance"), p["c_mktsegment"]["s"].alias("segment"))


# ---- records of the binary format, decoded where they are made


def _decoded_orders(spark: SparkSession, sf_dir: str, changed: Callable[[int, str, str], bytes]) -> DataFrame:
    """Ids of the nodes that logs of orders give, a log for each batch: (key, status, priority) -> records."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import warnings

        warnings.simplefilter("ignore")  # records with a wrong checksum are meant to be there
        for batch in batches:
            raw = change_log.header() + b"".join(changed(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
            alive: dict[int, bool] = {}
            for op, i, *_ in change_log.decoded(raw):
                alive[i] = op == "upsert_node"
            yield pa.RecordBatch.from_arrays([pa.array([i for i, on in alive.items() if on], pa.int64())], ["id"])

    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderpriority").mapInArrow(run, "id long")


def _upsert(key: int) -> bytes:
    return change_log.binary_record(("upsert_node", key, None, None, "Order", None, {"key": key}))


def _marked(key: int, status: str, _: str) -> bytes:
    """A transaction for each order: F is committed, O rolled back, P left open for the next one to discard."""
    import struct

    number = struct.pack("<Q", key)
    mark = {"F": change_log.COMMIT, "O": change_log.ROLLBACK}.get(status)
    return change_log.record(change_log.BEGIN, number) + _upsert(key) + (change_log.record(mark, number) if mark else b"")


def _damaged(key: int, _: str, priority: str) -> bytes:
    """One bit of the record of every urgent order is wrong, within its key or its checksum."""
    raw = bytearray(_upsert(key))
    if priority.startswith("1"):
        raw[1 + key % 3 if key % 2 else -1] ^= 1
    return bytes(raw)


def _deleting(key: int, status: str, _: str) -> bytes:
    """Orders of status O are deleted in the transaction that upserts them, before it does: deletes count last."""
    delete = change_log.binary_record(("delete_node", key, None, None, None, None, {})) if status == "O" else b""
    return change_log.transaction_bytes(key, []).replace(change_log.transaction_bytes(key, [])[13:], b"") + delete + _upsert(key) + change_log.transaction_bytes(key, [])[13:]


# ---- sessions


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _regions(spark, sf_dir, "json")
    names = ("nodes_inserted", "nodes_deleted", "edges_inserted", "edges_deleted", "transactions_committed", "transactions_rolled_back", "compactions", "writes")
    db.compact()
    db.get_node(0), db.get_node(0), db.get_node(1), db.query('MATCH NODE WHERE label = "Nation"'), db.query("MATCH EDGE")
    m = db.metrics
    rows = [(n, float(getattr(m, n))) for n in names] + [("node_hit_rate", m.node_hit_rate()), ("index_hit_rate", m.index_hit_rate()), ("queries", float(m.queries)), ("average_ms_of_none", Metrics().average_ms())]
    return spark.createDataFrame(rows, "name string, value double")


def _auto_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _regions(spark, sf_dir, "binary", auto_compact_after_writes=4)
    return _texts(spark, [str(db.metrics.compactions), str(len(db.storage._batches())), db.execute("COUNT NODES"), _again(db).execute("COUNT EDGES")])


def _script(spark: SparkSession, sf_dir: str) -> DataFrame:
    repl = Repl(_opened(spark))
    lines = [":seed", ":nodes", ":edges", ":labels", ":use cypher", 'MATCH (c:City) WHERE c.coastal = true RETURN c', "simple: PATH FROM N0 TO N2", ":limit 2", "MATCH (n) RETURN n", ":explain MATCH (n:City) RETURN n", ":time", "NONSENSE", ":compact"]
    return _texts(spark, [repl.handle(line).split(" est.")[0].split(" the size")[0] for line in lines])


_SCRIPT = _values(
    "Added 5 nodes and 6 edges", "Nodes: 5", "Edges: 6", "  City                                     5", "Language: cypher", 'Nodes (1):\n  (N3 :City) {coastal: true, country: "Netherlands", name: "Amsterdam", population: 870000}', "Path (1240.00): N0 → N4 → N3 → N2",
    "Result limit: 2", "Nodes (2):\n  (N0 :City) {coastal: false, country: \"UK\", name: \"London\", population: 9000000}\n  (N1 :City) {coastal: false, country: \"France\", name: \"Paris\", population: 2100000}", "Plan: FullNodeScan ", "Timing: off", "Error: [CypherLite] unknown command 'NONSENSE'", "Compacted;",
)


def _served(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a server to two clients, of which one inserts nothing and one asks in the other language."""
    db = _regions(spark, sf_dir, "json")
    with GraphServer(SharedGraph(db), ("127.0.0.1", 0)) as server:
        server.start()
        a, b = Client(server.server_address), Client(server.server_address)
        said = [a.send("COUNT NODES"), b.send(":use cypher"), b.send('MATCH (n:Region) WHERE n.key = 0 RETURN n'), a.send("cypher: COUNT EDGES"), a.send("MATCH NODE WHERE"), a.send("GET NODE N1"), b.send(":quit")]
        a.close(), b.close()
        server.shutdown()
    return _texts(spark, [f"{good} {text.splitlines()[0]}" for good, text in said])


def _threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four threads insert ten nodes and nine edges each through handles of one graph, asking for counts in between."""
    shared = SharedGraph(_opened(spark))
    seen: list[int] = []

    def work(t: int) -> None:
        handle, before = shared.clone_handle(), None
        for k in range(10):
            node = handle.insert_node(f"T{t}", {"k": k})
            if before is not None:
                handle.insert_edge(before, node, "NEXT", k)
            before = node
        seen.append(handle.node_count())

    threads = [threading.Thread(target=work, args=(t,)) for t in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    g = shared.graph.graph
    return statistics.label_stats(g).select("label", "n", F.lit(g.links().count()).alias("edges"), F.lit(len([x for x in seen if 10 <= x <= 40])).cast("long").alias("seen"))


def _logged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a JSON log's lines as a stream reads them, until nothing more is there."""
    nodes, edges = _customers(spark, sf_dir)
    at, name = _folder(spark), f"counts_{uuid.uuid4().hex}"
    change_log.write_json(nodes, edges, at)
    query = log_stream.counts(log_stream.changes(spark, at)).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{at}-progress").start()
    query.awaitTermination()
    return spark.table(name)


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = load(spark, sf_dir)
    labels = {r.label: r.n for r in statistics.label_stats(g).collect()}
    stats = GraphStatistics(sum(labels.values()), 7, labels, ["c_acctbal", "p_size"])
    parse = LANGUAGES["simple"].parse
    texts = ['MATCH NODE WHERE label = "Region"', "MATCH NODE WHERE props.p_size = 3 AND props.c_acctbal > 1", "MATCH NODE WHERE props.unknown = 3", "MATCH EDGE", "GET NODE N3", "GET EDGE E4", "TRAVERSE BFS FROM N5", "TRAVERSE DFS FROM N5", "PATH FROM N1 TO N2", "COUNT NODES"]
    return _texts(spark, [describe(parse(t), stats) for t in texts])


_ALL = "(select (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from supplier) + (select count(*) from part) + (select count(*) from orders))"
_DESCRIBED = _values(
    "LabelIndexScan(label=Region)  est. cost ~{{select count(*) from region}}", f"PropertyIndexScan(p_size = 3)  est. cost ~{{{{cast(ceil(log2({_ALL})) as bigint) + {_ALL} // 10}}}}", f"FullNodeScan  est. cost ~{{{{{_ALL}}}}}", "FullEdgeScan  est. cost ~7", "NodeLookup(N3)  cost O(1)", "EdgeLookup(E4)  cost O(1)",
    "Traverse(Bfs, start=N5)  cost O(reachable)", "Traverse(Dfs, start=N5)  cost O(reachable)", "ShortestPath(N1→N2)  cost O((V+E)logV)", "CountNodes  cost O(1)",
)


def _workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that each query of the workload gives, once loaded and compacted; of threads at once, what was answered."""
    db = _opened(spark)
    workload.load(db, 1000, 5000)
    rows = [(k, float(workload.timed(db, q, 1).results)) for k, q in enumerate(workload.QUERIES)]
    with contextlib.redirect_stderr(io.StringIO()):
        load_ = workload.concurrently(SharedGraph(db), 2, 3)
    cache = workload.cache_report(db, 4)
    more = [load_.answered, cache["cold_misses"], cache["cold_hits"], cache["warm_hits"], workload.compare_scans(db, 1)["all"].results, len(workload.schema_report(db).splitlines())]
    return spark.createDataFrame(rows + [(len(rows) + k, float(x)) for k, x in enumerate(more)], "k int, n double")


_WORKLOAD = "select k::int as k, n::double as n from (select 0 as k, 1000 as n union all select 1, 5000 union all select 2, (select count(*) from range(1000) t(i) where i * 1000 + 50000 > 5000000) union all select 3, (select count(*) from range(5000) t(i) where 20 + i % 60 > 30) union all select 4, (select count(*) from range(1000) t(i) where i % 3 = 0) union all select 5, 1 union all select 6, 1 union all select 7, 6000 union all select 8, 15000 union all select 9, 1 union all select 10, 0 union all select 11, 6 union all select 12, 4 union all select 13, 0 union all select 14, 4 union all select 15, 6000 union all select 16, 14)"


class _Highest:
    """A traversal of a user's own: the node itself, then all others from the highest id down."""

    def traverse(self, graph: PropertyGraph, start: int) -> DataFrame:
        return graph.node_ids().where(F.col("id") >= start).select((F.col("id") - start).alias("pos"), F.col("id").alias("node_id"))


def _plugged(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _regions(spark, sf_dir, "json")
    return db.traverse(30, _Highest()).unionByName(build(db.graph, LANGUAGES["simple"].parse("TRAVERSE BFS FROM N29"), {"BFS": _Highest()}))


def _raising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each wrong input says."""
    db = _regions(spark, sf_dir, "json", max_full_scan_nodes=10)
    out = []
    for action in (lambda: db.query("MATCH NODE"), lambda: db.query("MATCH NODE WHERE label ="), lambda: db.insert_edge(2, 1, "TO"), lambda: db.query("cypher: MATCH (n) WHERE m.x = 1 RETURN n"), lambda: db.query("GET NODE 5")):
        try:
            action()
            out.append("nothing")
        except GraphError as e:
            out.append(" ".join([type(e).__name__, *str(e).split()[:3]]))
    return _texts(spark, out)


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns as tagged values and back, through a log."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    props = F.map_from_arrays(F.array(F.lit("size"), F.lit("price"), F.lit("name")), F.array(tagged_column(F.col("p_size").cast("long"), "int"), tagged_column(F.col("p_retailprice"), "float"), tagged_column(F.col("p_name"), "text")))
    nodes = p.select(F.col("p_partkey").alias("id"), F.lit("Part").alias("label"), props.alias("properties"))
    none = PropertyGraph.local(spark, [], []).edges()
    at = _folder(spark)
    change_log.write_binary(nodes, none, at)
    p = F.col("properties")
    return change_log.graph_of(spark, f"{at}/base-0-nodes/part-*", "binary").nodes().select("id", p["size"]["i"].alias("size"), p["price"]["d"].alias("price"), p["name"]["s"].alias("name"))


def register(add: Callable) -> None:
    for form in ("json", "binary"):
        add(f"logged_nodes_{form}", lambda s, d, f=form: _shown(_regions(s, d, f).graph), _NODES)
        add(f"logged_edges_{form}", lambda s, d, f=form: _edges_shown(_regions(s, d, f).graph), _EDGES)
        add(f"reopened_nodes_{form}", lambda s, d, f=form: _shown(_again(_regions(s, d, f)).graph), _NODES)
        add(f"reopened_edges_{form}", lambda s, d, f=form: _edges_shown(_again(_regions(s, d, f)).graph), _EDGES)

        def compact(spark: SparkSession, sf_dir: str, form: str = form) -> LoggedGraph:
            db = _regions(spark, sf_dir, form)
            db.compact()
            return _again(db)

        add(f"compacted_nodes_{form}", lambda s, d, c=compact: _shown(c(s, d).graph), _NODES)
        add(f"compacted_edges_{form}", lambda s, d, c=compact: _edges_shown(c(s, d).graph), _EDGES)
        add(f"{form}_round_trip_nodes", lambda s, d, f=form: _customer_columns(_round_trip(f)(s, d)), _CUSTOMERS)
        add(f"{form}_round_trip_edges", lambda s, d, f=form: _round_trip(f)(s, d).edges().select("src", "dst", "label", "weight"), f"select {2 * SPAN} + c_custkey as src, {SPAN} + c_nationkey as dst, 'LIVES_IN' as label, 1.0::double as weight from customer")
    add("binary_round_trip_kinds", _tagged, "select p_partkey as id, cast(p_size as bigint) as size, p_retailprice as price, p_name as name from part")
    add("session_answers", lambda s, d: _texts(s, _answers(_regions(s, d, "json"))), _ANSWERS)
    add("session_errors", _raising, _values("ScanTooLarge the query reads", "ParseError [SimpleQuery] a label", "NodeNotFound node N1 not", "ParseError [CypherLite] unknown variable", "ParseError [SimpleQuery] expected N<digits>,"))
    add("session_metrics", _counted, "select * from (values ('nodes_inserted', 31.0::double), ('nodes_deleted', 3), ('edges_inserted', 25), ('edges_deleted', 1), ('transactions_committed', 2), ('transactions_rolled_back', 2), ('compactions', 1), ('writes', 60), ('node_hit_rate', 1.0 / 3), ('index_hit_rate', 0.5), ('queries', 2), ('average_ms_of_none', 0)) t(name, value)")
    add("auto_compaction", _auto_compacted, _values("3", "1", f"Count: {{{{select count(*) from ({_NODES})}}}}", f"Count: {{{{select count(*) from ({_EDGES})}}}}"))
    # a node that was deleted takes its edges along, whatever the log's age
    add("delete_node_cascade", lambda s, d: _regions(s, d, "json").query("MATCH EDGE WHERE weight >= 0").groupBy("dst").agg(F.count(F.lit(1)).alias("n")), f"select dst, count(*) as n from ({_EDGES}) group by dst")
    add("txn_visibility", lambda s, d: _decoded_orders(s, d, _marked), "select o_orderkey as id from orders where o_orderstatus = 'F'")
    add("checksum_skips", lambda s, d: _decoded_orders(s, d, _damaged), "select o_orderkey as id from orders where o_orderpriority not like '1%'")
    add("txn_deletes_last", lambda s, d: _decoded_orders(s, d, _deleting), "select o_orderkey as id from orders where o_orderstatus <> 'O'")
    add("label_folder_scan", lambda s, d: _compacted(s, d).query('MATCH NODE WHERE label = "Nation"').select("id", "label"), f"select {SPAN} + n_nationkey as id, 'Nation' as label from nation")
    add("typed_column_scan", lambda s, d: _compacted(s, d).query("MATCH NODE WHERE props.c_acctbal >= 100.5 AND props.c_mktsegment != \"BUILDING\"").select("id", F.col("properties")["c_acctbal"]["d"].alias("balance")), f"select {2 * SPAN} + c_custkey as id, c_acctbal as balance from customer where c_acctbal >= 100.5 and c_mktsegment <> 'BUILDING'")
    add("script", _script, _SCRIPT)
    add("server_answers", _served, _values(f"True Count: {{{{select count(*) from ({_NODES})}}}}", "True Language: cypher", "True Nodes (1):", f"True Count: {{{{select count(*) from ({_EDGES})}}}}", "False [SimpleQuery] expected a field, found 'the end'", "True (not found)", "True Bye!"))
    add("shared_graph", _threads, "select label, 10::bigint as n, 36::bigint as edges, 4::bigint as seen from (values ('T0'), ('T1'), ('T2'), ('T3')) t(label)")
    add("log_stream_counts", _logged_stream, "select 'UpsertNode' as op, 'Customer' as label, count(*) as n from customer union all select 'UpsertNode', 'Nation', count(*) from nation union all select 'UpsertEdge', 'LIVES_IN', count(*) from customer")
    add("plan_descriptions", _described, _DESCRIBED)
    add("workload", _workload, _WORKLOAD)
    add("plug_in_traversal", _plugged, "select i - 30 as pos, i as node_id from (values (32::bigint)) t(i) union all select i - 29, i from (values (29::bigint), (32)) t(i)")
