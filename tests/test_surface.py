"""Shared graphs, the server, the interactive session, plug-ins, caches, storage layouts and the workload."""

import threading

import pytest
from pyspark.sql import functions as F

from quillgraph import workload
from quillgraph.errors import GraphError, NodeNotFound, ScanTooLarge
from quillgraph.model import PropertyGraph, untagged
from quillgraph.plans.commands import CountNodes, MatchNodes
from quillgraph.plans.languages import LANGUAGES
from quillgraph.plans.planner import build
from quillgraph.repl import Quit, Remote, Repl
from quillgraph.server import Client, GraphServer
from quillgraph.session import Config, LoggedGraph, Metrics, cardinality
from quillgraph.shared import SharedGraph
from quillgraph.sources import change_log
from quillgraph.sources.cache import LruCache, NoCache
from quillgraph.sources.generators import sample
from quillgraph.sources.storage import MemoryStorage

QUIET = {"slow_query_warn_ms": 1e9, "auto_compact_after_writes": 0}


@pytest.fixture
def seeded(spark, tmp_path):
    graph = LoggedGraph.open(spark, str(tmp_path / "db"), Config(**QUIET))
    Repl(graph).handle(":seed")
    return graph


def test_threads_share_a_graph(seeded):
    shared = SharedGraph(seeded)
    failures = []

    def work(t):
        try:
            handle = shared.clone_handle()
            for k in range(5):
                handle.insert_node("Made", {"by": t, "k": k})
                assert handle.execute('MATCH NODE WHERE label = "City"').startswith("Nodes (5)")
        except Exception as e:
            failures.append(e)

    threads = [threading.Thread(target=work, args=(t,)) for t in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failures and shared.node_count() == 25 and shared.edge_count() == 6
    ids = [r.id for r in seeded.query('MATCH NODE WHERE label = "Made"').collect()]
    assert sorted(ids) == list(range(5, 25)) and shared.metrics().nodes_inserted == 25
    shared.compact()
    assert shared.node_count() == 25 and shared.get_node(0)["label"] == "City"


def test_server(seeded):
    with GraphServer(SharedGraph(seeded), ("127.0.0.1", 0)) as server:
        server.start()
        one, two = Client(server.server_address), Client(server.server_address)
        assert "lang:simple" in one.greeting
        assert one.send("COUNT NODES") == (True, "Count: 5")
        assert two.send("cypher: MATCH (n:City) WHERE n.population > 8000000 RETURN n")[1].startswith("Nodes (1)")
        assert one.send(":use CYPHER") == (True, "Language: cypher") and one.send("MATCH (a)-[r]->(b) WHERE r.weight < 300 RETURN r")[1].startswith("Edges (2)")
        good, text = two.send("NONSENSE")
        assert not good and "unknown command" in text
        assert two.send("PATH FROM N0 TO N2") == (True, "Path (1240.00): N0 → N4 → N3 → N2")
        remote = Remote(two)
        assert remote.handle("COUNT EDGES") == "Count: 6" and remote.handle(":lang cypher") == "Language: cypher"
        assert remote.handle("MATCH (n) RETURN") .startswith("Error:") and "isn't known" in remote.handle(":compact")
        with pytest.raises(Quit):
            remote.handle(":quit")
        assert one.send(":exit") == (True, "Bye!")
        one.close(), two.close()
        server.shutdown()


def test_interactive_session(seeded, tmp_path):
    repl = Repl(seeded)
    assert repl.handle(":nodes") == "Nodes: 5" and repl.handle(":edges") == "Edges: 6" and repl.handle(":seed").startswith("The graph isn't empty")
    assert repl.handle(":labels").split() == ["City", "5"] and "population" in repl.handle(":schema") and "Nodes: 5  Edges: 6" in repl.handle(":schema")
    assert repl.handle(":limit 2") == "Result limit: 2" and repl.handle("MATCH NODE").startswith("Nodes (2)") and repl.handle(":limit x").startswith("Usage") and repl.handle(":limit 0") == "Result limit: unlimited"
    assert repl.handle("MATCH NODE").startswith("Nodes (5)")
    assert repl.handle(":USE cypher") == "Language: cypher" and repl.handle(":lang") == "Language: cypher" and "Unknown language" in repl.handle(":use latin")
    assert repl.handle("simple: COUNT NODES") == "Count: 5" and repl.handle("what?").startswith("Error:") and repl.handle(":what").startswith("Unknown command")
    assert repl.handle(":time") == "Timing: off" and repl.handle(":time on") == "Timing: on" and repl.handle("COUNT NODES").endswith("ms)") and repl.handle(":time off") == "Timing: off"
    assert repl.handle(":use simple") and repl.handle(":explain MATCH NODE") == "Plan: FullNodeScan  est. cost ~5"
    assert "nodes_inserted: 5" in repl.handle(":stats") and repl.handle(":compact").startswith("Compacted") and repl.handle(":nodes") == "Nodes: 5"
    (tmp_path / "script").write_text("# a remark\n\nCOUNT NODES\n:use cypher\nMATCH (n) RETURN n\n:quit\nCOUNT EDGES\n")
    out = repl.handle(f":run {tmp_path / 'script'}")
    assert "Count: 5" in out and "Nodes (5)" in out and "Count: 6" not in out and out.endswith(f"(3 commands of {tmp_path / 'script'})")
    assert "Can't read" in repl.handle(":run /nowhere/at/all") and ":help [topic]" in repl.handle(":help") and "MATCH (n" in repl.handle(":help cypher")
    for k in range(150):
        repl.handle(f"# {k}")
        repl.handle(":time")
    assert len(repl.history) == 100 and len(repl.handle(":history").splitlines()) == 20


class Backwards:
    """A traversal of a user's own: all nodes from the highest id down."""

    def traverse(self, graph, start):
        n = graph.node_ids().count()
        return graph.node_ids().select((F.lit(n - 1) - F.col("id")).alias("pos"), F.col("id").alias("node_id"))


class Direct:
    def find_shortest_path(self, graph, start, goal):
        return graph.spark.createDataFrame([(0, start, 0.0), (1, goal, 1.0)], "pos int, node_id long, dist double")


def test_plug_in_algorithms(spark, seeded):
    assert [r.node_id for r in seeded.traverse(0, Backwards()).orderBy("pos").collect()] == [4, 3, 2, 1, 0]
    assert [r.node_id for r in seeded.find_shortest_path(0, 2, Direct()).orderBy("pos").collect()] == [0, 2]
    assert [r.node_id for r in seeded.traverse(0).orderBy("pos").collect()] == [0, 1, 4, 2, 3] and [r.node_id for r in seeded.traverse(0, "DFS").orderBy("pos").collect()] == [0, 4, 3, 2, 1]
    own = LoggedGraph(spark, storage=seeded.storage, config=Config(**QUIET), algorithms={"DFS": Backwards(), "PATH": Direct()})
    assert own.execute("TRAVERSE DFS FROM N0") == "Traversal [5]: N4 → N3 → N2 → N1 → N0" and own.execute("PATH FROM N0 TO N2") == "Path (1.00): N0 → N2"
    assert own.execute("TRAVERSE BFS FROM N1") == "Traversal [4]: N1 → N4 → N2 → N3"


def test_plug_in_language_and_context(spark, seeded):
    class Shout:
        name = "Shout"

        def parse(self, text):
            return CountNodes() if text == "HOW MANY" else MatchNodes()

    own = LoggedGraph(spark, storage=seeded.storage, config=Config(**QUIET), languages=LANGUAGES | {"shout": Shout()})
    assert own.execute("HOW MANY", "shout") == "Count: 5"

    class Context:
        """Any object with the tables and what is asked of them."""

        def __init__(self, of):
            self.spark, self.node_tables, self.edge_tables = of.spark, of.node_tables, of.edge_tables
            self.nodes, self.edges, self.node_ids, self.links = of.nodes, of.edges, of.node_ids, of.links

    context = Context(sample(spark))
    assert build(context, LANGUAGES["simple"].parse("GET NODE N3")).first().label == "City"
    assert build(context, LANGUAGES["simple"].parse("MATCH EDGE WHERE weight < 300")).count() == 2


def test_cache(spark, seeded):
    seeded.reset_metrics()
    for _ in range(3):
        assert untagged(seeded.get_node(2)["properties"]["name"]) == "Berlin" and seeded.get_edge(0)["weight"] == 457.0
    assert (seeded.metrics.node_hits, seeded.metrics.node_misses, seeded.metrics.edge_hits) == (2, 1, 2)
    assert seeded.metrics.node_hit_rate() == pytest.approx(2 / 3)
    seeded.delete_node(2)
    assert seeded.get_node(2) is None and seeded.get_edge(3) is None and seeded.get_edge(0) is not None
    none = LoggedGraph(spark, storage=seeded.storage, config=Config(**QUIET, cache_nodes=0))
    assert isinstance(none.cache, NoCache) and none.get_node(0) == none.get_node(0) and none.metrics.node_misses == 2
    lru = LruCache(2, 1)
    for k in (1, 2):
        lru.put("node", k, k)
    assert lru.get("node", 1) == 1
    lru.put("node", 3, 3)
    assert (lru.get("node", 2), lru.get("node", 1), lru.get("node", 3)) == (None, 1, 3)
    lru.drop("node", 1)
    assert lru.get("node", 1) is None
    with pytest.raises(ValueError):
        LruCache(0, 1)


def test_own_storage(spark):
    graph = LoggedGraph(spark, storage=MemoryStorage(spark), config=Config(**QUIET))
    a, b = graph.insert_node("A"), graph.insert_node("B", {"x": 1})
    graph.insert_edge(a, b, "TO")
    graph.compact()
    graph.delete_node(a)
    assert graph.execute("COUNT NODES") == "Count: 1" and graph.execute("COUNT EDGES") == "Count: 0" and graph.insert_node("C") == 2
    again = LoggedGraph(spark, storage=graph.storage, config=Config(**QUIET))
    assert again.execute("MATCH NODE WHERE props.x = 1") == "Nodes (1):\n  (N1 :B) {x: 1}" and again.insert_node("D") == 3
    with pytest.raises(GraphError):
        LoggedGraph(spark)


@pytest.mark.parametrize("form", ["json", "binary"])
def test_compacted_tables_pass_over_what_conditions_leave_out(spark, tmp_path, form):
    db = LoggedGraph.open(spark, str(tmp_path / "db"), Config(form=form, **QUIET))
    txn = db.begin_transaction()
    values = [None, True, 7, 2.5, "text", -3]
    ids = [txn.insert_node(["City", "Town", "", "1"][k % 4], {"v": values[k % 6], "n": k, "odd name`.": k} if k % 5 else {}) for k in range(60)]
    edges = [txn.insert_edge(ids[k], ids[(k * 7) % 60], "E" if k % 3 else "F", k / 2, {"since": k}) for k in range(60)]
    db.commit_transaction(txn)
    texts = ['MATCH NODE WHERE label = "City"', 'MATCH NODE WHERE label = ""', 'MATCH NODE WHERE label = "1" AND props.n > 20', "MATCH NODE WHERE props.v = 7", "MATCH NODE WHERE props.v >= 2.5", 'MATCH NODE WHERE props.v != "x"', "MATCH NODE WHERE props.v = null", "MATCH NODE WHERE props.v = true", "MATCH NODE WHERE props.missing = 1", "MATCH NODE", "MATCH EDGE", "MATCH EDGE WHERE props.since < 10 AND weight > 2", 'MATCH EDGE WHERE label = "F"', "COUNT NODES", "COUNT EDGES"]
    answers = lambda g: [sorted(g.execute(t, limit=0).splitlines()) for t in texts]
    before = answers(db)
    db.compact()
    assert answers(db) == before
    assert db.storage.changes() is None and db.wal_size_bytes() > 0
    plan = db.explain('MATCH NODE WHERE label = "City" AND props.n > 20')
    assert "PartitionFilters: [isnotnull(label_folder" in plan, plan
    assert "GreaterThan(v" in plan, plan
    assert answers(LoggedGraph.open(spark, str(tmp_path / "db"), Config(form=form, **QUIET))) == before
    # changes laid over the tables, and the same when opened anew and when compacted again
    db.delete_node(ids[0])
    db.delete_edge(edges[5])
    new = db.insert_node("City", {"n": 99})
    db.insert_edge(new, ids[1], "F", 9.0)
    again = db.begin_transaction()
    again.delete_node(ids[4])
    db.commit_transaction(again)
    with pytest.raises(NodeNotFound):
        db.insert_edge(ids[4], new, "E")
    changed = answers(db)
    assert changed != before
    lost = {k for k in range(60) if {k, (k * 7) % 60} & {0, 4}} | {5}
    assert db.execute("COUNT EDGES") == f"Count: {60 - len(lost) + 1}" and db.execute("COUNT NODES") == "Count: 59"
    assert "PartitionFilters: [isnotnull(label_folder" in db.explain('MATCH NODE WHERE label = "City" AND props.n > 20')
    assert answers(LoggedGraph.open(spark, str(tmp_path / "db"), Config(form=form, **QUIET))) == changed
    db.compact()
    assert answers(db) == changed and db.insert_node("Z") == new + 1


def test_automatic_compaction_and_scan_guard(spark, tmp_path):
    db = LoggedGraph.open(spark, str(tmp_path / "db"), Config(auto_compact_after_writes=4, slow_query_warn_ms=1e9, max_full_scan_nodes=5))
    for k in range(9):
        db.insert_node("A" if k else "B")
    assert db.metrics.compactions == 2 and db.metrics.writes == 9 and len(db.storage._batches()) == 1
    with pytest.raises(ScanTooLarge):
        db.query("MATCH NODE")
    assert db.execute('MATCH NODE WHERE label = "B"').startswith("Nodes (1)")


def test_inserts_do_not_read_the_log_again(spark, tmp_path, monkeypatch):
    db = LoggedGraph.open(spark, str(tmp_path / "db"), Config(**QUIET))
    reads = []
    monkeypatch.setattr(type(db.storage), "changes", lambda self: reads.append(1))
    ids = [db.insert_node("A") for _ in range(20)]
    for a, b in zip(ids[:-1], ids[1:], strict=True):
        db.insert_edge(a, b, "E")
    assert db.execute("COUNT EDGES") == "Count: 19" and not reads and db._graph is not None


def test_transactions(spark, tmp_path):
    db = LoggedGraph.open(spark, str(tmp_path / "db"), Config(**QUIET))
    a = db.insert_node("A")
    txn = db.begin_transaction()
    assert txn.is_empty() and txn.operation_count() == 0
    b = txn.insert_node("B")
    e = txn.insert_edge(a, b, "E")
    txn.delete_edge(e)
    txn.delete_node(a)
    assert txn.operation_count() == 4 and not txn.is_empty() and db.execute("COUNT NODES") == "Count: 1"
    done = db.commit_transaction(txn)
    assert (done.nodes, done.edges, done.deleted) == ([b], [e], 2) and db.execute("COUNT NODES") == "Count: 1" and db.get_node(a) is None
    with pytest.raises(GraphError):
        db.commit_transaction(txn)
    two = db.begin_transaction()
    assert two.id != txn.id
    two.insert_edge(b, a, "E")
    with pytest.raises(NodeNotFound):
        db.commit_transaction(two)
    assert db.metrics.transactions_committed == 1 and db.metrics.transactions_rolled_back == 1


def test_metric_ratios():
    m = Metrics(node_hits=3, node_misses=1, index_scans=1, full_scans=3, queries=4, query_ms=10)
    assert (m.node_hit_rate(), m.edge_hit_rate(), m.index_hit_rate(), m.average_ms()) == (0.75, 0.0, 0.25, 2.5)


def test_binary_files_written_by_executors(spark, tmp_path):
    g = sample(spark)
    more = g.nodes().unionByName(spark.range(1000).selectExpr("id + 10 as id", "'Ü' as label", "cast(null as " + g.nodes().schema["properties"].dataType.simpleString() + ") as properties"))
    change_log.write_binary(more, g.edges(), str(tmp_path / "out"))
    raw = next((tmp_path / "out" / "base-0-nodes").glob("part-*")).read_bytes()
    assert raw.startswith(change_log.header())
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error")  # no record is passed over
        change_log.decode(raw)
    read = change_log.graph_of(spark, str(tmp_path / "out" / "*" / "part-*"), "binary")
    shown = lambda df: sorted(map(repr, df.selectExpr("id", "label", "coalesce(map_entries(properties), array()) as p").collect()))
    assert shown(read.nodes()) == shown(more) and shown(read.edges()) == shown(g.edges())


def test_workload(spark, tmp_path):
    graph = LoggedGraph.open(spark, str(tmp_path / "db"), Config(**QUIET))
    workload.load(graph, 100, 500)
    with pytest.raises(GraphError):
        workload.load(graph)
    results = [workload.timed(graph, q, 2) for q in workload.QUERIES]
    population = sum(i * 1000 + 50000 > 5000000 for i in range(100))
    assert [t.results for t in results] == [100, 500, population, sum(20 + i % 60 > 30 for i in range(500)), 34, 1, 1, 600, 1500, 1, 0]
    assert all(t.least <= t.average <= t.most and len(t.seconds) == 2 for t in results) and "result(s)" in str(results[0])
    done = workload.concurrently(SharedGraph(graph), 4, 3)
    assert done.answered == done.asked == 12 and done.rate > 0
    scans = workload.compare_scans(graph, 1)
    assert {k: t.results for k, t in scans.items()} == {"count": 600, "label": 100, "property": population, "all": 600}
    report = workload.cache_report(graph, 3)
    assert (report["cold_hits"], report["cold_misses"], report["warm_hits"], report["hit_rate"]) == (0, 3, 3, 0.5)
    assert "Person" in workload.schema_report(graph) and graph.insert_node("New") == 600
    assert cardinality(CountNodes(), graph.query("COUNT NODES")) == 601
    assert PropertyGraph.of(graph.graph.nodes(), graph.graph.edges()).links().count() == 1500
