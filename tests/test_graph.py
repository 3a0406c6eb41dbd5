import math

import pytest
from pyspark.sql import functions as F

from quillgraph.errors import GraphError, LogError, NodeNotFound
from quillgraph.functions.compare import EPSILON, compare_value, kind_of
from quillgraph.model import VALUE, PropertyGraph, tagged, untagged
from quillgraph.operators import paths, statistics, traversal
from quillgraph.plans.languages import LANGUAGES
from quillgraph.plans.planner import GraphStatistics, build, describe
from quillgraph.session import Config, LoggedGraph
from quillgraph.sources import change_log
from quillgraph.sources.generators import sample

VALUES = [None, True, False, 0, 1, 5, -5, 5.0, 5.0 + EPSILON / 4, 1.5, math.inf, -math.inf, math.nan, "a", "B", "é", ""]


def expected(left, op, right):
    a, b = kind_of(left), kind_of(right)
    if a == b == "null":
        return op == "="
    if a == b and a in ("bool", "int", "text"):
        x, y = (left.encode(), right.encode()) if a == "text" else (left, right)
        return {"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    if {a, b} <= {"int", "float"}:
        x, y = float(left), float(right)
        gap = abs(x - y)
        return {"=": gap < EPSILON, "!=": gap >= EPSILON, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op] if not (math.isnan(x) or math.isnan(y)) and not (op in ("=", "!=") and math.isnan(gap)) else False
    return False


def test_comparison_of_every_pair(spark):
    df = spark.createDataFrame([(i, tagged(v)) for i, v in enumerate(VALUES)] + [(-1, None)], f"i int, v {VALUE}")
    cases = [(op, j) for op in ("=", "!=", "<", "<=", ">", ">=") for j in range(len(VALUES))]
    for r in df.select("i", *(compare_value(F.col("v"), op, VALUES[j]).alias(f"c{k}") for k, (op, j) in enumerate(cases))).collect():
        for k, (op, j) in enumerate(cases):
            want = False if r.i < 0 else expected(VALUES[r.i], op, VALUES[j])
            assert r[f"c{k}"] == want, (VALUES[r.i], op, VALUES[j])


def small(spark, edges):
    ids = sorted({x for e in edges for x in e[:2]})
    return PropertyGraph.local(spark, [(i, "N", {}) for i in ids], [(k, a, b, "E", w, {}) for k, (a, b, w) in enumerate(edges)])


def order(df):
    return [r.node_id for r in sorted(df.collect(), key=lambda r: r.pos)]


def test_traversal(spark):
    g = small(spark, [(0, 1, 1), (0, 2, 1), (1, 3, 1), (2, 3, 1), (3, 0, 1), (2, 4, 1)])
    assert order(traversal.bfs(g, 0)) == [0, 1, 2, 3, 4]
    assert order(traversal.dfs(g, 0)) == [0, 2, 4, 3, 1]
    assert {r.node_id: r.level for r in traversal.bfs_levels(g, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2}
    assert order(traversal.bfs(g, 99)) == [] and order(traversal.dfs(g, 99)) == []


def test_paths(spark):
    g = small(spark, [(0, 1, 1.0), (1, 3, 2.0), (0, 2, 10.0), (2, 3, 1.0), (1, 0, 0.5)])
    found = sorted(paths.shortest_path(g, 0, 3).collect(), key=lambda r: r.pos)
    assert [r.node_id for r in found] == [0, 1, 3] and found[-1].dist == 3.0
    assert [(r.node_id, r.dist) for r in paths.shortest_path(g, 0, 0).collect()] == [(0, 0.0)]
    assert paths.shortest_path(g, 3, 0).collect() == [] and paths.shortest_path(g, 0, 99).collect() == []
    with pytest.raises(GraphError):
        paths.distances(small(spark, [(0, 1, -1.0)]), 0)


def test_sample_graph_in_both_languages(spark):
    g = sample(spark)
    run = lambda text, lang: sorted(r.id for r in build(g, LANGUAGES[lang].parse(text)).collect())
    for a, b, want in [
        ("MATCH NODE WHERE props.population > 2000000", "MATCH (n) WHERE n.population > 2000000 RETURN n", [0, 1, 2]),
        ('MATCH NODE WHERE props.country != "UK"', 'MATCH (c:City) WHERE c.country != "UK" RETURN c', [1, 2, 3, 4]),
        ("MATCH EDGE WHERE weight < 500", "MATCH (a)-[r:RAIL]->(b) WHERE r.weight < 500 RETURN r", [0, 1, 2, 4]),
        ("MATCH NODE WHERE props.missing != 1", "MATCH (n) WHERE n.missing != 1 RETURN n", []),
    ]:
        assert run(a, "simple") == run(b, "cypher") == want
    assert order(paths.shortest_path(g, 0, 2)) == [0, 4, 3, 2]
    assert {(r.node_id, r.weight) for r in statistics.neighbors_out(g, 0).collect()} == {(1, 457.0), (4, 370.0)}
    assert statistics.property_keys(g).collect()[0].key == "coastal"


def test_describe():
    stats = GraphStatistics(1000, 10, {"City": 500, "Rare": 2}, ["population"])
    parse = LANGUAGES["simple"].parse
    assert describe(parse("MATCH NODE WHERE props.population > 1000000"), stats) == "PropertyIndexScan(population > 1000000)  est. cost ~110"
    assert describe(parse('MATCH NODE WHERE label = "Rare" AND props.population > 1'), stats) == "LabelIndexScan(label=Rare)  est. cost ~2"
    assert describe(parse("MATCH NODE"), stats) == "FullNodeScan  est. cost ~1000"
    assert describe(parse("MATCH NODE"), GraphStatistics()) == "FullNodeScan  est. cost ~0"


@pytest.mark.parametrize("form", ["json", "binary"])
def test_log_round_trip(spark, tmp_path, form):
    db = LoggedGraph.open(spark, str(tmp_path / "db"), Config(form=form, auto_compact_after_writes=0))
    everything = {"n": None, "b": True, "i": -42, "f": 3.14, "s": 'he"llö'}
    a, b = db.insert_node("AllTypes", everything), db.insert_node("Place", {"name": "x"})
    txn = db.begin_transaction()
    c = txn.insert_node("Place")
    txn.insert_edge(a, c, "TO", 2.5, {"k": 1})
    txn.insert_edge(b, a, "TO")
    db.commit_transaction(txn)
    gone = db.begin_transaction()
    gone.insert_node("Never")
    db.rollback_transaction(gone)
    bad = db.begin_transaction()
    bad.insert_node("Never")
    bad.insert_edge(a, 999, "TO")
    with pytest.raises(NodeNotFound):
        db.commit_transaction(bad)
    with pytest.raises(NodeNotFound):
        db.insert_edge(999, a, "TO")
    db.delete_node(b)
    db.delete_node(b)
    for round_ in range(2):
        again = LoggedGraph.open(spark, str(tmp_path / "db"), Config(form=form, auto_compact_after_writes=0))
        assert db.execute("COUNT NODES") == again.execute("COUNT NODES") == "Count: 2"
        assert again.execute("COUNT EDGES") == "Count: 1"
        assert {k: untagged(v) for k, v in again.get_node(a)["properties"].items()} == everything
        assert again.get_node(b) is None and again.get_edge(0)["weight"] == 2.5
        assert again.execute(f"PATH FROM N{a} TO N{c}") == f"Path (2.50): N{a} → N{c}"
        if not round_:
            db.compact()
    assert db.metrics.transactions_rolled_back == 2 and db.wal_size_bytes() > 0
    assert "FullNodeScan" in db.explain("MATCH NODE")


def test_binary_corruption():
    node = ("upsert_node", 1, None, None, "A", None, {"x": 1})
    raw = change_log.header() + change_log.binary_record(node)
    broken = bytearray(change_log.binary_record(("upsert_node", 2, None, None, "B", None, {})))
    broken[1] ^= 1
    with pytest.warns(UserWarning):
        assert change_log.decode(raw + bytes(broken) + change_log.binary_record(("delete_node", 7, None, None, None, None, {})))[1][:2] == ("delete_node", 7)
    assert change_log.decode(raw + change_log.transaction_bytes(1, [node])[:-14]) == [node]
    with pytest.raises(LogError):
        change_log.decode(b"nonsense")


def test_malformed_json_line(spark, tmp_path):
    (tmp_path / "x.log").write_text(change_log.json_line(("delete_node", 1, None, None, None, None, {})) + "\n\n{oops\n")
    with pytest.raises(Exception, match="malformed line"):
        change_log.read_json(spark, str(tmp_path)).collect()


def test_stream(spark, tmp_path):
    from quillgraph.streaming import log_stream

    (tmp_path / "a.log").write_text("\n".join(change_log.json_line(("upsert_node", i, None, None, "City", None, {})) for i in range(3)))
    q = log_stream.counts(log_stream.changes(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.label, r.n) for r in spark.sql("select * from changes").collect()] == [("City", 3)]
