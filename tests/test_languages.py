import pytest

from quillgraph.errors import ParseError
from quillgraph.plans.commands import Condition, CountEdges, CountNodes, GetEdge, GetNode, MatchEdges, MatchNodes, ShortestPath, Traverse
from quillgraph.plans.languages import LANGUAGES, language_switch, split_prefix

SIMPLE, PATTERN = LANGUAGES["simple"].parse, LANGUAGES["cypher"].parse


@pytest.mark.parametrize(
    ("text", "command"),
    [
        ("MATCH NODE", MatchNodes()),
        ('match node where label="City" and props.pop>1000', MatchNodes((Condition(("label",), "=", "City"), Condition(("prop", "pop"), ">", 1000)))),
        ("MATCH NODE WHERE props.a = -5 AND props.b = 1.5 AND props.c = NULL AND props.d = true", MatchNodes(tuple(Condition(("prop", k), "=", v) for k, v in (("a", -5), ("b", 1.5), ("c", None), ("d", True))))),
        ('MATCH EDGE WHERE weight < 1e3 AND label = "RAIL"', MatchEdges((Condition(("weight",), "<", 1000.0), Condition(("label",), "=", "RAIL")))),
        ("GET NODE N5", GetNode(5)),
        ("GET EDGE E3", GetEdge(3)),
        ("TRAVERSE BFS FROM N0", Traverse("BFS", 0)),
        ("path from N0 to N4", ShortestPath(0, 4)),
        ("COUNT NODES", CountNodes()),
        ("COUNT EDGES", CountEdges()),
    ],
)
def test_simple(text, command):
    assert SIMPLE(text) == command


@pytest.mark.parametrize(
    ("text", "command"),
    [
        ("MATCH (n) RETURN n", MatchNodes()),
        ("MATCH (n:City) WHERE n.pop >= 10 RETURN n", MatchNodes((Condition(("label",), "=", "City"), Condition(("prop", "pop"), ">=", 10)))),
        ("MATCH (a)-[r:RAIL]->(b) WHERE r.Weight <= -1.5 AND r.x = \"a b\" RETURN a, r, b", MatchEdges((Condition(("label",), "=", "RAIL"), Condition(("weight",), "<=", -1.5), Condition(("prop", "x"), "=", "a b")))),
        ("MATCH (n:count) WHERE n.path = null RETURN *", MatchNodes((Condition(("label",), "=", "count"), Condition(("prop", "path"), "=", None)))),
        ("MATCH (n) WHERE n.label = \"X\" RETURN n", MatchNodes((Condition(("prop", "label"), "=", "X"),))),
        ("TRAVERSE DFS FROM N1", Traverse("DFS", 1)),
    ],
)
def test_pattern(text, command):
    assert PATTERN(text) == command


@pytest.mark.parametrize("text", ["", "MATCH", "MATCH NODE FOO", "GET NODE 5", "GET NODE n5", "MATCH NODE WHERE label > \"x\"", "MATCH NODE WHERE props.a = 1e5", "COUNT", "TRAVERSE XFS FROM N0", "GET NODE N9223372036854775808", 'MATCH NODE WHERE props.a = "x', "MATCH NODE WHERE weight > 1"])
def test_simple_errors(text):
    with pytest.raises(ParseError):
        SIMPLE(text)


@pytest.mark.parametrize("text", ["", "MATCH (n)", "MATCH (n) RETURN", "MATCH (n) WHERE m.a = 1 RETURN n", "MATCH (a)<-[r]-(b) RETURN r", "COUNT NODES x", "MATCH (n) RETURN n n"])
def test_pattern_errors(text):
    with pytest.raises(ParseError):
        PATTERN(text)


def test_prefix_and_switch():
    assert split_prefix("cypher: COUNT NODES") == ("cypher", "COUNT NODES")
    assert split_prefix("COUNT NODES", "cypher") == ("cypher", "COUNT NODES")
    assert language_switch(":USE Cypher") == "cypher" and language_switch(":lang x") is None
