"""Commands as DataFrames, and a description of each plan with an estimate of its cost.

Catalyst picks the access path; a plan's description only says which part of the data it needs: a label's tables, rows
that a pushed-down comparison leaves, or everything. Which files are passed over is seen in Spark's own plan, which
``LoggedGraph.explain`` shows below the description.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.compare import compare_float, compare_typed, compare_value
from quillgraph.model import PropertyGraph, Table, show_value
from quillgraph.plans.commands import Command, Condition, CountEdges, CountNodes, GetEdge, GetNode, MatchEdges, MatchNodes, ShortestPath, Traverse

# Fixed values of plan texts: the order in which comparisons are named, and what an index scan is said to cost.
_RANK = {"=": 0, "<": 2, "<=": 2, ">": 2, ">=": 2, "!=": 4}
_INDEX_SHARE = 10

#: What stands before a label in the folders of a layout by label.
FOLDER_MARK = "l"


def _predicate(table: Table, condition: Condition) -> Column | bool:
    """A column, or False where no row of the table can match, True where all do."""
    where, op, value = condition.target, condition.op, condition.value
    if where[0] == "label":
        if table.label_folder is not None:
            return F.col(table.label_folder) == F.lit(FOLDER_MARK + value)
        return table.label == value if table.label is not None else F.col("label") == F.lit(value)
    if where[0] == "weight":
        return compare_float(F.col("weight"), op, float(value))
    if table.label is None:
        if where[1] in table.typed and value is not None:
            return reduce(or_, (compare_typed(F.col(c), kind, op, value, filters=True) for c, kind in table.typed[where[1]]))
        if table.complete and where[1] not in table.typed:
            return False
        return compare_value(F.col("properties")[where[1]], op, value)
    if where[1] not in table.props:
        return False
    return compare_typed(F.col(f"p_{where[1]}"), table.props[where[1]], op, value, filters=True)


def _match(tables: list[Table], conditions: tuple[Condition, ...], edges: bool) -> DataFrame:
    """Rows of all tables that can match, each filtered by what its columns are."""
    parts: list[DataFrame] = []
    for t in tables:
        predicates = [_predicate(t, c) for c in conditions]
        if any(p is False for p in predicates):
            continue
        columns = [p for p in predicates if p is not True]
        df = t.df.where(reduce(and_, columns)) if columns else t.df
        parts.append(Table(df, t.label, t.props).general(edges))
    if not parts:
        return tables[0].general(edges).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def match_nodes(graph: PropertyGraph, conditions: tuple[Condition, ...] = ()) -> DataFrame:
    return _match(graph.node_tables, conditions, False)


def match_edges(graph: PropertyGraph, conditions: tuple[Condition, ...] = ()) -> DataFrame:
    return _match(graph.edge_tables, conditions, True)


def prunes(table: Table, condition: Condition) -> bool:
    """Whether files or row groups of a table can be passed over by a condition, rather than read and filtered."""
    where = condition.target
    if where[0] == "label":
        return table.label is not None or table.label_folder is not None
    return where[0] == "weight" or where[1] in table.props or where[1] in table.typed or table.label is not None or table.complete


class QueryContext(Protocol):
    """What commands ask of a graph; :class:`PropertyGraph` is one."""

    spark: SparkSession
    node_tables: list[Table]
    edge_tables: list[Table]

    def nodes(self) -> DataFrame: ...
    def edges(self) -> DataFrame: ...
    def node_ids(self) -> DataFrame: ...
    def links(self) -> DataFrame: ...


def default_algorithms() -> dict[str, object]:
    """What TRAVERSE BFS, TRAVERSE DFS and PATH run."""
    from quillgraph.operators import paths, traversal

    return {"BFS": traversal.BreadthFirst(), "DFS": traversal.DepthFirst(), "PATH": paths.Dijkstra()}


def build(graph: QueryContext, command: Command, algorithms: dict[str, object] | None = None) -> DataFrame:
    """The DataFrame of a command: nodes, edges, (pos, node_id[, level]), (pos, node_id, dist) or (count).

    ``algorithms`` may have others under the names of :func:`default_algorithms`.
    """
    from quillgraph.operators import statistics

    use = default_algorithms() | (algorithms or {})
    if isinstance(command, MatchNodes):
        return match_nodes(graph, command.conditions)
    if isinstance(command, MatchEdges):
        return match_edges(graph, command.conditions)
    if isinstance(command, GetNode):
        return graph.nodes().where(F.col("id") == command.id)
    if isinstance(command, GetEdge):
        return graph.edges().where(F.col("id") == command.id)
    if isinstance(command, Traverse):
        return use[command.kind].traverse(graph, command.start)
    if isinstance(command, ShortestPath):
        return use["PATH"].find_shortest_path(graph, command.start, command.goal)
    return statistics.count_nodes(graph) if isinstance(command, CountNodes) else statistics.count_edges(graph)


@dataclass
class GraphStatistics:
    nodes: int = 0
    edges: int = 0
    labels: dict[str, int] = field(default_factory=dict)
    fields: list[str] = field(default_factory=list)


def _shortcut(conditions: tuple[Condition, ...], stats: GraphStatistics) -> tuple[str, int]:
    """What a match of nodes needs to read and about how many rows that is."""
    n = stats.nodes
    label = next((c.value for c in conditions if c.target == ("label",)), None)
    by_label = stats.labels.get(label, 0) if label is not None else n
    known = [c for c in conditions if c.target[0] == "prop" and c.target[1] in stats.fields]
    by_property = math.ceil(math.log2(n)) + n // _INDEX_SHARE if n else 0
    if known and by_property <= by_label and by_property < n:
        best = min(known, key=lambda c: _RANK[c.op])
        return f"PropertyIndexScan({best.target[1]} {best.op} {show_value(best.value)})", by_property
    if label is not None and by_label < n:
        return f"LabelIndexScan(label={label})", by_label
    return "FullNodeScan", n


def estimated_rows(command: Command, stats: GraphStatistics) -> int:
    """Rows that a match has to read; 0 for other commands."""
    if isinstance(command, MatchNodes):
        return _shortcut(command.conditions, stats)[1]
    return stats.edges if isinstance(command, MatchEdges) else 0


def describe(command: Command, stats: GraphStatistics) -> str:
    if isinstance(command, MatchNodes):
        what, cost = _shortcut(command.conditions, stats)
        return f"{what}  est. cost ~{cost}"
    if isinstance(command, MatchEdges):
        return f"FullEdgeScan  est. cost ~{stats.edges}"
    if isinstance(command, GetNode):
        return f"NodeLookup(N{command.id})  cost O(1)"
    if isinstance(command, GetEdge):
        return f"EdgeLookup(E{command.id})  cost O(1)"
    if isinstance(command, Traverse):
        return f"Traverse({command.kind.capitalize()}, start=N{command.start})  cost O(reachable)"
    if isinstance(command, ShortestPath):
        return f"ShortestPath(N{command.start}→N{command.goal})  cost O((V+E)logV)"
    return f"{type(command).__name__}  cost O(1)"
