"""Breadth-first and depth-first traversal along outgoing edges.

Breadth-first runs one round of joins a level: the frontier meets the edges that it can leave by, nodes already seen are
taken out, and the round's result is checkpointed. A frontier of known, small size is broadcast, so that edges aren't
shuffled for it. Nothing but counts reaches the driver. The order of a level is by the parent's
position, then by edge id. Depth-first order is sequential by nature: the reachable part is found as above and, if
it isn't larger than a limit, ordered in one task.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.errors import ScanTooLarge
from quillgraph.model import PropertyGraph
from quillgraph.operators.adjacency import Adjacency, small
from quillgraph.operators.rounds import numbered, saved

MAX_DFS_EDGES = 5_000_000


class TraversalAlgorithm(Protocol):
    """An order of the nodes that ``start`` reaches, as (pos, node_id); users may have their own."""

    def traverse(self, graph: PropertyGraph, start: int) -> DataFrame: ...


def bfs_levels(graph: PropertyGraph, start: int) -> DataFrame:
    """(node_id, level), each reachable node once; empty if ``start`` isn't a node."""
    edges = Adjacency(graph, "src", "dst")
    frontier = saved(graph.node_ids().where(F.col("id") == start).limit(1).select(F.col("id").alias("node_id"), F.lit(0).alias("level")))
    seen, total, level = frontier, 0, 0
    while True:
        n, wanted = edges.frontier(frontier)
        total += n
        links = edges.links(wanted) if n else None
        if links is None:
            return seen
        level += 1
        reached = links.join(small(frontier.select("node_id"), n), F.col("node_id") == F.col("src"), "left_semi").select(F.col("dst").alias("node_id")).distinct()
        frontier = saved(reached.join(small(seen.select("node_id"), total), "node_id", "left_anti").select("node_id", F.lit(level).alias("level")))
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = saved(seen)


def bfs(graph: PropertyGraph, start: int) -> DataFrame:
    """(pos, node_id, level) in order of discovery."""
    edges = Adjacency(graph, "src", "dst", "id")
    frontier = saved(graph.node_ids().where(F.col("id") == start).limit(1).select(F.lit(0).cast("long").alias("pos"), F.col("id").alias("node_id"), F.lit(0).alias("level")))
    seen, level, total = frontier, 0, 0
    while True:
        n, wanted = edges.frontier(frontier)
        total += n
        links = edges.links(wanted) if n else None
        if links is None:
            return seen
        level += 1
        reached = links.join(small(frontier.select("pos", "node_id"), n), F.col("node_id") == F.col("src")).groupBy(F.col("dst").alias("found")).agg(F.min(F.struct("pos", "id")).alias("by"))
        known = small(seen.select(F.col("node_id").alias("found")), total)
        fresh = reached.join(known, "found", "left_anti").select("found", F.col("by.pos").alias("parent"), F.col("by.id").alias("edge"))
        placed = numbered(fresh, ["parent", "edge"], "pos", total)
        frontier = saved(placed.select("pos", F.col("found").alias("node_id"), F.lit(level).alias("level")))
        seen = seen.unionByName(frontier)
        if level % 8 == 0:
            seen = saved(seen)


def reachable(graph: PropertyGraph, start: int) -> DataFrame:
    return bfs_levels(graph, start).select("node_id")


def _depth_first(start: int):
    def run(links: pd.DataFrame) -> pd.DataFrame:
        following: dict[int, list[int]] = {}
        for s, d in zip(links["src"], links["dst"], strict=True):
            following.setdefault(s, []).append(d)
        order: list[int] = []
        seen: set[int] = set()
        stack = [start]
        while stack:
            node = stack.pop()
            if node not in seen:
                seen.add(node)
                order.append(node)
                stack += [d for d in following.get(node, ()) if d not in seen]
        return pd.DataFrame({"pos": range(len(order)), "node_id": order})

    return run


def dfs(graph: PropertyGraph, start: int, max_edges: int = MAX_DFS_EDGES) -> DataFrame:
    """(pos, node_id): depth first, the neighbour by the last edge id first, a node counted when it is left the stack.

    Raises ScanTooLarge if the reachable part has more than ``max_edges`` edges.
    """
    nodes = saved(reachable(graph, start))
    links = saved(graph.links().join(nodes.withColumnRenamed("node_id", "src"), "src", "left_semi").select("id", "src", "dst"))
    if nodes.isEmpty():
        return nodes.select(F.lit(0).cast("long").alias("pos"), "node_id")
    if (n := links.count()) > max_edges:
        raise ScanTooLarge(f"depth-first order over {n} edges; the limit is {max_edges}")
    only = graph.spark.createDataFrame([(-1, start, start)], "id long, src long, dst long")  # so that a start without edges is a group too
    run = _depth_first(start)
    return links.unionByName(only).withColumn("all", F.lit(1)).groupBy("all").applyInPandas(lambda pdf: run(pdf[pdf["id"] >= 0].sort_values("id")), "pos long, node_id long")


class BreadthFirst:
    def traverse(self, graph: PropertyGraph, start: int) -> DataFrame:
        return bfs(graph, start)


class DepthFirst:
    def __init__(self, max_edges: int = MAX_DFS_EDGES) -> None:
        self.max_edges = max_edges

    def traverse(self, graph: PropertyGraph, start: int) -> DataFrame:
        return dfs(graph, start, self.max_edges)
