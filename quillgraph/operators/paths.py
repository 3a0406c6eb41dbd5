"""Weighted shortest paths along outgoing edges, by rounds of relaxation.

Each round joins the nodes whose distance fell with the edges that they can leave by and keeps, for each node, the
smallest (distance, predecessor's distance, predecessor): sums run from the start outwards, so totals are the same to the
last bit, and for positive weights the path is that of a priority queue ordered by distance and node id. Only what fell is
written; what a round offers is compared with the distances written so far, which are merged every few rounds. With a goal,
distances beyond the best one known to it are dropped. A path is followed back by doubling: each round joins
predecessors of twice as many steps, so that a path of n nodes takes log n rounds.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.errors import GraphError
from quillgraph.model import PropertyGraph
from quillgraph.operators.adjacency import Adjacency, small
from quillgraph.operators.rounds import saved

PATH = "pos int, node_id long, dist double"
#: Rounds after which distances written so far are merged.
_MERGE = 8
_NEGATIVE = "shortest paths need weights of 0 or more"


class ShortestPathAlgorithm(Protocol):
    """A path from ``start`` to ``goal`` as (pos, node_id, dist), empty without one; users may have their own."""

    def find_shortest_path(self, graph: PropertyGraph, start: int, goal: int) -> DataFrame: ...


def distances(graph: PropertyGraph, start: int, goal: int | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(node_id, dist, pred) of reachable nodes; with ``goal``, of those no farther than it. Raises on a negative weight
    of an edge that is reached.

    Edges with a NaN weight count as absent, as such a sum is never smaller.
    """
    try:
        return _distances(graph, start, goal, max_rounds)
    except Exception as e:
        if _NEGATIVE in str(e):
            raise GraphError(_NEGATIVE) from None
        raise


def _distances(graph: PropertyGraph, start: int, goal: int | None, max_rounds: int) -> DataFrame:
    edges = Adjacency(graph, "src", "dst", "weight")
    first = F.struct(F.lit(0.0).alias("dist"), F.lit(None).cast("double").alias("pred_dist"), F.lit(None).cast("long").alias("pred"))
    fell = saved(graph.node_ids().where(F.col("id") == start).limit(1).select(F.col("id").alias("node_id"), first.alias("by")))
    written, bound, total = [fell], None, 0
    at_goal = F.min(F.when(F.col("node_id") == goal, F.col("by.dist"))) if goal is not None else F.lit(None).cast("double")
    for round_ in range(max_rounds):
        row = fell.agg(F.count(F.lit(1)).alias("n"), at_goal.alias("goal"), *edges.flags("node_id")).first()
        n, wanted = row["n"], [row[f"table_{k}"] for k in range(len(graph.edge_tables))]
        total += n
        bound = row["goal"] if row["goal"] is not None else bound
        links = edges.links(wanted) if n else None
        if links is None:
            break
        sound = F.when(F.col("weight") < 0, F.raise_error(F.lit(_NEGATIVE)).cast("double")).otherwise(F.col("weight"))
        offered = links.where(~F.isnan("weight")).join(small(fell, n), F.col("node_id") == F.col("src")).select(
            F.col("dst").alias("node_id"), F.struct((F.col("by.dist") + sound).alias("dist"), F.col("by.dist").alias("pred_dist"), F.col("node_id").alias("pred")).alias("by")
        )
        # the start keeps its place: a way back to it is never shorter
        offered = offered.where(F.col("node_id") != start)
        if bound is not None:
            offered = offered.where(F.col("by.dist") <= bound)
        offered = offered.groupBy("node_id").agg(F.min("by").alias("by"))
        known = written[0]
        for part in written[1:]:
            known = known.unionByName(part)
        least = known.groupBy("node_id").agg(F.min("by").alias("old")) if len(written) > 1 else known.select("node_id", F.col("by").alias("old"))
        fell = saved(offered.join(small(least, total), "node_id", "left").where(F.col("old").isNull() | (F.col("by") < F.col("old"))).select("node_id", "by"))
        written.append(fell)
        if round_ % _MERGE == _MERGE - 1:
            written = [saved(known.unionByName(fell).groupBy("node_id").agg(F.min("by").alias("by")))]
    found = written[0]
    for part in written[1:]:
        found = found.unionByName(part)
    return found.groupBy("node_id").agg(F.min("by").alias("by")).select("node_id", F.col("by.dist").alias("dist"), F.col("by.pred").alias("pred"))


def shortest_path(graph: PropertyGraph, start: int, goal: int) -> DataFrame:
    """(pos, node_id, dist) from ``start`` to ``goal``; empty if either is missing or there is no way."""
    spark = graph.spark
    none = spark.createDataFrame([], PATH)
    ends = {r.id for r in graph.node_ids().where(F.col("id").isin(start, goal)).distinct().collect()}
    if not {start, goal} <= ends:
        return none
    found = saved(distances(graph, start, goal))
    n = found.count()
    # back: nodes of the path and their steps before the goal; ahead: predecessors of 2^k steps
    back = saved(found.where(F.col("node_id") == goal).select("node_id", F.lit(0).alias("steps")))
    if back.isEmpty():
        return none
    ahead, reach, length = found.where("pred is not null").select("node_id", F.col("pred").alias("to")), 1, 1
    while True:
        further = back.join(small(ahead, n), "node_id").select(F.col("to").alias("node_id"), (F.col("steps") + reach).alias("steps"))
        back = saved(back.unionByName(further))
        now = back.count()
        if now < length + reach:  # the start is reached
            break
        length, reach = now, 2 * reach
        ahead = saved(ahead.join(small(ahead.select(F.col("node_id").alias("to"), F.col("to").alias("far")), n), "to").select("node_id", F.col("far").alias("to")))
    last = back.agg(F.max("steps")).first()[0]
    return back.join(found, "node_id").select((F.lit(last) - F.col("steps")).cast("int").alias("pos"), "node_id", "dist")


class Dijkstra:
    """The path of a priority queue, by rounds of relaxation."""

    def find_shortest_path(self, graph: PropertyGraph, start: int, goal: int) -> DataFrame:
        return shortest_path(graph, start, goal)
