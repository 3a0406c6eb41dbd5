"""Counts, labels, property keys, and a node's surroundings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.model import PropertyGraph


def count_nodes(graph: PropertyGraph) -> DataFrame:
    return graph.node_ids().agg(F.count(F.lit(1)).alias("count"))


def count_edges(graph: PropertyGraph) -> DataFrame:
    return graph.links().agg(F.count(F.lit(1)).alias("count"))


def label_stats(graph: PropertyGraph) -> DataFrame:
    """(label, n), most frequent first, ties by label."""
    return graph.label_column().groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def label_count(graph: PropertyGraph, label: str) -> DataFrame:
    return graph.label_column().where(F.col("label") == label).agg(F.count(F.lit(1)).alias("n"))


def node_ids_by_label(graph: PropertyGraph, label: str) -> DataFrame:
    parts = [t.df.where(F.col("label") == label).select("id") if t.label is None else t.df.select("id") for t in graph.node_tables if t.label in (None, label)]
    return reduce(DataFrame.unionByName, parts) if parts else graph.node_ids().where(F.lit(False))


def all_labels(graph: PropertyGraph) -> DataFrame:
    return graph.label_column().distinct()


def _keys(graph: PropertyGraph) -> DataFrame:
    """Distinct (key, tagged value) of node properties."""
    parts = [t.general(False).select(F.explode("properties").alias("key", "value")) for t in graph.node_tables if t.label is None or t.props]
    if not parts:
        return graph.nodes().where(F.lit(False)).select(F.explode("properties").alias("key", "value"))
    return reduce(DataFrame.unionByName, parts)


def property_keys(graph: PropertyGraph) -> DataFrame:
    """(key) of node properties, ascending. Typed tables whose column has any value are asked by column."""
    return _keys(graph).where("value is not null").select("key").distinct().orderBy("key")


def field_cardinality(graph: PropertyGraph, name: str) -> DataFrame:
    """(key, n): distinct values of a property, by kind; null counts as one."""
    return _keys(graph).where((F.col("key") == name) & F.col("value").isNotNull()).groupBy("key").agg(F.countDistinct("value.t", F.coalesce(F.col("value.b").cast("string"), F.lit("")), F.coalesce("value.i", F.lit(0)), F.coalesce("value.d", F.lit(0.0)), F.coalesce("value.s", F.lit(""))).alias("n"))


def neighbors_out(graph: PropertyGraph, node: int) -> DataFrame:
    """(node_id, edge_id, weight), one row an edge."""
    return graph.links().where(F.col("src") == node).select(F.col("dst").alias("node_id"), F.col("id").alias("edge_id"), "weight")


def neighbors_in(graph: PropertyGraph, node: int) -> DataFrame:
    return graph.links().where(F.col("dst") == node).select(F.col("src").alias("node_id"), F.col("id").alias("edge_id"), "weight")


def out_degree(graph: PropertyGraph) -> DataFrame:
    return graph.links().groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


def in_degree(graph: PropertyGraph) -> DataFrame:
    return graph.links().groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("n"))


def contains_node(graph: PropertyGraph, node: int) -> DataFrame:
    return graph.node_ids().where(F.col("id") == node).agg((F.count(F.lit(1)) > 0).alias("found"))


def all_node_ids(graph: PropertyGraph) -> DataFrame:
    return graph.node_ids()


def all_edge_ids(graph: PropertyGraph) -> DataFrame:
    return graph.links().select("id")


def orphan_nodes(graph: PropertyGraph) -> DataFrame:
    """Nodes without edges."""
    ends = graph.links().select(F.explode(F.array("src", "dst")).alias("id"))
    return graph.node_ids().join(ends, "id", "left_anti")
