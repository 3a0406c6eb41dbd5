"""The star-schema tables as a property graph with typed columns, so that filters and pruning reach the files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.model import PropertyGraph, Table, kind_of_type

#: An id is its label's code times this, plus the key.
SPAN = 10**12
#: The same of an edge; lines of an order, and supplier keys, at most.
EDGE_SPAN, LINES, KEYS = 10**18, 10**5, 10**8
CODES = {"Region": 0, "Nation": 1, "Customer": 2, "Supplier": 3, "Part": 4, "Order": 5}
_NODES = {"Region": ("region", "r_regionkey"), "Nation": ("nation", "n_nationkey"), "Customer": ("customer", "c_custkey"), "Supplier": ("supplier", "s_suppkey"), "Part": ("part", "p_partkey"), "Order": ("orders", "o_orderkey")}


def node_id(label: str, key: Column | int) -> Column:
    return (F.lit(CODES[label] * SPAN) + (key if isinstance(key, Column) else F.lit(key))).cast("long")


def _typed(df: DataFrame, skip: tuple[str, ...] = ()) -> tuple[list[Column], dict[str, str]]:
    kinds = {f.name: kind_of_type(f.dataType) for f in df.schema.fields if f.name not in skip}
    kinds = {n: k for n, k in kinds.items() if k}
    return [(F.col(n).cast("long") if k == "int" else F.col(n)).alias(f"p_{n}") for n, k in kinds.items()], kinds


def load(spark: SparkSession, folder: str) -> PropertyGraph:
    """Nodes: the six entity tables. Edges: their foreign keys; (order, part) by line, with the line's properties.

    An edge's id is its label's code times EDGE_SPAN plus what its table's key gives: the row's own key, of a line its
    order and place among the order's lines in the order of all columns (lines have no unique key), of SUPPLIED_BY its part
    and supplier. They are the same whatever files the tables are cut into. Places are only computed where ids are asked for.
    """
    read = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nodes = []
    for label, (name, key) in _NODES.items():
        columns, kinds = _typed(read[name])
        nodes.append(Table(read[name].select(node_id(label, F.col(key)).alias("id"), *columns), label, kinds))

    def edge(df: DataFrame, code: int, label: str, key: Column, src: tuple[str, str], dst: tuple[str, str], weight: Column, props: bool = False) -> Table:
        columns, kinds = _typed(df, ("o_orderdate", "place")) if props else ([], {})
        least = CODES[src[0]] * SPAN
        ends = [node_id(of, F.col(c)).alias(n) for (of, c), n in ((src, "src"), (dst, "dst"))]
        return Table(df.select((F.lit(code * EDGE_SPAN) + key.cast("long")).alias("id"), *ends, weight.cast("double").alias("weight"), *columns), label, kinds, src_range=(least, least + SPAN - 1))

    c, one = F.col, F.lit(1.0)
    lines = read["lineitem"].withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *[x for x in read["lineitem"].columns if x not in ("l_orderkey", "l_linenumber")])))
    pairs = read["lineitem"].select("l_partkey", "l_suppkey").distinct()
    supplier = F.when((c("l_suppkey") >= 0) & (c("l_suppkey") < KEYS), c("l_suppkey")).otherwise(F.raise_error(F.lit(f"supplier keys go up to {KEYS}")).cast("long"))
    edges = [
        edge(read["nation"], 0, "IN_REGION", c("n_nationkey"), ("Nation", "n_nationkey"), ("Region", "n_regionkey"), one),
        edge(read["customer"], 1, "LIVES_IN", c("c_custkey"), ("Customer", "c_custkey"), ("Nation", "c_nationkey"), one),
        edge(read["supplier"], 2, "BASED_IN", c("s_suppkey"), ("Supplier", "s_suppkey"), ("Nation", "s_nationkey"), one),
        edge(read["orders"], 3, "PLACED", c("o_orderkey"), ("Customer", "o_custkey"), ("Order", "o_orderkey"), c("o_totalprice")),
        edge(lines, 4, "CONTAINS", c("l_orderkey") * LINES + c("place"), ("Order", "l_orderkey"), ("Part", "l_partkey"), c("l_extendedprice"), props=True),
        edge(pairs, 5, "SUPPLIED_BY", c("l_partkey") * KEYS + supplier, ("Part", "l_partkey"), ("Supplier", "l_suppkey"), one),
    ]
    return PropertyGraph(spark, nodes, edges)


def with_reverse(graph: PropertyGraph) -> PropertyGraph:
    """Every edge both ways: a graph with cycles. The way back has the id -1 - id."""
    back = [Table(t.df.select((-1 - F.col("id")).alias("id"), F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in t.df.columns if c not in ("id", "src", "dst")]), f"{t.label}_BACK" if t.label else None, t.props) for t in graph.edge_tables]
    return PropertyGraph(graph.spark, graph.node_tables, [*graph.edge_tables, *back])
