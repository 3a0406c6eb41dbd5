"""The property graph: nodes and edges as DataFrames, and how their values are written.

A graph holds tables of nodes and of edges. A table either has one label and typed property columns, so that filters
and column pruning reach the files, or many labels and a map of tagged values. Both answer every query alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.compare import Literal, kind_of

VALUE = "struct<t:string,b:boolean,i:bigint,d:double,s:string>"
NODES = f"id long, label string, properties map<string,{VALUE}>"
EDGES = f"id long, src long, dst long, label string, weight double, properties map<string,{VALUE}>"
_FIELD = {"bool": "b", "int": "i", "float": "d", "text": "s"}


def tagged(value: Literal) -> tuple:
    """A Python value as a tagged row."""
    kind = kind_of(value)
    row = {"t": kind, "b": None, "i": None, "d": None, "s": None}
    if kind != "null":
        row[_FIELD[kind]] = value
    return tuple(row.values())


def untagged(value) -> Literal:
    return None if value is None or value["t"] == "null" else value[_FIELD[value["t"]]]


def tagged_column(column: Column, kind: str) -> Column:
    """A typed column as tagged values; null, a missing key, where it is null."""
    types = {"b": "boolean", "i": "bigint", "d": "double", "s": "string"}
    value = F.struct(F.lit(kind).alias("t"), *((column if _FIELD[kind] == k else F.lit(None)).cast(t).alias(k) for k, t in types.items()))
    return F.when(column.isNotNull(), value)


def kind_of_type(of: T.DataType) -> str | None:
    if isinstance(of, T.BooleanType):
        return "bool"
    if isinstance(of, T.IntegralType):
        return "int"
    if isinstance(of, (T.FloatType, T.DoubleType)):
        return "float"
    return "text" if isinstance(of, T.StringType) else None


@dataclass(frozen=True)
class Table:
    """Rows of nodes (id) or edges (id, src, dst, weight); ``label`` and typed columns ``props``, or label and properties columns."""

    df: DataFrame
    label: str | None = None
    #: property name -> kind, for columns p_<name>
    props: dict[str, str] = field(default_factory=dict)
    #: for a table of many labels: property name -> (column, kind) of typed copies of its values; whether these are all names
    typed: dict[str, list[tuple[str, str]]] = field(default_factory=dict)
    complete: bool = False
    #: column by which files are laid out, with the label behind a mark
    label_folder: str | None = None
    #: the least and the largest id that edges begin at, if known
    src_range: tuple[int, int] | None = None

    def general(self, edges: bool) -> DataFrame:
        keys = ["id", "src", "dst"] if edges else ["id"]
        label = F.col("label") if self.label is None else F.lit(self.label).alias("label")
        if self.label is None:
            properties = F.col("properties")
        elif self.props:
            properties = F.map_filter(F.create_map(*(x for name, kind in self.props.items() for x in (F.lit(name), tagged_column(F.col(f"p_{name}"), kind)))), lambda _, v: v.isNotNull()).alias("properties")
        else:
            properties = F.lit(None).cast(f"map<string,{VALUE}>").alias("properties")
        return self.df.select(*keys, label, *(["weight"] if edges else []), properties)


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    node_tables: list[Table]
    edge_tables: list[Table]

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """From DataFrames of the schemas NODES and EDGES."""
        return PropertyGraph(nodes.sparkSession, [Table(nodes)], [Table(edges)])

    @staticmethod
    def local(spark: SparkSession, nodes: list[tuple], edges: list[tuple]) -> PropertyGraph:
        """From Python rows (id, label, {name: value}) and (id, src, dst, label, weight, {name: value})."""
        n = [(i, label, {k: tagged(v) for k, v in p.items()}) for i, label, p in nodes]
        e = [(i, s, d, label, float(w), {k: tagged(v) for k, v in p.items()}) for i, s, d, label, w, p in edges]
        return PropertyGraph.of(spark.createDataFrame(n, NODES), spark.createDataFrame(e, EDGES))

    def nodes(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (t.general(False) for t in self.node_tables))

    def edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (t.general(True) for t in self.edge_tables))

    def node_ids(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (t.df.select("id") for t in self.node_tables))

    def links(self) -> DataFrame:
        """The structure alone: id, src, dst, weight."""
        return reduce(DataFrame.unionByName, (t.df.select("id", "src", "dst", "weight") for t in self.edge_tables))

    def label_column(self, nodes: bool = True) -> DataFrame:
        """(label) of every node, or edge."""
        tables = self.node_tables if nodes else self.edge_tables
        return reduce(DataFrame.unionByName, (t.df.select(F.col("label") if t.label is None else F.lit(t.label).alias("label")) for t in tables))


def show_value(value: Literal) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    return f'"{value}"' if isinstance(value, str) else str(int(value)) if isinstance(value, float) and value.is_integer() and abs(value) < 1e16 else str(value)


def show_node(row) -> str:
    props = {k: untagged(v) for k, v in sorted((row["properties"] or {}).items())}
    inside = "{" + ", ".join(f"{k}: {show_value(v)}" for k, v in props.items()) + "}"
    return f"(N{row['id']} :{row['label']})" + (f" {inside}" if props else "")


def show_edge(row) -> str:
    return f"(N{row['src']}) -[E{row['id']} :{row['label']}]-> (N{row['dst']})"
