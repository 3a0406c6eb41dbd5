"""One graph for many threads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quillgraph.functions.compare import Literal
from quillgraph.session import LoggedGraph, Metrics


class SharedGraph:
    """Handles on one :class:`LoggedGraph`. Changes take turns; queries run side by side, each on the graph as it was when
    the query began, as Spark sessions take jobs from any thread."""

    def __init__(self, graph: LoggedGraph) -> None:
        self.graph = graph

    def clone_handle(self) -> SharedGraph:
        return SharedGraph(self.graph)

    def locked(self):
        """The graph's lock, for several steps that must not be parted: ``with shared.locked(): ...``"""
        return self.graph.lock

    def query(self, text: str, language: str = "simple") -> DataFrame:
        return self.graph.query(text, language)

    def execute(self, text: str, language: str = "simple", limit: int = 50) -> str:
        return self.graph.execute(text, language, limit)

    def insert_node(self, label: str, properties: dict[str, Literal] | None = None) -> int:
        return self.graph.insert_node(label, properties)

    def insert_edge(self, src: int, dst: int, label: str, weight: float = 1.0, properties: dict[str, Literal] | None = None) -> int:
        return self.graph.insert_edge(src, dst, label, weight, properties)

    def get_node(self, node: int):
        return self.graph.get_node(node)

    def node_count(self) -> int:
        return self.graph.graph.node_ids().count()

    def edge_count(self) -> int:
        return self.graph.graph.links().count()

    def metrics(self) -> Metrics:
        """The counters as they are now."""
        with self.graph.lock:
            return Metrics(**vars(self.graph.metrics))

    def compact(self) -> None:
        self.graph.compact()
