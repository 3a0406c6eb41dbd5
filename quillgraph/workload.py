"""The synthetic workload: loading, timed queries, threads at once, and reports, as figures and as text."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from quillgraph.errors import GraphError
from quillgraph.operators import statistics
from quillgraph.session import LoggedGraph, cardinality
from quillgraph.shared import SharedGraph
from quillgraph.sources.generators import synthetic

# Fixed values of the workload: what is timed, what threads ask, and the ways of reading that are compared.
QUERIES = [
    'MATCH NODE WHERE label = "City"', 'MATCH NODE WHERE label = "Person"', "MATCH NODE WHERE props.population > 5000000", 'MATCH NODE WHERE label = "Person" AND props.age > 30', "MATCH NODE WHERE props.coastal = true",
    "GET NODE N0", "GET NODE N0", "COUNT NODES", "COUNT EDGES", "TRAVERSE BFS FROM N0", "PATH FROM N0 TO N99",
]
MIX = ['MATCH NODE WHERE label = "City"', "MATCH NODE WHERE props.population > 5000000", "COUNT NODES", "COUNT EDGES", "GET NODE N0", "TRAVERSE BFS FROM N0"]
SCANS = {"count": "COUNT NODES", "label": 'MATCH NODE WHERE label = "City"', "property": "MATCH NODE WHERE props.population > 5000000", "all": "MATCH NODE"}


@dataclass
class Timing:
    query: str
    results: int
    seconds: list[float]

    @property
    def least(self) -> float:
        return min(self.seconds, default=0.0)

    @property
    def average(self) -> float:
        return sum(self.seconds) / len(self.seconds) if self.seconds else 0.0

    @property
    def most(self) -> float:
        return max(self.seconds, default=0.0)

    def __str__(self) -> str:
        return f"{self.query:<60} min {self.least * 1000:9.1f} ms  avg {self.average * 1000:9.1f} ms  max {self.most * 1000:9.1f} ms  | {self.results} result(s)"


def load(graph: LoggedGraph, cities: int = 10_000, people: int = 50_000) -> None:
    """Puts the synthetic graph into an empty one, by its executors: as tables of a first compaction."""
    if not graph.graph.node_ids().isEmpty():
        raise GraphError("the graph isn't empty")
    made = synthetic(graph.spark, cities, people)
    graph.storage.compact(made.nodes(), made.edges(), {"node": cities + people, "edge": 3 * people})
    with graph.lock:
        graph._read()
        graph._next = graph.storage.next_ids()


def timed(graph: LoggedGraph, query: str, runs: int = 3, language: str = "simple") -> Timing:
    """Seconds of whole runs of a query, whose results are read; how many records it gives."""
    command = graph.languages[language].parse(query)
    seconds, n = [], 0
    for _ in range(runs):
        began = time.perf_counter()
        n = cardinality(command, graph.query(query, language))
        seconds.append(time.perf_counter() - began)
    return Timing(query, n, seconds)


@dataclass
class Load:
    asked: int
    answered: int
    seconds: float

    @property
    def rate(self) -> float:
        return self.answered / self.seconds if self.seconds else 0.0


def concurrently(shared: SharedGraph, threads: int = 8, each: int = 500, queries: list[str] = MIX) -> Load:
    """Each thread asks ``each`` queries in turn, beginning with another one."""

    def one(t: int) -> int:
        handle, good = shared.clone_handle(), 0
        for i in range(each):
            try:
                handle.execute(queries[(t + i) % len(queries)])
                good += 1
            except GraphError:
                pass
        return good

    began = time.perf_counter()
    with ThreadPoolExecutor(threads) as pool:
        answered = sum(pool.map(one, range(threads)))
    return Load(threads * each, answered, time.perf_counter() - began)


def compare_scans(graph: LoggedGraph, runs: int = 3) -> dict[str, Timing]:
    """The same graph read by a count, by label, by property, and whole."""
    return {name: timed(graph, query, runs) for name, query in SCANS.items()}


def cache_report(graph: LoggedGraph, nodes: int = 1000) -> dict[str, float]:
    """Looks nodes 0 to ``nodes`` - 1 up twice: seconds, hits and misses of each pass, and the hit rate of both."""
    graph.reset_metrics()
    out: dict[str, float] = {}
    hits = misses = 0
    for name in ("cold", "warm"):
        began = time.perf_counter()
        for i in range(nodes):
            graph.get_node(i)
        out[f"{name}_seconds"] = time.perf_counter() - began
        out[f"{name}_hits"], out[f"{name}_misses"] = graph.metrics.node_hits - hits, graph.metrics.node_misses - misses
        hits, misses = graph.metrics.node_hits, graph.metrics.node_misses
    return out | {"hit_rate": graph.metrics.node_hit_rate()}


def schema_report(graph: LoggedGraph, top: int = 10) -> str:
    stats = graph.statistics()
    labels = [f"  {r.label:<30} {r.n:>10} nodes" for r in statistics.label_stats(graph.graph).limit(top).collect()]
    return "\n".join([f"Nodes: {stats.nodes}  Edges: {stats.edges}", f"Labels (top {top} by count):", *labels, f"Indexed property fields ({len(stats.fields)}):", *(f"  {f}" for f in stats.fields), f"Size: {graph.wal_size_bytes() // 1024} KB"])
