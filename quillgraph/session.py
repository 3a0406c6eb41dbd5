"""A graph that lives in a change log: queries, changes, transactions, compaction, metrics."""

from __future__ import annotations

import itertools
import sys
import threading
import time
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.errors import GraphError, NodeNotFound, ScanTooLarge
from quillgraph.functions.compare import Literal
from quillgraph.model import PropertyGraph, Table, show_edge, show_node
from quillgraph.operators import statistics
from quillgraph.operators.rounds import saved
from quillgraph.plans.commands import CountEdges, CountNodes, GetEdge, GetNode, MatchEdges, MatchNodes, ShortestPath, Traverse
from quillgraph.plans.languages import LANGUAGES, Language, split_prefix
from quillgraph.plans.planner import GraphStatistics, build, describe, estimated_rows, prunes
from quillgraph.sources import change_log
from quillgraph.sources.cache import Cache, LruCache, NoCache
from quillgraph.sources.storage import FileStorage, Storage

#: Changes since the log was read that are held as Python rows; more are put with the log's.
MAX_PENDING = 5_000
#: Ids of nodes known to live that insert_edge needn't look up.
MAX_KNOWN = 100_000


@dataclass
class Config:
    auto_compact_after_writes: int = 10_000
    #: A match that would read more rows raises; None: no guard.
    max_full_scan_nodes: int | None = None
    slow_query_warn_ms: float = 100.0
    form: str = "json"  # or binary
    #: Nodes and edges kept between point lookups; 0: none.
    cache_nodes: int = 4096
    cache_edges: int = 8192
    #: Property names that plan descriptions treat as indexed: None for all, a list for some.
    indexed_node_fields: list[str] | None = None


@dataclass
class Metrics:
    nodes_inserted: int = 0
    nodes_deleted: int = 0
    edges_inserted: int = 0
    edges_deleted: int = 0
    #: of the cache of point lookups
    node_hits: int = 0
    node_misses: int = 0
    edge_hits: int = 0
    edge_misses: int = 0
    queries: int = 0
    slow_queries: int = 0
    query_ms: float = 0.0
    index_scans: int = 0
    full_scans: int = 0
    transactions_committed: int = 0
    transactions_rolled_back: int = 0
    compactions: int = 0
    writes: int = 0

    @staticmethod
    def _share(a: float, b: float) -> float:
        return a / (a + b) if a + b else 0.0

    def node_hit_rate(self) -> float:
        return self._share(self.node_hits, self.node_misses)

    def edge_hit_rate(self) -> float:
        return self._share(self.edge_hits, self.edge_misses)

    def index_hit_rate(self) -> float:
        return self._share(self.index_scans, self.full_scans)

    def average_ms(self) -> float:
        return self.query_ms / self.queries if self.queries else 0.0

    def __str__(self) -> str:
        return "\n".join(f"{f.name}: {getattr(self, f.name)}" for f in fields(self))


_NUMBERS = itertools.count(1)


class Transaction:
    """Changes staged in order. Ids are taken from the graph's own counters, so that none is given twice, and stay taken
    after a rollback."""

    def __init__(self, graph: LoggedGraph) -> None:
        self._graph, self.id, self.changes, self.open = graph, next(_NUMBERS), [], True

    def insert_node(self, label: str, properties: dict[str, Literal] | None = None) -> int:
        i = self._graph._take("node")
        self.changes.append(("upsert_node", i, None, None, label, None, properties or {}))
        return i

    def insert_edge(self, src: int, dst: int, label: str, weight: float = 1.0, properties: dict[str, Literal] | None = None) -> int:
        i = self._graph._take("edge")
        self.changes.append(("upsert_edge", i, src, dst, label, float(weight), properties or {}))
        return i

    def delete_node(self, node: int) -> None:
        self.changes.append(("delete_node", node, None, None, None, None, {}))

    def delete_edge(self, edge: int) -> None:
        self.changes.append(("delete_edge", edge, None, None, None, None, {}))

    def operation_count(self) -> int:
        return len(self.changes)

    def is_empty(self) -> bool:
        return not self.changes


@dataclass
class CommitResult:
    transaction: int
    nodes: list[int] = field(default_factory=list)
    edges: list[int] = field(default_factory=list)
    deleted: int = 0


class LoggedGraph:
    """A property graph in a folder ``path``, or in another :class:`Storage`. A batch of changes is there whole or not at
    all, so a commit is atomic; batches, not single changes, are the way to load data.

    The log is read when the graph is opened; later changes are laid over it without reading it again. Threads may share
    a graph: changes take turns, and a query runs on the graph as it was when it began.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str | None = None,
        config: Config | None = None,
        languages: dict[str, Language] | None = None,
        algorithms: dict[str, object] | None = None,
        storage: Storage | None = None,
        cache: Cache | None = None,
    ) -> None:
        self.spark, self.config = spark, config or Config()
        if storage is None and path is None:
            raise GraphError("a graph needs a path or a storage")
        self.storage = storage or FileStorage(spark, path, self.config.form)
        self.languages, self.algorithms = dict(languages or LANGUAGES), dict(algorithms or {})
        both = self.config.cache_nodes and self.config.cache_edges
        self.cache: Cache = cache or (LruCache(self.config.cache_nodes, self.config.cache_edges) if both else NoCache())
        self.metrics = Metrics()
        self.lock = threading.RLock()
        self._writes = 0
        self._read()
        self._next = self.storage.next_ids()
        if self._log is not None:
            # ids of deleted records aren't used again
            for r in self._log.groupBy(F.col("op").endswith("_node").alias("is_node")).agg(F.max(F.when(F.col("op").startswith("upsert"), F.col("id"))).alias("u")).collect():
                kind = "node" if r.is_node else "edge"
                self._next[kind] = max(self._next[kind], (r.u if r.u is not None else -1) + 1)

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: Config | None = None) -> LoggedGraph:
        return cls(spark, path, config)

    def _read(self) -> None:
        """Takes tables and log from the storage; nothing is pending then."""
        self._tables = self.storage.tables()
        log = self.storage.changes()
        self._log = None if log is None else saved(log)
        self._logged = 0 if log is None else self._log.count()
        self._pending: list[tuple] = []
        #: node -> whether it lives, of those that pending changes touch, and of some others
        self._known: dict[int, bool] = {}
        self._graph: PropertyGraph | None = None
        self._stats: GraphStatistics | None = None
        self.cache.clear()

    def _append(self, changes: list[tuple], transaction: int | None = None) -> None:
        self.storage.append(changes, transaction)
        for op, i, *_ in changes:
            kind = op.rpartition("_")[2]
            self.cache.drop(kind, i)
            if kind == "node":
                self._known[i] = op.startswith("upsert")
                if not self._known[i]:
                    self.cache.clear()  # its edges go too
        if len(self._known) > MAX_KNOWN:
            self._known.clear()
        self._pending += changes
        self._graph = self._stats = None
        self._writes += len(changes)
        self.metrics.writes += len(changes)
        if 0 < self.config.auto_compact_after_writes <= self._writes:
            try:
                self.compact()
            except Exception as e:  # a failed compaction leaves the log as it was
                print(f"auto-compaction failed: {e}", file=sys.stderr)

    def _take(self, kind: str) -> int:
        with self.lock:
            self._next[kind] += 1
            return self._next[kind] - 1

    # -- reading

    @property
    def graph(self) -> PropertyGraph:
        """The live graph: the tables, with the log and pending changes laid over them."""
        with self.lock:
            if self._graph is None:
                if self._pending:
                    rows = change_log.rows_of(self.spark, self._pending, "~", self._logged)
                    every = rows if self._log is None else self._log.unionByName(rows)
                    if len(self._pending) > MAX_PENDING:
                        # places grow from the log's on, so that the order stays when they are put with it
                        every = self._log = saved(every)
                        self._logged += len(self._pending)
                        self._pending = []
                else:
                    every = self._log
                nodes, edges = self._tables
                if every is not None:
                    nodes, edges = change_log.overlay(nodes, edges, every, self._logged + len(self._pending))
                    # what the log itself gives is small or soon compacted; the tables keep their layout
                    nodes, edges = ([*t[:-1], Table(saved(t[-1].df))] for t in (nodes, edges))
                empty = PropertyGraph.local(self.spark, [], [])
                self._graph = PropertyGraph(self.spark, nodes or empty.node_tables, edges or empty.edge_tables)
            return self._graph

    def statistics(self) -> GraphStatistics:
        with self.lock:
            if self._stats is None:
                g = self.graph
                labels = {r.label: r.n for r in statistics.label_stats(g).collect()}
                names = [r.key for r in statistics.property_keys(g).collect()]
                if self.config.indexed_node_fields is not None:
                    names = [n for n in names if n in self.config.indexed_node_fields]
                self._stats = GraphStatistics(sum(labels.values()), g.links().count(), labels, names)
            return self._stats

    def _lookup(self, kind: str, key: int):
        """A record by id, from the cache or else from the graph."""
        with self.lock:
            row, graph = self.cache.get(kind, key), self.graph
            name = f"{kind}_{'misses' if row is None else 'hits'}"
            setattr(self.metrics, name, getattr(self.metrics, name) + 1)
        if row is None:
            row = (graph.nodes() if kind == "node" else graph.edges()).where(F.col("id") == key).first()
            if row is not None:
                with self.lock:
                    if self._graph is graph:
                        self.cache.put(kind, key, row)
        return row

    def get_node(self, node: int):
        return self._lookup("node", node)

    def get_edge(self, edge: int):
        return self._lookup("edge", edge)

    def query(self, text: str, language: str = "simple") -> DataFrame:
        """The DataFrame of a query; a simple: or cypher: prefix overrides ``language``."""
        began = time.perf_counter()
        language, text = split_prefix(text, language)
        command = self.languages[language].parse(text)
        if self.config.max_full_scan_nodes is not None and (n := estimated_rows(command, self.statistics())) > self.config.max_full_scan_nodes:
            raise ScanTooLarge(f"the query reads about {n} rows; the limit is {self.config.max_full_scan_nodes}")
        graph = self.graph
        out = build(graph, command, self.algorithms)
        if isinstance(command, (MatchNodes, MatchEdges)):
            # an index scan passes over files or row groups of every table but what the log itself gives
            tables = [t for t in (graph.node_tables if isinstance(command, MatchNodes) else graph.edge_tables) if t.label or t.label_folder]
            pruned = bool(tables) and any(all(prunes(t, c) for t in tables) for c in command.conditions)
            self._count("index_scans" if pruned else "full_scans")
        self._timed(text, began)
        return out

    def execute(self, text: str, language: str = "simple", limit: int = 50) -> str:
        """The result as text, at most ``limit`` rows of it (0: all)."""
        began = time.perf_counter()
        name, body = split_prefix(text, language)
        command, df = self.languages[name].parse(body), self.query(text, language)
        rows = (df.limit(limit) if limit and not isinstance(command, (Traverse, ShortestPath)) else df).collect()
        self._timed(text, began, count=False)
        return render(command, rows)

    def _count(self, name: str, by: float = 1) -> None:
        with self.lock:
            setattr(self.metrics, name, getattr(self.metrics, name) + by)

    def _timed(self, text: str, began: float, count: bool = True) -> None:
        ms = (time.perf_counter() - began) * 1000
        self._count("queries", int(count))
        self._count("query_ms", ms)
        if ms >= self.config.slow_query_warn_ms:
            self._count("slow_queries")
            print(f"slow query ({ms:.0f} ms): {text}", file=sys.stderr)

    def explain(self, text: str, language: str = "simple") -> str:
        """The plan as described, and as Spark runs it."""
        name, body = split_prefix(text, language)
        command = self.languages[name].parse(body)
        df = build(self.graph, command, self.algorithms)
        return f"{describe(command, self.statistics())}\n{df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString('formatted'))}"

    def traverse(self, start: int, algorithm="BFS") -> DataFrame:
        """(pos, node_id) by a traversal of that name or a user's own :class:`TraversalAlgorithm`."""
        return build(self.graph, Traverse("own", start), {"own": algorithm}) if not isinstance(algorithm, str) else build(self.graph, Traverse(algorithm, start), self.algorithms)

    def find_shortest_path(self, start: int, goal: int, algorithm=None) -> DataFrame:
        """(pos, node_id, dist) by the graph's algorithm or a user's own :class:`ShortestPathAlgorithm`."""
        return build(self.graph, ShortestPath(start, goal), self.algorithms if algorithm is None else {"PATH": algorithm})

    # -- changes

    def _has(self, node: int) -> bool:
        if node not in self._known:
            self._known[node] = not self.graph.node_ids().where(F.col("id") == node).isEmpty()
        return self._known[node]

    def insert_node(self, label: str, properties: dict[str, Literal] | None = None) -> int:
        with self.lock:
            i = self._take("node")
            self._append([("upsert_node", i, None, None, label, None, properties or {})])
            self.metrics.nodes_inserted += 1
            return i

    def insert_edge(self, src: int, dst: int, label: str, weight: float = 1.0, properties: dict[str, Literal] | None = None) -> int:
        with self.lock:
            for node in (src, dst):
                if not self._has(node):
                    raise NodeNotFound(node)
            i = self._take("edge")
            self._append([("upsert_edge", i, src, dst, label, float(weight), properties or {})])
            self.metrics.edges_inserted += 1
            return i

    def delete_node(self, node: int) -> None:
        """Its edges go too. A node that isn't there is no error."""
        with self.lock:
            self._append([("delete_node", node, None, None, None, None, {})])
            self.metrics.nodes_deleted += 1

    def delete_edge(self, edge: int) -> None:
        with self.lock:
            self._append([("delete_edge", edge, None, None, None, None, {})])
            self.metrics.edges_deleted += 1

    def begin_transaction(self) -> Transaction:
        return Transaction(self)

    def commit_transaction(self, txn: Transaction) -> CommitResult:
        """All of it or, if an edge's end is missing, nothing."""
        with self.lock:
            if not txn.open:
                raise GraphError(f"transaction {txn.id} has ended")
            # the ends of edges that live outside the transaction, looked up in one go
            ends = {e for c in txn.changes if c[0] == "upsert_edge" for e in (c[2], c[3])} - {c[1] for c in txn.changes if c[0] == "upsert_node"}
            asked = sorted(ends - self._known.keys())
            if asked:
                there = {r.id for r in self.graph.node_ids().where(F.col("id").isin(asked)).collect()}
                self._known.update((e, e in there) for e in asked)
            staged: set[int] = set()
            gone: set[int] = set()
            for c in txn.changes:
                if c[0] == "upsert_node":
                    staged.add(c[1])
                elif c[0] == "delete_node":
                    gone.add(c[1])
                    staged.discard(c[1])
                elif c[0] == "upsert_edge":
                    for end in (c[2], c[3]):
                        if not (end in staged or (end not in gone and self._known.get(end, False))):
                            self.rollback_transaction(txn)
                            raise NodeNotFound(end)
            txn.open = False
            if txn.changes:
                self._append(txn.changes, txn.id)
            kinds = [c[0] for c in txn.changes]
            self.metrics.nodes_inserted += kinds.count("upsert_node")
            self.metrics.edges_inserted += kinds.count("upsert_edge")
            self.metrics.nodes_deleted += kinds.count("delete_node")
            self.metrics.edges_deleted += kinds.count("delete_edge")
            self.metrics.transactions_committed += 1
            return CommitResult(txn.id, [c[1] for c in txn.changes if c[0] == "upsert_node"], [c[1] for c in txn.changes if c[0] == "upsert_edge"], sum(k.startswith("delete") for k in kinds))

    def rollback_transaction(self, txn: Transaction) -> None:
        with self.lock:
            txn.changes, txn.open = [], False
            self.metrics.transactions_rolled_back += 1

    def compact(self) -> None:
        """Writes the live graph as tables, by the executors, and goes on with an empty log."""
        with self.lock:
            g = self.graph
            self.storage.compact(g.nodes(), g.edges(), dict(self._next))
            self._read()
            self._writes = 0
            self.metrics.compactions += 1

    def wal_size_bytes(self) -> int:
        return self.storage.size()

    def reset_metrics(self) -> None:
        with self.lock:
            self.metrics = Metrics()


def cardinality(command, df: DataFrame) -> int:
    """Records that a command's result has: of a count the number counted, else its rows."""
    return df.first()["count"] if isinstance(command, (CountNodes, CountEdges)) else df.count()


def render(command, rows: list) -> str:
    """Rows of a command's result as text."""
    if isinstance(command, (CountNodes, CountEdges)):
        return f"Count: {rows[0]['count']}"
    if isinstance(command, GetNode):
        return show_node(rows[0]) if rows else "(not found)"
    if isinstance(command, GetEdge):
        return show_edge(rows[0]) if rows else "(not found)"
    if isinstance(command, Traverse):
        ids = [f"N{r['node_id']}" for r in sorted(rows, key=lambda r: r["pos"])]
        return f"Traversal [{len(ids)}]: " + " → ".join(ids)
    if isinstance(command, ShortestPath):
        steps = sorted(rows, key=lambda r: r["pos"])
        return f"Path ({steps[-1]['dist']:.2f}): " + " → ".join(f"N{r['node_id']}" for r in steps) if steps else "(empty)"
    what, show = ("Nodes", show_node) if isinstance(command, MatchNodes) else ("Edges", show_edge)
    return f"{what} ({len(rows)}):" + "".join(f"\n  {show(r)}" for r in rows)
