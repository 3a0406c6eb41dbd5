"""Commands of an interactive session, and scripts of them: ``python -m quillgraph.repl FOLDER`` or ``HOST:PORT``."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from quillgraph.errors import GraphError
from quillgraph.operators import statistics
from quillgraph.plans.languages import LANGUAGES, language_switch, split_prefix
from quillgraph.plans.planner import describe
from quillgraph.server import Client
from quillgraph.session import LoggedGraph
from quillgraph.sources.generators import CITIES, RAIL

#: Lines that are remembered, and that :history shows.
REMEMBERED, SHOWN = 100, 20
TOP_LABELS = 20
_HELP = {
    "queries": 'MATCH NODE [WHERE ...]   MATCH EDGE [WHERE ...]   GET NODE N0   GET EDGE E0\nTRAVERSE BFS|DFS FROM N0   PATH FROM N0 TO N4   COUNT NODES|EDGES\nConditions: label = "City"   props.population > 1000000   weight < 500, joined by AND',
    "cypher": "MATCH (n:City) WHERE n.population > 1000000 RETURN n\nMATCH (a)-[r:RAIL]->(b) WHERE r.weight < 500 RETURN r",
    "commands": ":use|:lang simple|cypher   :nodes   :edges   :labels   :schema   :stats   :compact   :seed   :time [on|off]   :limit [n]\n:explain QUERY   :history   :run FILE   :clear   :help [topic]   :quit",
}


class Quit(Exception):
    """The session is over."""


def _folded(line: str) -> tuple[str, str]:
    word, _, rest = line.partition(" ")
    return word.lower(), rest.strip()


class Repl:
    """Answers lines with texts."""

    def __init__(self, graph: LoggedGraph) -> None:
        self.graph = graph
        self.language, self.timing, self.limit = "simple", False, 50
        self.history: list[str] = []
        self._commands: dict[str, Callable[[str], str]] = {
            ":use": self._language, ":lang": self._language, ":nodes": lambda _: f"Nodes: {self.graph.graph.node_ids().count()}", ":edges": lambda _: f"Edges: {self.graph.graph.links().count()}",
            ":labels": self._labels, ":schema": self._schema, ":stats": lambda _: str(self.graph.metrics), ":metrics": lambda _: str(self.graph.metrics), ":compact": self._compact, ":seed": self._seed, ":time": self._time,
            ":limit": self._limit, ":explain": self._explain, ":history": self._history, ":run": self._run, ":clear": lambda _: "\x1b[2J\x1b[H", ":cls": lambda _: "\x1b[2J\x1b[H", ":help": self._help,
        }

    @property
    def prompt(self) -> str:
        return f"quillgraph ({self.language})> "

    def handle(self, line: str) -> str:
        """The answer to a line; raises Quit at the end. Errors of queries are answers."""
        line = line.strip()
        if not line or line.startswith("#"):
            return ""
        self.history = [*self.history, line][-REMEMBERED:]
        word, rest = _folded(line)
        if word in (":quit", ":exit"):
            raise Quit
        try:
            if word.startswith(":"):
                return self._commands[word](rest) if word in self._commands else f"Unknown command {word}; :help lists them"
            began = time.perf_counter()
            name, text = split_prefix(line, self.language)
            answer = self.graph.execute(text, name, self.limit)
            return f"{answer}\n({(time.perf_counter() - began) * 1000:.1f} ms)" if self.timing else answer
        except GraphError as e:
            return f"Error: {e}"

    def script(self, path: str) -> Iterator[str]:
        """Runs the lines of a file, passing over blank ones and those that begin with #; ends early at :quit."""
        n = 0
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            if line.strip() and not line.strip().startswith("#"):
                yield f"{self.prompt}{line.strip()}"
                try:
                    answer = self.handle(line)
                except Quit:
                    break
                n += 1
                if answer:
                    yield answer
        yield f"({n} commands of {path})"

    def _language(self, rest: str) -> str:
        if rest:
            other = language_switch(f":use {rest}")
            if other is None:
                return f"Unknown language {rest}; there are {', '.join(LANGUAGES)}"
            self.language = other
        return f"Language: {self.language}"

    def _label_rows(self, most: int | None = None) -> list[str]:
        rows = statistics.label_stats(self.graph.graph)
        return [f"  {r.label:<30}  {r.n:>10}" for r in (rows.limit(most) if most else rows).collect()]

    def _labels(self, _: str) -> str:
        return "\n".join(self._label_rows()) or "(no nodes)"

    def _schema(self, _: str) -> str:
        stats = self.graph.statistics()
        fields = [f"  {f}" for f in stats.fields]
        return "\n".join([f"Nodes: {stats.nodes}  Edges: {stats.edges}", f"Labels ({len(stats.labels)}):", *self._label_rows(TOP_LABELS), f"Indexed property fields ({len(fields)}):", *fields, f"Size: {self.graph.wal_size_bytes()} bytes"])

    def _compact(self, _: str) -> str:
        self.graph.compact()
        return f"Compacted; the size is now {self.graph.wal_size_bytes()} bytes"

    def _seed(self, _: str) -> str:
        if not self.graph.graph.node_ids().isEmpty():
            return "The graph isn't empty; nothing was added"
        txn = self.graph.begin_transaction()
        ids = [txn.insert_node("City", {"name": n, "population": p, "country": c, "coastal": s}) for n, p, c, s in CITIES]
        for a, b, km in RAIL:
            txn.insert_edge(ids[a], ids[b], "RAIL", float(km))
        done = self.graph.commit_transaction(txn)
        return f"Added {len(done.nodes)} nodes and {len(done.edges)} edges"

    def _time(self, rest: str) -> str:
        if rest.lower() in ("on", "off"):
            self.timing = rest.lower() == "on"
        return f"Timing: {'on' if self.timing else 'off'}"

    def _limit(self, rest: str) -> str:
        if rest:
            if not rest.isdecimal():
                return "Usage: :limit NUMBER, 0 for no limit"
            self.limit = int(rest)
        return f"Result limit: {self.limit or 'unlimited'}"

    def _explain(self, rest: str) -> str:
        name, text = split_prefix(rest, self.language)
        return f"Plan: {describe(self.graph.languages[name].parse(text), self.graph.statistics())}"

    def _history(self, _: str) -> str:
        first = max(0, len(self.history) - SHOWN)
        return "\n".join(f"  {k:3}  {line}" for k, line in enumerate(self.history[first:], first + 1))

    def _run(self, rest: str) -> str:
        try:
            return "\n".join(self.script(rest))
        except OSError as e:
            return f"Can't read {rest}: {e.strerror}"

    def _help(self, rest: str) -> str:
        return _HELP.get(rest.lower(), f"Topics: {', '.join(_HELP)}") if rest else "\n\n".join(_HELP.values())


class Remote:
    """The same of a server: queries go there, the language is kept here."""

    def __init__(self, client: Client) -> None:
        self.client, self.language = client, "simple"

    @property
    def prompt(self) -> str:
        return f"quillgraph remote ({self.language})> "

    def handle(self, line: str) -> str:
        line = line.strip()
        if not line or line.startswith("#"):
            return ""
        word, rest = _folded(line)
        if word in (":quit", ":exit"):
            self.client.send(":quit")
            raise Quit
        if word in (":use", ":lang"):
            self.language = language_switch(line) or self.language
            return f"Language: {self.language}"
        if word == ":help":
            return "\n\n".join(_HELP.values())
        if word.startswith(":"):
            return f"{word} isn't known to servers"
        name, text = split_prefix(line, self.language)
        good, answer = self.client.send(f"{name}:{text}")
        return answer if good else f"Error: {answer}"


def main(arguments: list[str]) -> None:
    where = arguments[0] if arguments else "graph"
    host, _, port = where.rpartition(":")
    if host and port.isdecimal():
        session: Repl | Remote = Remote(Client((host, int(port))))
    else:
        from pyspark.sql import SparkSession

        session = Repl(LoggedGraph.open(SparkSession.builder.getOrCreate(), where))
    while True:
        try:
            answer = session.handle(input(session.prompt))
        except (EOFError, Quit):
            break
        if answer:
            print(answer)


if __name__ == "__main__":
    main(sys.argv[1:])
