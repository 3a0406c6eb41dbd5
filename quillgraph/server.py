"""Queries over TCP, line by line.

A client sends one query a line, ``simple:`` or ``cypher:`` before it for that language, ``:use`` or ``:lang`` to switch,
``:quit`` or ``:exit`` to end. Every answer, and the greeting, ends with a line of END; before it stand OK or ERR and the text.
"""

from __future__ import annotations

import socket
import socketserver
import threading

from quillgraph.errors import GraphError
from quillgraph.plans.languages import language_switch, split_prefix
from quillgraph.shared import SharedGraph

# Fixed value of the protocol.
END = "---END---"


class _Connection(socketserver.StreamRequestHandler):
    def _say(self, text: str) -> None:
        self.wfile.write(f"{text}\n{END}\n".encode())
        self.wfile.flush()

    def handle(self) -> None:
        language, graph = "simple", self.server.shared.clone_handle()
        self._say("# quillgraph  lang:simple  :quit to disconnect  :use simple|cypher to switch")
        for raw in self.rfile:
            line = raw.decode(errors="replace").strip()
            if not line:
                continue
            if line.lower() in (":quit", ":exit"):
                self._say("OK\nBye!")
                return
            if (other := language_switch(line)) is not None:
                language = other
                self._say(f"OK\nLanguage: {language}")
                continue
            try:
                name, text = split_prefix(line, language)
                answer = f"OK\n{graph.execute(text, name)}"
            except GraphError as e:
                answer = f"ERR\n{e}"
            except Exception as e:  # a query that Spark can't run ends neither the connection nor the server
                answer = f"ERR\n{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            self._say(answer)


class GraphServer(socketserver.ThreadingTCPServer):
    """A thread for each connection. ``with GraphServer(shared, ("127.0.0.1", 0)) as server: server.serve_forever()``"""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self, shared: SharedGraph, address: tuple[str, int]) -> None:
        super().__init__(address, _Connection)
        self.shared = shared

    def start(self) -> threading.Thread:
        """Serves from a thread of its own until :meth:`shutdown`."""
        thread = threading.Thread(target=self.serve_forever, daemon=True)
        thread.start()
        return thread


class Client:
    """A connection to a :class:`GraphServer`."""

    def __init__(self, address: tuple[str, int]) -> None:
        self._socket = socket.create_connection(address)
        self._file = self._socket.makefile("rw", encoding="utf-8", newline="\n")
        self.greeting = self._answer()

    def _answer(self) -> str:
        lines = []
        for line in self._file:
            if line.rstrip("\n") == END:
                return "\n".join(lines)
            lines.append(line.rstrip("\n"))
        raise ConnectionError("the server ended the connection")

    def send(self, line: str) -> tuple[bool, str]:
        """Whether the server says OK, and the text."""
        self._file.write(line.replace("\n", " ") + "\n")
        self._file.flush()
        state, _, text = self._answer().partition("\n")
        return state == "OK", text

    def close(self) -> None:
        self._file.close()
        self._socket.close()
