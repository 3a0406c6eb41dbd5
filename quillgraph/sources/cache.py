"""Records kept at hand between point lookups."""

from __future__ import annotations

from collections import OrderedDict
from typing import Protocol


class Cache(Protocol):
    """Nodes and edges by id; None for what isn't kept."""

    def get(self, kind: str, key: int): ...
    def put(self, kind: str, key: int, row) -> None: ...
    def drop(self, kind: str, key: int) -> None: ...
    def clear(self) -> None: ...


class LruCache:
    """The records looked up last, up to a number of nodes and one of edges."""

    def __init__(self, nodes: int, edges: int) -> None:
        if nodes <= 0 or edges <= 0:
            raise ValueError("a cache holds one record at least")
        self._most = {"node": nodes, "edge": edges}
        self._rows: dict[str, OrderedDict] = {"node": OrderedDict(), "edge": OrderedDict()}

    def get(self, kind: str, key: int):
        rows = self._rows[kind]
        if key in rows:
            rows.move_to_end(key)
        return rows.get(key)

    def put(self, kind: str, key: int, row) -> None:
        rows = self._rows[kind]
        rows[key] = row
        rows.move_to_end(key)
        if len(rows) > self._most[kind]:
            rows.popitem(last=False)

    def drop(self, kind: str, key: int) -> None:
        self._rows[kind].pop(key, None)

    def clear(self) -> None:
        for rows in self._rows.values():
            rows.clear()


class NoCache:
    """Keeps nothing."""

    def get(self, kind: str, key: int):
        return None

    def put(self, kind: str, key: int, row) -> None:
        pass

    def drop(self, kind: str, key: int) -> None:
        pass

    def clear(self) -> None:
        pass
