"""The commands that both query languages mean."""

from __future__ import annotations

from dataclasses import dataclass

from quillgraph.functions.compare import Literal


@dataclass(frozen=True)
class Condition:
    """target is ("label",), ("weight",) or ("prop", name)."""

    target: tuple[str, ...]
    op: str
    value: Literal


@dataclass(frozen=True)
class MatchNodes:
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class MatchEdges:
    conditions: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class GetNode:
    id: int


@dataclass(frozen=True)
class GetEdge:
    id: int


@dataclass(frozen=True)
class Traverse:
    kind: str  # BFS or DFS
    start: int


@dataclass(frozen=True)
class ShortestPath:
    start: int
    goal: int


@dataclass(frozen=True)
class CountNodes:
    pass


@dataclass(frozen=True)
class CountEdges:
    pass


Command = MatchNodes | MatchEdges | GetNode | GetEdge | Traverse | ShortestPath | CountNodes | CountEdges
