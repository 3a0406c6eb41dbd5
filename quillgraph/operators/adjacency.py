"""A graph's edges as rounds of an iterative operator need them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.model import PropertyGraph
from quillgraph.operators.rounds import saved

#: Rows of ids that are broadcast, at most: 16 bytes each, a few MB.
MAX_BROADCAST = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of a known number of rows, broadcast if they are few; otherwise joins shuffle."""
    return F.broadcast(df) if rows <= MAX_BROADCAST else df


class Adjacency:
    """Edge tables, of which a round reads those that its frontier can leave by.

    A table says between which ids its edges begin, if that is known; others may always matter. A table that a second
    round needs is kept in the checkpoint folder, so that no source, and no shuffle that makes one, is read more than twice.
    """

    def __init__(self, graph: PropertyGraph, *columns: str) -> None:
        self._columns = columns
        self._tables = [[t.df.select(*columns), t.src_range, 0] for t in graph.edge_tables]

    def flags(self, column: str) -> list:
        """Aggregates that tell of each table whether any id of ``column`` lies in its range."""
        inside = lambda r: F.lit(True) if r is None else F.col(column).between(*r)
        return [F.coalesce(F.max(inside(r)), F.lit(False)).alias(f"table_{k}") for k, (_, r, _) in enumerate(self._tables)]

    def frontier(self, front: DataFrame, column: str = "node_id") -> tuple[int, list[bool]]:
        """Rows of a frontier, and which tables it can leave by."""
        row = front.agg(F.count(F.lit(1)).alias("n"), *self.flags(column)).first()
        return row["n"], [bool(row[f"table_{k}"]) for k in range(len(self._tables))]

    def links(self, wanted: list[bool]) -> DataFrame | None:
        """The edges of the wanted tables; None without any."""
        parts = []
        for entry, needed in zip(self._tables, wanted, strict=True):
            if needed:
                entry[2] += 1
                if entry[2] == 2:
                    entry[0] = saved(entry[0])
                parts.append(entry[0])
        return reduce(DataFrame.unionByName, parts) if parts else None
