"""What can go wrong, as exceptions."""


class GraphError(Exception):
    pass


class NodeNotFound(GraphError):
    def __init__(self, node_id: int) -> None:
        super().__init__(f"node N{node_id} not found")


class LogError(GraphError):
    """A record of a log can't be read or written."""


class ParseError(GraphError):
    """A query text isn't a sentence of its language."""


class ScanTooLarge(GraphError):
    """A full scan exceeds the configured guard."""
