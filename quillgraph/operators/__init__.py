"""Operators over a property graph: matching, traversal, paths, statistics and changes."""
