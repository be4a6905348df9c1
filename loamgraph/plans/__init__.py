"""Registered queries, by group."""

from importlib import import_module

GROUPS: tuple[str, ...] = ("graph_queries", "search_queries", "text_queries", "store_queries", "feed_queries", "sql_queries", "snapshot_queries", "code_queries")


def load():
    """Import every group once and return the registry module."""
    for name in GROUPS:
        import_module(f"loamgraph.plans.{name}")
    return import_module("loamgraph.plans.registry")
