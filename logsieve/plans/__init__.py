"""Queries over the driver tables, with the SQL they are checked against."""

from importlib import import_module

_MODULES = ["ingest", "findings", "retrieval", "conversing", "jobbing", "ticketing", "watching", "measuring", "streams"]


def load_all() -> None:
    """Import every module that registers queries."""
    for name in _MODULES:
        import_module(f"logsieve.plans.{name}")
