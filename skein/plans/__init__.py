"""Registered queries, one module per domain."""

from importlib import import_module

MODULES = ("ledger", "governance", "text", "scan", "analytics", "retrieval", "registry_queries", "streaming")


def load_all() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")
