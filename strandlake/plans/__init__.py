"""The engine's plans: each module registers queries over the tables."""

from __future__ import annotations

from importlib import import_module

MODULES = ("basics", "libraries", "variation", "reads", "models", "diploid")


def load() -> tuple[dict, dict]:
    """(queries, oracle SQL) of all modules."""
    for name in MODULES:
        import_module(f".{name}", __name__)
    registry = import_module(".registry", __name__)
    return registry.QUERIES, registry.ORACLE
