"""Bindings of the operators to the claims views and the registered queries."""

from importlib import import_module

_BINDINGS = ("ingest", "validation", "cleaning", "feature", "texts", "scoring", "models", "watch", "streams")


def load_all():
    """Import every binding module and return the registry."""
    for name in _BINDINGS:
        import_module(f"veriloom.plans.{name}")
    return import_module("veriloom.plans.registry")
