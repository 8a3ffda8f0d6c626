"""Registered queries."""

from importlib import import_module

from songloom.plans.registry import ENTRIES, Entry

MODULES = [
    "loading", "scalars", "preparation", "profiling", "retrieval", "neighbourhood",
    "accounts", "features", "models", "streams",
]


def all_entries() -> dict[str, Entry]:
    for name in MODULES:
        import_module(f"songloom.plans.{name}")
    return dict(ENTRIES)
