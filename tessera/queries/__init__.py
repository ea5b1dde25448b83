"""Registered queries, one module per area."""

import importlib

MODULES = ["indexing", "asking", "searching", "matching", "aggregating", "tables"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tessera.queries.{name}")
