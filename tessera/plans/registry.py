"""All queries by name."""

from __future__ import annotations

import importlib

MODULES = ("analytics", "joins", "graph", "retrieval", "search", "learning", "tools", "records", "profiles", "venues", "links", "disambiguation", "answers", "centrality", "catalog", "relational", "served")


def all_queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"tessera.operators.{name}").QUERIES
    return out
